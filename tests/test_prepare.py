import numpy as np
import pytest
from pyspark.sql import functions as F

from tabassay.functions.families import columns_of, require_column
from tabassay.functions.scalars import label_from_name
from tabassay.operators import cleaning as cl
from tabassay.operators.features import fit_features
from tabassay.operators.folds import rank_folds
from tabassay.operators.profile import column_types
from tabassay.sources.manifest import list_datasets, register
from tabassay.sources.readers import find_dataset, from_rows, read_any, read_csv
from tabassay.sources.sampling import sample_rows, split


def test_cardinality_limit_and_target(spark):
    df = spark.range(510).select(
        "id",
        (F.col("id") % 50).cast("string").alias("card50"),
        (F.col("id") % 51).cast("string").alias("card51"),
        F.concat(F.lit("t"), (F.col("id") % 51).cast("string")).alias("target"),
        F.lit(None).cast("double").alias("n"),
        F.lit("2024-01-01").cast("date").alias("day"),
    )
    found = cl.clean(df, "target", keep=["id"])
    assert found.data.columns == ["id", "card50", "target"]
    assert (found.columns_before, found.columns_after) == (6, 3)
    assert {tuple(r) for r in found.issues.collect()} == {
        ("datetime", "day"), ("all_null", "n"), ("high_cardinality", "card51"),
    }
    with pytest.raises(ValueError):
        cl.clean(df, "absent")


def test_one_hot_and_unseen_values(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "c string")
    known = cl.levels(df, ["c"])
    assert cl.one_hot(df, known).columns == ["c_b", "c_c"]
    new = spark.createDataFrame([("b",), ("q",), (None,)], "c string")
    assert [tuple(r) for r in cl.one_hot(new, known).collect()] == [(1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]


def test_imputation(spark):
    df = spark.createDataFrame([(1.0, "b"), (None, "a"), (3.0, None)], "n double, s string")
    assert sorted(r["n"] for r in cl.impute_mean(df).collect()) == [1.0, 2.0, 3.0]
    assert [r["s"] for r in cl.impute_mode(df).collect()] == ["b", "a", "a"]
    blank = df.select(F.lit(None).cast("string").alias("s"))
    assert {r["s"] for r in cl.impute_mode(blank).collect()} == {"Unknown"}
    assert cl.drop_null_rows(df).count() == 1


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], ["a-b", " c.d "])
    assert cl.sanitize_names(df).columns == ["a_b", "c_d"]
    with pytest.raises(ValueError):
        cl.sanitize_names(spark.createDataFrame([(1, 2)], ["a-b", "a b"]))
    with pytest.raises(ValueError):
        require_column(df, "zz")
    labels = spark.createDataFrame([("data_loading",)], "n string")
    assert labels.select(label_from_name(F.col("n"))).first()[0] == "Data Loading"
    assert [tuple(r) for r in column_types(labels).collect()] == [("n", "string")]


def test_feature_plan_survives_awkward_names_and_values(spark):
    rows = [("it's", 1.0, True), ("back\\slash", None, None), ("plain", 3.0, True), (None, 4.0, False)]
    df = spark.createDataFrame(rows, "`a b` string, `x.y` double, f boolean")
    plan = fit_features(df, scaling="minmax")
    assert plan.names == ["x_y", "f", "a_b_it's", "a_b_plain"]
    encoded = [tuple(r) for r in plan.encode(df).collect()]
    assert encoded[0] == (0.0, 1.0, 1.0, 0.0)
    assert encoded[1][0] == pytest.approx((8 / 3 - 1) / 3) and encoded[1][1] == 1.0
    assert encoded[3][2:] == (0.0, 0.0)


@pytest.mark.parametrize("method", ["standard", "minmax", "robust"])
def test_scaling_equals_numpy(spark, method):
    x = np.random.default_rng(0).normal(5, 2, 101)
    df = spark.createDataFrame([(float(v), 7.0) for v in x], "x double, k double")
    got = np.array([tuple(r) for r in cl.scale(df, ["x", "k"], method).collect()])
    centre, spread = {
        "standard": (x.mean(), x.std()),
        "minmax": (x.min(), x.max() - x.min()),
        "robust": (np.median(x), np.quantile(x, 0.75) - np.quantile(x, 0.25)),
    }[method]
    assert np.allclose(got[:, 0], (x - centre) / spread)
    assert np.allclose(got[:, 1], 0.0)


@pytest.mark.parametrize("n", [0, 1, 37, 999, 1000])
def test_samples_are_exact_and_repeatable(spark, n):
    df = spark.range(1000)
    got = sorted(r["id"] for r in sample_rows(df.repartition(7), "id", n).collect())
    hashed = sorted(range(1000), key=lambda k: ((k * 2654435761 + 42) % 2**32, k))
    assert got == sorted(hashed[:n])


def test_sample_with_copied_and_string_keys(spark):
    copies = spark.range(300).select((F.col("id") % 3).alias("k"))
    for n in (50, 100, 170):
        assert sample_rows(copies, "k", n).count() == n
    words = spark.range(300).select(F.concat(F.lit("w"), F.col("id").cast("string")).alias("k"))
    assert sample_rows(words, "k", 50).count() == 50


def test_exact_split_and_folds(spark):
    df = spark.range(103).select("id", (F.col("id") % 10 < 7).cast("int").alias("y"))
    train, test = split(df, "id", 0.2, exact=True)
    assert (train.count(), test.count()) == (82, 21)
    assert train.join(test, "id").count() == 0
    folds = rank_folds(df, "id", 5, "y", rows_per_chunk=9)
    sizes = {}
    for r in folds.groupBy("y", "fold").count().collect():
        sizes.setdefault(r["y"], []).append(r["count"])
    assert all(len(s) == 5 and max(s) - min(s) <= 1 for s in sizes.values())
    assert folds.count() == 103
    words = df.select(F.concat(F.lit("key-"), F.col("id").cast("string")).alias("k"))
    counts = rank_folds(words, "k", 5, rows_per_chunk=9).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in counts) == [20, 20, 21, 21, 21]


def test_csv_types_and_tokens(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,c,d,e\n1,1.5,x,2024-01-01,true\n,2.5,NA,2024-01-02,false\n3,,,,\n")
    df = read_csv(spark, str(path))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "string", "date", "boolean"]
    assert [r["c"] for r in df.collect()] == ["x", None, None]
    assert read_any(spark, str(path)).count() == 3
    assert find_dataset(spark, str(tmp_path), "t").count() == 3
    with pytest.raises(FileNotFoundError):
        find_dataset(spark, str(tmp_path), "absent")
    for bad in ("t.json", "t.xlsx"):
        with pytest.raises(ValueError):
            read_csv(spark, str(tmp_path / bad))
    with pytest.raises(ValueError):
        read_any(spark, str(tmp_path / "t.xlsx"))


def test_inline_rows_and_manifest(spark, tmp_path):
    df = from_rows(spark, [{"a": 1, "b": "x"}, {"a": 2.5, "c": True}])
    assert df.dtypes == [("a", "double"), ("b", "string"), ("c", "boolean")]
    assert [tuple(r) for r in df.collect()] == [(1.0, "x", None), (2.5, None, True)]
    with pytest.raises(ValueError):
        from_rows(spark, [])
    for name in ("one", "two"):
        register(df, name, name, "inline", str(tmp_path / "m"))
    rows = list_datasets(spark.read.parquet(str(tmp_path / "m"))).collect()
    assert {(r["dataset_id"], r["row_count"], r["total"]) for r in rows} == {("one", 2, 2), ("two", 2, 2)}
    assert rows[0]["dtypes"]["a"] == "double"


def test_families(spark):
    df = spark.sql("SELECT 1 i, CAST(1 AS DECIMAL(5,2)) m, 'a' s, true b, DATE'2024-01-01' d, array(1) a")
    assert columns_of(df, "numeric") == ["i", "m"]
    assert columns_of(df, "string") == ["s"]
    assert columns_of(df, "boolean") == ["b"] and columns_of(df, "datetime") == ["d"]
