import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabassay.functions.missing import nan_to_null, normalize_missing
from tabassay.operators import correlation as corr
from tabassay.operators import outliers as out
from tabassay.operators import profile as prof
from tabassay.operators import quality as qual
from tabassay.plans.eda import analyze, read_section, store_analysis, stored_sections

MIXED = "id bigint, i int, d double, s string, b boolean, dt date"


@pytest.fixture(scope="module")
def random_frame(spark):
    rng = np.random.default_rng(11)
    n = 500
    pdf = pd.DataFrame(
        {
            "a": rng.normal(3, 2, n),
            "b": np.where(rng.random(n) < 0.2, np.nan, np.exp(rng.normal(0, 1.5, n))),
            "k": np.full(n, 0.1),
            "c": rng.choice(["x", "y", "z", None], n),
        }
    )
    pdf["a2"] = pdf["a"] * 2 + rng.normal(0, 0.1, n)
    return pdf, spark.createDataFrame(pdf)


def test_numeric_profile_equals_pandas(random_frame):
    pdf, df = random_frame
    got = {r["column_name"]: r for r in prof.numeric_profile(df).collect()}
    for c in ("a", "b", "k", "a2"):
        s = pdf[c].dropna()
        assert got[c]["count"] == len(s)
        for metric, want in {
            "mean": s.mean(), "median": s.median(), "std": s.std(), "min": s.min(),
            "max": s.max(), "q25": s.quantile(0.25), "q75": s.quantile(0.75),
            "skewness": s.skew(), "kurtosis": s.kurtosis(),
        }.items():
            assert got[c][metric] == pytest.approx(want, rel=1e-9, abs=1e-9), (c, metric)


def test_outliers_equal_pandas(random_frame):
    pdf, df = random_frame
    got = {r["column_name"]: r for r in out.outliers(df).collect()}
    assert "k" not in got
    for c in ("a", "b", "a2"):
        q1, q3 = pdf[c].quantile(0.25), pdf[c].quantile(0.75)
        mask = (pdf[c] < q1 - 1.5 * (q3 - q1)) | (pdf[c] > q3 + 1.5 * (q3 - q1))
        assert got[c]["outlier_count"] == mask.sum()
        assert got[c]["outlier_percentage"] == pytest.approx(mask.sum() / len(pdf) * 100)


def test_correlation_equals_pandas(random_frame):
    pdf, df = random_frame
    want = pdf[["a", "b", "k", "a2"]].corr()
    for r in corr.correlation_matrix(df).collect():
        w = want.loc[r["feature1"], r["feature2"]]
        if np.isnan(w) or "k" in (r["feature1"], r["feature2"]):
            assert r["correlation"] is None
        else:
            assert r["correlation"] == pytest.approx(w, abs=1e-10)
    strong = [tuple(r)[:2] for r in corr.strong_correlations(df).collect()]
    assert strong == [("a", "a2")]


def test_many_columns_use_the_matrix_form(spark, monkeypatch):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame(rng.normal(size=(300, 7)), columns=list("abcdefg"))
    pdf["f"] = pdf["a"] + pdf["b"]
    pdf.loc[::3, "g"] = np.nan
    monkeypatch.setattr(corr, "MANY_COLUMNS", 3)
    monkeypatch.setattr(corr, "AGGREGATES_PER_SCAN", 2)
    want = pdf.corr()
    for r in corr.correlation_matrix(spark.createDataFrame(pdf)).collect():
        assert r["correlation"] == pytest.approx(want.loc[r["feature1"], r["feature2"]], abs=1e-9)


def test_pairwise_correlation_and_constant_subset(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 7.0), (4.0, 1.0)], "a double, b double")
    rows = {tuple(r)[:2]: r["correlation"] for r in corr.correlation_matrix(df).collect()}
    assert rows[("a", "b")] == pytest.approx(0.0339422117, abs=1e-9)
    shared = [(0.3, 5.0), (0.3, 6.0), (0.3, 9.0), (77.7, None)]
    df = spark.createDataFrame(shared, "a double, b double")
    rows = {tuple(r)[:2]: r["correlation"] for r in corr.correlation_matrix(df).collect()}
    assert rows[("a", "b")] is None


def test_mode_ties_and_top_values(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    row = prof.categorical_profile(df).first()
    assert (row["mode"], row["mode_frequency"], row["unique_values"], row["missing_count"]) == (
        "a", 2, 2, 1,
    )
    assert [r["value"] for r in prof.top_values(prof.value_counts(df), 1).collect()] == ["a"]


def test_iqr_bounds_are_strict(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 21)] + [(100, 100.0)], "id int, v double")
    row = out.outliers(df.select("v")).first()
    assert row["outlier_count"] == 1
    on_bound = df.select("v").unionByName(df.limit(1).select(F.lit(row["upper_bound"]).alias("v")))
    assert out.outliers(on_bound, {"v": (row["lower_bound"], row["upper_bound"])}).first()[
        "outlier_count"
    ] == 1
    assert [r["row_key"] for r in out.outlier_ids(df, "id").collect()] == [100]


def test_nan_and_infinity(spark):
    df = spark.createDataFrame(
        [(1.0, "x"), (float("nan"), "NA"), (float("inf"), None)], "d double, s string"
    )
    assert [r["missing"] for r in prof.missing_counts(df).collect()] == [1, 1]
    assert [r["d"] for r in nan_to_null(df).collect()] == [1.0, None, None]
    assert [r["s"] for r in normalize_missing(df, ("NA",)).collect()] == ["x", None, None]


def test_duplicates_count_nulls_as_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, "a"), (2, None), (1, None)], "a int, b string")
    assert qual.duplicates(df).first()["duplicate_rows"] == 2


def test_empty_one_row_and_all_null_tables(spark):
    empty = spark.createDataFrame([], MIXED)
    report = analyze(empty, key="id")
    assert report.histogram.count() == 0
    assert report.missing_summary.first()["total_missing_percentage"] is None
    one = spark.createDataFrame([(1, 5, 2.0, "a", True, None)], MIXED)
    row = {r["column_name"]: r for r in prof.numeric_profile(one).collect()}["d"]
    assert row["std"] is None and row["skewness"] is None and row["median"] == 2.0
    blank = spark.createDataFrame([(1, None, None)], "id bigint, n double, s string")
    assert prof.missing_summary(blank).first()["fully_missing_columns"] == "n,s"
    assert analyze(blank, key="id").insights.first()["severity"] == "CRITICAL"


def test_no_numeric_columns(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "s string")
    assert tuple(prof.describe(df).first()) == tuple(prof.describe_strings(df).first())
    assert tuple(prof.describe_strings(df).first()) == ("s", 2, 1, "a", 2)
    with pytest.raises(ValueError):
        corr.correlation_matrix(df)


def test_top_values_limit_before_the_shuffle(spark, data, capsys):
    counts = prof.value_counts(spark.read.parquet(f"{data}/part.parquet"))
    prof.top_values(counts).explain("formatted")
    plan = capsys.readouterr().out
    assert plan.count("WindowGroupLimit") >= 2


def test_hashed_counts_give_the_same_tops(spark):
    same = "x" * 40  # longer than what travels with a hash
    values = [same + "b", same + "a", same + "a", same + "b", "k", "k", "", None, "z", "é", same]
    rows = [(v, values[(k * 7) % 11]) for k, v in enumerate(values)]
    df = spark.createDataFrame(rows * 2 + [(f"u{k:02d}", None) for k in range(30)], "s string, t string")
    df = df.repartition(4)
    counts = prof.hashed_counts(df)
    plain = prof.value_counts(df)
    key = ["column_name", "value", "cnt", "rnk"]
    for n in (1, 3, 10):
        got = prof.top_texts(df, counts, n).select(key)
        want = prof.top_values(plain, n).select(key)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    few = prof.SENT_ROWS
    try:
        prof.SENT_ROWS = 0  # candidates of any number are joined by a shuffle
        got = prof.top_texts(df, counts, 10).select(key)
        want = prof.top_values(plain, 10).select(key)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    finally:
        prof.SENT_ROWS = few
    profile = {r["column_name"]: r for r in prof.categorical_profile(df).collect()}
    modes = {r["column_name"]: r for r in prof.string_modes(plain).collect()}
    for name, r in modes.items():
        assert (profile[name]["unique_values"], profile[name]["mode"], profile[name]["mode_frequency"]) == (
            r["unique_values"], r["mode"], r["mode_frequency"]
        )


def test_no_whole_text_is_shuffled(spark, data, capsys):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    prof.hashed_counts(docs, ["text"]).explain("extended")
    plan = capsys.readouterr().out.split("== Physical Plan ==")[1]
    exchanged = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanged and all("value#" not in line and "text#" not in line for line in exchanged)


def test_stored_sections(spark, tmp_path, capsys):
    path = str(tmp_path / "analyses")
    one = spark.createDataFrame([(1, 2.0, "a"), (2, None, "a"), (3, 4.0, None)], "id long, v double, s string")
    store_analysis(analyze(one, key="id"), "first", path)
    store_analysis(analyze(one.filter("id < 3"), key="id"), "second", path)
    before = sorted(map(tuple, read_section(spark, path, "first", "quality").collect()), key=repr)
    store_analysis(analyze(one.limit(0), key="id"), "second", path)  # replaces that one alone
    rows = read_section(spark, path, "first", "quality")
    assert sorted(map(tuple, rows.collect()), key=repr) == before and before
    assert read_section(spark, path, "second", "missing_per_column").collect() == []
    sections = {tuple(r) for r in stored_sections(spark, path).collect()}
    assert {("first", "quality"), ("second", "quality")} <= sections
    rows.explain("formatted")
    plan = capsys.readouterr().out
    assert "PartitionFilters" in plan and "section" in plan.split("PartitionFilters")[1].splitlines()[0]
