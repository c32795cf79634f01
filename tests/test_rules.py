"""Results that must not depend on sizes, chunks, caps or stray values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabassay.functions.scores import left_out, settled
from tabassay.operators import algorithms as alg
from tabassay.operators import business, correlation, curves, metrics, prefix, profile, quality
from tabassay.operators import modeling as mod
from tabassay.operators.features import FOLD, LABEL, fit_features
from tabassay.operators.folds import hash_folds, rank_folds
from tabassay.operators.prefix import chunk_edges
from tabassay.operators.runlog import RunLog, running_best
from tabassay.plans import training as tr
from tabassay.plans.eda import analyze
from tabassay.plans.evaluation import evaluate_model
from tabassay.session import fresh_dir
from tabassay.sources.manifest import dataset_details
from tabassay.sources.readers import read_csv
from tabassay.sources.sampling import in_test_split

NAN = float("nan")


@pytest.fixture(scope="module")
def scored(spark):
    rows = []
    for k in range(600):
        p = NAN if k % 9 == 0 else None if k % 31 == 0 else (k * 37 % 50) / 50
        y = None if k % 41 == 0 else int((k * 13) % 7 > 2)
        rows.append((k, y, p, "test" if k % 2 else "train"))
    return spark.createDataFrame(rows, "id long, y int, p double, split string").cache()


def exact_areas(rows):
    kept = [(r.p, r.y) for r in rows if r.p is not None and not math.isnan(r.p) and r.y is not None]
    pos, neg = [p for p, y in kept if y], [p for p, y in kept if not y]
    wins = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
    precision = 0.0
    for p in sorted(set(pos)):
        tp, fp = sum(a >= p for a in pos), sum(b >= p for b in neg)
        precision += sum(a == p for a in pos) * tp / (tp + fp)
    return wins / len(pos) / len(neg), precision / len(pos)


@pytest.mark.parametrize("rows_per_chunk", [7, 100, 1_000_000])
def test_areas_do_not_depend_on_chunks(scored, rows_per_chunk, monkeypatch):
    monkeypatch.setattr(prefix, "CHUNKS_PER_SKETCH", 5)
    found = curves.auc_ap(scored, rows_per_chunk=rows_per_chunk).first()
    auc, precision = exact_areas(scored.collect())
    assert found["auc_roc"] == pytest.approx(auc)
    assert found["average_precision"] == pytest.approx(precision)


def test_many_chunks_are_cut_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(prefix, "CHUNKS_PER_SKETCH", 4)
    df = spark.range(2000)
    edges = chunk_edges(df, F.col("id").cast("double"), 50)
    sizes = [b - a for a, b in zip([0, *edges], [*edges, 2000], strict=True)]
    assert len(edges) >= 35 and max(sizes) <= 120


@pytest.mark.parametrize("rows_per_chunk", [7, 100, 1_000_000])
def test_running_best_and_folds_do_not_depend_on_chunks(spark, rows_per_chunk, monkeypatch):
    monkeypatch.setattr(prefix, "CHUNKS_PER_SKETCH", 5)
    # One job holds most rows, nearly all in one second, told apart by microseconds.
    log = spark.range(500).selectExpr(
        "if(id % 5 = 0, id % 3, 9) AS job", "id",
        "timestamp_ntz'2024-01-01 00:00:01' + make_dt_interval(0, 0, 0, (id % 97) / 1000) AS ts",
        "if(id % 11 = 0, null, (id * 37 % 100) / 10d) AS score",
    )
    found = running_best(log, "job", ["ts", "id"], "score", rows_per_chunk=rows_per_chunk)
    best = {}
    expected = {}
    for r in sorted(log.collect(), key=lambda r: (r.job, r.ts, r.id)):
        seen = [x for x in (best.get(r.job), r.score) if x is not None]
        best[r.job] = expected[r.id] = max(seen) if seen else None
    assert {r.id: r.best_so_far for r in found.collect()} == expected
    folds = rank_folds(log, "id", 4, "job", rows_per_chunk=rows_per_chunk)
    sizes = folds.groupBy("job", "fold").count().collect()
    for job in {r.job for r in sizes}:
        own = [r["count"] for r in sizes if r.job == job]
        assert len(own) == 4 and max(own) - min(own) <= 1


def test_scores_that_are_no_numbers_are_left_out(scored):
    rows = [r for r in scored.collect() if r.y is not None and r.p is not None and r.p == r.p]
    out = settled(scored).agg(left_out().alias("n")).first()["n"]
    assert out == 600 - len(rows)
    hits = sum(r.p >= 0.5 for r in rows)
    one = metrics.confusion(scored).first()
    assert (one["total"], one["tp"] + one["fp"]) == (len(rows), hits)
    whole = metrics.threshold_evaluation(scored).first()
    assert (whole["total"], whole["tp"] + whole["fp"]) == (len(rows), hits)
    sweep = {r.threshold: r for r in business.threshold_sweep(scored).collect()}
    assert sweep[0.5]["tp"] + sweep[0.5]["fp"] == hits
    curve = metrics.learning_curve(scored).first()
    assert curve["test_loss"] < 20


def test_evaluating_no_rows_is_an_error(scored):
    with pytest.raises(ValueError, match="no rows"):
        evaluate_model(scored.filter("false"), ["p"])


def test_fractional_volume_counts(scored):
    counts = metrics.confusion(scored)
    half = business.business_impact(counts, business.Prices(volume=0.5)).first()
    full = business.business_impact(counts, business.Prices(volume=1.0)).first()
    assert half["net_profit"] == pytest.approx(full["net_profit"] / 2)


def test_empty_table_has_no_completeness(spark):
    report = analyze(spark.createDataFrame([], "a int, b string"))
    assert report.quality.first()["completeness"] is None


def test_keys_with_empty_low_bits_are_spread(spark):
    df = spark.range(4000).select((F.col("id") * 2**31).alias("k"))
    test = df.filter(in_test_split(df, "k")).count()
    assert 0.15 * 4000 < test < 0.25 * 4000
    folds = [r["count"] for r in hash_folds(df, "k", 5).groupBy("fold").count().collect()]
    assert len(folds) == 5 and min(folds) > 600


def test_codes_stay_text(spark):
    path = fresh_dir(spark, "codes") + ".csv"
    rows = [("1D", "1", "2024-01-01T00:00:00+02:00"), ("2F", "-2.5e3", "2024-01-02 10:00:00Z")]
    spark.createDataFrame(rows, "code string, n string, at string").write.option(
        "header", True
    ).csv(path)
    found = dict(read_csv(spark, path).dtypes)
    assert found == {"code": "string", "n": "double", "at": "timestamp"}


def test_more_than_a_hundred_classes(spark):
    df = spark.range(300).selectExpr("cast(id % 150 AS string) AS c")
    assert len(mod.class_names(df, "c")) == 150
    with pytest.raises(ValueError, match="more than 100"):
        mod.class_names(df, "c", 100)


def test_iterations_and_depth_are_what_is_asked():
    shape = alg.TrainShape(100)
    for name, kind in (("svm", "classification"), ("svr", "regression")):
        made = alg.estimator(name, kind, shape, alg.Effort(iterations=1000))
        assert made.getMaxIter() == 1000
    assert alg.Effort().tree_depth == 30


def test_levels_that_look_alike_get_numbers(spark):
    rows = [(k, ["a-b", "a b", "c"][k % 3], float(k)) for k in range(30)]
    plan = fit_features(spark.createDataFrame(rows, "id int, t string, v double").drop("id"))
    assert plan.names == ["v", "t_a_b", "t_c"]
    rows = [(k, ["a-b", "a b", "A"][k % 3], float(k)) for k in range(30)]
    plan = fit_features(spark.createDataFrame(rows, "id int, t string, v double").drop("id"))
    assert plan.names == ["v", "t_a_b", "t_a_b_2"]


@pytest.fixture(scope="module")
def curved(spark):
    rows = [(k, (k * 37 % 101) / 10, (k * 53 % 89) / 10) for k in range(400)]
    rows = [(k, a, b, 3 * a * a - 2 * a * b + (k % 7) / 10) for k, a, b in rows]
    return spark.createDataFrame(rows, "id long, a double, b double, target double").cache()


def test_cross_validation_scores_the_trained_model(curved):
    config = tr.TrainingConfig(cv_folds=3, polynomial_degree=2, n_features=4)
    found = tr.train(curved, "target", "linear", "regression", "id", config).scores.first()
    ready = tr.prepare(curved, "target", "regression", "id", config)
    scores = []
    for k in range(3):
        part = ready.train.filter(F.col(FOLD) != k)
        plan = fit_features(part, ready.columns)
        matrix = mod.build_matrix(part, plan, "regression", False, config.effort, 4, 2)
        shape = mod.train_shape(matrix.vectors, "regression", [], 4)
        fitted = mod.fit_stages(matrix.vectors, "linear", "regression", shape, config.effort)
        held = ready.train.filter(F.col(FOLD) == k)
        for stage in [*matrix.stages, *fitted]:
            held = stage.transform(held)
        scores.append(metrics.regression_metrics(held, LABEL).first()["r2"])
    assert found["cv_score"] == pytest.approx(sum(scores) / 3, abs=1e-4)
    assert found["cv_score"] > 0.95


def test_tuning_works_without_cross_validation(curved, recwarn):
    config = tr.TrainingConfig(cv_folds=0, tune_hyperparameters=True)
    found = tr.train(curved, "target", "ridge", "regression", "id", config)
    assert "regParam" in found.best_params
    assert not [w for w in recwarn if "tuning failed" in str(w.message)]


def test_jobs_end_as_they_ended(spark, curved):
    home = fresh_dir(spark, "jobs")
    job = RunLog(spark, f"{home}/log", "job", "training")
    config = tr.TrainingConfig(
        cv_folds=0, run_log=job, model_dir=f"{home}/models", registry_path=f"{home}/registry",
        importance_path=f"{home}/importance",
    )
    done = tr.train(curved, "target", "linear", "regression", "id", config)
    log = spark.read.parquet(f"{home}/log").orderBy(F.col("event_ts").desc())
    assert log.first()["status"] == "completed"
    loaded = mod.FittedModel.load(spark, f"{home}/models/{done.model_id}")
    assert mod.predict(loaded, curved).count() == 400
    assert spark.read.parquet(f"{home}/registry").first()["model_id"] == done.model_id
    assert spark.read.parquet(f"{home}/importance").count() == 2
    flat = curved.withColumn("target", F.lit(None).cast("double"))
    with pytest.raises(ValueError):
        tr.automl(flat, "target", "regression", "id", config=config)
    last = spark.read.parquet(f"{home}/log").orderBy(F.col("event_ts").desc()).first()
    assert last["status"] == "failed" and last["message"]


def test_failure_causes_come_from_the_data(curved):
    bare = curved.select("id", F.lit(None).cast("double").alias("a"), F.lit("one").alias("target"))
    with pytest.raises(tr.NoAlgorithmSucceeded) as caught:
        tr.automl(bare, "target", "classification", "id", cv_folds=2, algorithms=["logistic"])
    assert "the target has a single class in the training rows" in caught.value.causes
    assert any("no usable feature" in c for c in caught.value.causes)


def test_text_and_boolean_targets(spark):
    rows = [(k, "x" if k % 2 else "y", k % 2 == 1, float(k % 2) + k / 1000, float(k)) for k in range(100)]
    df = spark.createDataFrame(rows, "id long, churn string, gone boolean, a double, b double")
    for target in ("churn", "gone"):
        ranked = correlation.feature_target_rank(df, target, ["a", "b"]).collect()
        assert [r.feature for r in ranked] == ["a", "b"]
        assert ranked[0]["importance"] > 0.99 > 0.1 > ranked[1]["importance"]
        assert analyze(df, key="id", target=target).features.count() == 2


def test_quality_keeps_bounds(spark):
    report = analyze(spark.createDataFrame([(1, None), (1, "a")], "a int, b string"))
    row = report.quality.first()
    assert 0 <= row["completeness"] <= 100
    assert quality.BANDS


def test_correlations_of_many_columns_with_nulls(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 30)) @ rng.standard_normal((30, 30)) + 1000
    x[rng.random(x.shape) < 0.1] = np.nan
    rows = [tuple(None if math.isnan(v) else float(v) for v in r) for r in x]
    names = [f"c{i}" for i in range(30)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[:i]]
    found, _ = correlation.correlations(df, pairs)
    for a, b in pairs:
        u, v = x[:, names.index(a)], x[:, names.index(b)]
        both = ~np.isnan(u) & ~np.isnan(v)
        assert found[a, b] == pytest.approx(np.corrcoef(u[both], v[both])[0, 1], abs=1e-8)


def test_hashed_counts_tell_values_apart(spark):
    rows = [(None, "a", 0.0, [None, 1]), ("a", None, -0.0, [1]), ("a", None, 0.0, [1]), (None, "a", NAN, [1, None])]
    df = spark.createDataFrame(rows, "a string, b string, c double, d array<int>")
    assert quality.duplicates(df).first()["duplicate_rows"] == 1
    counts = {r.column_name: r.unique_count for r in profile.unique_counts(df).collect()}
    assert counts == {"a": 1, "b": 1, "c": 1, "d": 3}


def test_tables_without_numbers_are_described(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,)], "t string")
    row = profile.describe(df).first()
    assert (row["count"], row["unique"], row["top"], row["freq"]) == (2, 1, "a", 2)


def test_dataset_details_hold_the_first_rows(spark):
    df = spark.range(20).selectExpr("19 - id AS k", "concat('v', id) AS v")
    row = dataset_details(df, "d", "name", "/path", "k").first()
    assert (row["row_count"], row["column_count"]) == (20, 2)
    assert row["sample"] == [f'{{"k":{k},"v":"v{19 - k}"}}' for k in range(5)]
