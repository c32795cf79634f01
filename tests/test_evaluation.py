import numpy as np
import pytest
from pyspark.sql import functions as F

from tabassay.operators import business as biz
from tabassay.operators import curves, metrics
from tabassay.operators import readiness as ready
from tabassay.operators.cleaning import require_rows
from tabassay.plans.evaluation import evaluate_model

COUNTS = "tn bigint, fp bigint, fn bigint, tp bigint, total bigint"


def scored(spark, y, p):
    return spark.createDataFrame(list(zip(y, map(float, p))), "y int, p double")


def test_documented_counts(spark):
    counts = spark.createDataFrame([(100, 10, 15, 75, 200)], COUNTS)
    columns = metrics.metric_columns() | metrics.rate_columns()
    row = counts.select(*[F.round(c, 3).alias(n) for n, c in columns.items()]).first()
    assert tuple(row) == (0.875, 0.882, 0.833, 0.857, 0.091, 0.167, 0.833, 0.909)
    impact = biz.business_impact(counts, biz.Prices(volume=200)).first()
    assert impact["total_false_positive_cost"] == 5000
    assert impact["total_false_negative_cost"] == 30000
    assert impact["total_cost"] == 35000
    assert impact["net_profit"] == 40000


@pytest.mark.parametrize(
    "p,threshold", [([0.1, 0.9, 0.8, 0.2, 0.7], 0.5), ([0.2, 0.8, 0.9, 0.1, 0.7], 0.55)]
)
def test_documented_requests(spark, p, threshold):
    row = metrics.threshold_evaluation(scored(spark, [0, 1, 1, 0, 1], p), threshold).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (2, 0, 0, 3)
    assert row["accuracy"] == row["precision"] == row["recall"] == row["f1_score"] == 1.0
    assert row["auc_roc"] == 1.0


def test_free_business_has_no_return(spark):
    row = biz.business_impact(spark.createDataFrame([(1, 0, 0, 4, 5)], COUNTS)).first()
    assert row["net_profit"] == 8_000_000 and row["roi_improvement_percent"] is None


def test_readiness_summary_arithmetic(spark):
    status = ["pass"] * 14 + ["fail"] * 2 + ["pending"] * 2
    row = ready.readiness_summary(spark.createDataFrame([(s,) for s in status], "status string")).first()
    assert (row["pass_rate"], row["overall_status"]) == (77.8, "pending")
    assert row["deployment_recommendation"] == "Fix 2 failing criteria before deployment"
    assert row["estimated_time_to_production"] == "1-2 days"


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    wins = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("rows_per_chunk", [1_000_000, 5])
def test_auc_counts_ties_half_on_every_path(spark, rows_per_chunk):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 200)
    p = np.round(rng.random(200) * 0.5 + y * 0.3, 1 if rows_per_chunk > 100 else 2)
    row = curves.auc_ap(scored(spark, y.tolist(), p), rows_per_chunk=rows_per_chunk).first()
    assert row["auc_roc"] == pytest.approx(brute_auc(y, p))
    points = curves.roc_curve(scored(spark, y.tolist(), p), rows_per_chunk=rows_per_chunk)
    last = points.orderBy("threshold").first()
    assert (last["fpr"], last["tpr"]) == (1.0, 1.0)
    assert points.count() == len(set(p))


def test_auc_per_model_when_chunked(spark):
    rng = np.random.default_rng(2)
    rows = [
        (m, int(y), float(round(p + 0.2 * y, 3)))
        for m in ("hot",) * 4 + ("cold",)
        for y, p in zip(rng.integers(0, 2, 60), rng.random(60))
    ]
    df = spark.createDataFrame(rows, "model_id string, y int, p double")
    got = {r["model_id"]: r["auc_roc"] for r in curves.auc_ap(df, ["model_id"], rows_per_chunk=20).collect()}
    for m in ("hot", "cold"):
        y = np.array([r[1] for r in rows if r[0] == m])
        p = np.array([r[2] for r in rows if r[0] == m])
        assert got[m] == pytest.approx(brute_auc(y, p))


def test_one_class_and_empty(spark):
    only = scored(spark, [1, 1, 1], [0.2, 0.6, 0.9])
    row = metrics.threshold_evaluation(only).first()
    assert row["auc_roc"] is None and row["imbalance_ratio"] is None and row["tp"] == 2
    with pytest.raises(ValueError):
        require_rows(only.limit(0))


def test_sweep_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    y, p = rng.integers(0, 2, 300), np.round(rng.random(300), 2)
    sweep = biz.threshold_sweep(scored(spark, y.tolist(), p))
    best = (None, -np.inf)
    for r in sweep.orderBy("threshold").collect():
        hit = p >= r["threshold"]
        profit = 1000 * (hit & (y == 1)).sum() - 500 * (hit & (y == 0)).sum() - 2000 * (~hit & (y == 1)).sum()
        assert r["profit"] == profit
        if profit > best[1]:
            best = (r["threshold"], profit)
    row = biz.optimal_threshold(sweep).first()
    assert (row["optimal_threshold"], row["optimal_profit"]) == best


def test_learning_curve_without_train_rows(spark):
    df = scored(spark, [0, 1], [0.1, 0.9]).withColumn("split", F.lit("test"))
    row = metrics.learning_curve(df).first()
    assert row["gap"] == 0 and row["overfitting_status"] == "none" and row["train_loss"] is None


def test_complete_evaluation_sections(spark):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 400)
    x = y + rng.normal(0, 0.4, 400)
    rows = [(int(a), float(1 / (1 + np.exp(-4 * (b - 0.5)))), float(b)) for a, b in zip(y, x)]
    df = spark.createDataFrame(rows, "y int, p double, x double").withColumn("split", F.lit("test"))
    report = evaluate_model(df, ["x"])
    assert report.criteria.count() == 18
    summary = report.production_readiness.first()
    assert summary["passed"] + summary["failed"] + summary["pending"] == 18
    assert report.long().filter("section = 'evaluation' AND metric = 'total'").first()["value"] == 400


def test_regression_metrics_of_a_constant(spark):
    df = spark.createDataFrame([(2.0, 1.0), (2.0, 3.0)], "label double, prediction double")
    row = metrics.regression_metrics(df).first()
    assert row["r2"] is None and row["mae"] == 1.0 and row["mape"] == 0.5
