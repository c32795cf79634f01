"""Feature importance against the target, and the production-readiness checklist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabassay.functions.scalars import band
from tabassay.functions.stats import percent, ratio
from tabassay.operators.correlation import target_correlations
from tabassay.operators.frames import to_frame

STRENGTHS = ((0.7, "strong"), (0.4, "moderate"))


def importance_with_correlation(
    scored: DataFrame, features: Sequence[str], target: str = "y"
) -> DataFrame:
    """Features ranked by absolute correlation with the target, with shares and strength."""
    strength = F.abs("correlation")
    everything = Window.partitionBy(F.lit(0))
    order = everything.orderBy(F.col("importance_score").desc(), "name")
    return (
        target_correlations(scored, target, features)
        .select(
            F.col("feature").alias("name"),
            F.coalesce("correlation", F.lit(0.0)).alias("correlation_with_target"),
            F.coalesce(strength, F.lit(0.0)).alias("importance_score"),
        )
        .select(
            F.row_number().over(order).alias("rank"),
            "name",
            "importance_score",
            F.coalesce(
                percent(F.col("importance_score"), F.sum("importance_score").over(everything)),
                F.lit(0.0),
            ).alias("importance_percent"),
            "correlation_with_target",
            band(F.col("importance_score"), STRENGTHS, "weak").alias("correlation_strength"),
        )
    )


def importance_summary(importance: DataFrame) -> DataFrame:
    return importance.agg(
        F.coalesce(F.sum(F.when(F.col("rank") <= 3, F.col("importance_percent"))), F.lit(0.0)).alias(
            "top_3_importance_percent"
        ),
        F.count(F.lit(1)).alias("total_features"),
        F.count_if(F.col("correlation_strength") == "strong").alias("strong_correlations"),
    )


# The 18 criteria as category, name, metric, direction and limit.
RULES = (
    ("Performance", "AUC-ROC Threshold", "auc_roc", ">=", 0.95),
    ("Performance", "Accuracy Threshold", "accuracy", ">=", 0.85),
    ("Performance", "Precision Threshold", "precision", ">=", 0.80),
    ("Performance", "Recall Threshold", "recall", ">=", 0.80),
    ("Performance", "F1 Threshold", "f1_score", ">=", 0.80),
    ("Error Rates", "False Positive Rate", "false_positive_rate", "<=", 0.10),
    ("Error Rates", "False Negative Rate", "false_negative_rate", "<=", 0.20),
    ("Error Rates", "True Negative Rate", "true_negative_rate", ">=", 0.90),
    ("Generalisation", "Train-Test Gap", "gap", "<=", 0.05),
    ("Generalisation", "Overfitting Severity", "overfitting_severity", "<=", 1.0),
    ("Generalisation", "Test Loss", "test_loss", "<=", 0.50),
    ("Data", "Sample Size", "total", ">=", 1000.0),
    ("Data", "Class Balance", "imbalance_ratio", "<=", 3.0),
    ("Business", "Net Profit", "net_profit", ">", 0.0),
    ("Business", "Return", "roi_improvement_percent", ">", 0.0),
    ("Business", "Approval Rate", "approval_rate", ">", 0.0),
    ("Features", "Feature Concentration", "top_3_importance_percent", "<=", 80.0),
    ("Features", "Strong Correlations", "strong_correlations", ">=", 1.0),
)
RULE_SCHEMA = "category string, name string, metric string, direction string, limit double"

SEVERITY = {"none": 0.0, "mild": 1.0, "moderate": 2.0, "severe": 3.0}


def rules(spark: SparkSession) -> DataFrame:
    return to_frame(spark, RULES, RULE_SCHEMA)


def overfitting_severity(status: str = "overfitting_status"):
    out = F.lit(None).cast("double")
    for name, index in SEVERITY.items():
        out = F.when(F.col(status) == name, index).otherwise(out)
    return out


def readiness(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Judge rows ``(by.., metric, value)``: every criterion passes, fails or is pending.

    The checklist has a fixed 18 rows and is the broadcast side.
    """
    checklist = F.broadcast(rules(metrics.sparkSession))
    models = metrics.select(*by).distinct() if by else None
    expected = models.crossJoin(checklist) if by else checklist
    judged = expected.join(metrics.select(*by, "metric", "value"), [*by, "metric"], "left")
    value, limit = F.col("value"), F.col("limit")
    met = (
        F.when(F.col("direction") == ">=", value >= limit)
        .when(F.col("direction") == "<=", value <= limit)
        .otherwise(value > limit)
    )
    status = F.when(value.isNull(), "pending").when(met, "pass").otherwise("fail")
    details = F.concat(
        F.col("metric"),
        F.lit(": "),
        F.coalesce(F.format_string("%.3f", value), F.lit("not available")),
        F.lit(" (target: "),
        F.col("direction"),
        F.lit(" "),
        F.format_string("%.2f", limit),
        F.lit(")"),
    )
    return judged.select(*by, "category", "name", "metric", status.alias("status"), details.alias("details"))


def readiness_summary(criteria: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts, pass rate, overall status, advice and a time estimate."""
    counts = criteria.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_criteria"),
        F.count_if(F.col("status") == "pass").alias("passed"),
        F.count_if(F.col("status") == "fail").alias("failed"),
        F.count_if(F.col("status") == "pending").alias("pending"),
    )
    rate = ratio(F.col("passed"), F.col("total_criteria")) * 100
    failed = F.col("failed")
    return counts.select(
        *by,
        "total_criteria",
        "passed",
        "failed",
        "pending",
        F.round(rate, 1).alias("pass_rate"),
        F.when(F.col("passed") == F.col("total_criteria"), "ready")
        .when(rate < 60, "not_ready")
        .otherwise("pending")
        .alias("overall_status"),
        F.when(failed == 0, "Ready for deployment")
        .otherwise(F.concat(F.lit("Fix "), failed.cast("string"), F.lit(" failing criteria before deployment")))
        .alias("deployment_recommendation"),
        F.when(failed == 0, "Immediate")
        .when(failed <= 3, "1-2 days")
        .otherwise("1-2 weeks")
        .alias("estimated_time_to_production"),
    )
