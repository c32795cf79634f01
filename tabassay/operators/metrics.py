"""Metrics of scored rows: threshold metrics, class reports and regression errors.

All are one partial aggregation of the scored rows; ``by`` evaluates many models at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabassay.functions.scores import settled
from tabassay.functions.stats import ratio
from tabassay.operators.curves import area_aggregates, area_columns, cumulative


def confusion_aggregates(threshold: float, inside: Column | None = None) -> list[Column]:
    """Counts of the four outcomes; a score equal to the threshold is positive.

    ``inside`` restricts the count to some rows, so that several parts share a scan.
    """
    y, hit = F.col("y") == 1, F.col("p") >= threshold
    if inside is not None:
        y, hit = F.when(inside, y), F.when(inside, hit)
    return [
        F.count_if(~y & ~hit).alias("tn"),
        F.count_if(~y & hit).alias("fp"),
        F.count_if(y & ~hit).alias("fn"),
        F.count_if(y & hit).alias("tp"),
        F.count_if(y.isNotNull() & hit.isNotNull()).alias("total"),
    ]


def confusion(scored: DataFrame, threshold: float = 0.5, by: Sequence[str] = ()) -> DataFrame:
    return settled(scored).groupBy(*by).agg(*confusion_aggregates(threshold))


def metric_columns() -> dict[str, Column]:
    """Accuracy, precision, recall and F1 from tn, fp, fn, tp; 0 where undefined."""
    tn, fp, fn, tp, total = (F.col(c) for c in ("tn", "fp", "fn", "tp", "total"))
    zero = F.lit(0.0)
    return {
        "accuracy": ratio(tp + tn, total),
        "precision": F.coalesce(ratio(tp, tp + fp), zero),
        "recall": F.coalesce(ratio(tp, tp + fn), zero),
        "f1_score": F.coalesce(ratio(2 * tp, 2 * tp + fp + fn), zero),
    }


def rate_columns() -> dict[str, Column]:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    zero = F.lit(0.0)
    return {
        "false_positive_rate": F.coalesce(ratio(fp, fp + tn), zero),
        "false_negative_rate": F.coalesce(ratio(fn, fn + tp), zero),
        "true_positive_rate": F.coalesce(ratio(tp, fn + tp), zero),
        "true_negative_rate": F.coalesce(ratio(tn, fp + tn), zero),
    }


def imbalance_columns() -> dict[str, Column]:
    zero, one = F.col("tn") + F.col("fp"), F.col("fn") + F.col("tp")
    times = ratio(F.greatest(zero, one), F.least(zero, one))
    return {
        "class_0_count": zero,
        "class_1_count": one,
        "imbalance_ratio": times,
        "class_distribution": F.when(times <= 1.5, "balanced")
        .when(times <= 3, "slightly_imbalanced")
        .otherwise("imbalanced"),
    }


def evaluation_columns(threshold: float) -> dict[str, Column]:
    """Everything said about a model at a threshold, from its counts and ROC AUC."""
    counts = {n: F.col(n) for n in ("tn", "fp", "fn", "tp", "total")}
    scores = metric_columns() | {"auc_roc": F.col("auc_roc")} | rate_columns()
    return {"threshold": F.lit(threshold)} | counts | scores | imbalance_columns()


def threshold_evaluation(
    scored: DataFrame, threshold: float = 0.5, by: Sequence[str] = (), **options: int
) -> DataFrame:
    """Confusion counts, metrics with ROC AUC, rates and class balance at a threshold.

    Outcomes and areas are sums over the same score histogram, so the rows are read once.
    """
    hit, zero = F.col("p") >= threshold, F.lit(0).cast("bigint")
    sums = (
        cumulative(scored, by, **options)
        .groupBy(*by)
        .agg(
            *area_aggregates(),
            F.sum(F.when(hit, F.col("pos")).otherwise(zero)).alias("tp"),
            F.sum(F.when(hit, F.col("neg")).otherwise(zero)).alias("fp"),
        )
    )
    counted = sums.withColumns(
        {
            "fn": F.col("positives") - F.col("tp"),
            "tn": F.col("negatives") - F.col("fp"),
            "total": F.col("positives") + F.col("negatives"),
            "auc_roc": area_columns()["auc_roc"],
        }
    )
    return counted.select(*by, *[c.alias(n) for n, c in evaluation_columns(threshold).items()])


def confusion_grid(
    predicted: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    by: Sequence[str] = (),
) -> DataFrame:
    """Rows per (actual, predicted) class pair."""
    return predicted.groupBy(
        *by, F.col(label).alias("actual"), F.col(prediction).alias("predicted")
    ).agg(F.count(F.lit(1)).alias("cnt"))


def per_class_report(
    predicted: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    by: Sequence[str] = (),
) -> DataFrame:
    """Precision, recall, F1 and support of every class against the rest."""
    grid = confusion_grid(predicted, label, prediction, by)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("cnt")).otherwise(0)
    none = F.lit(0).cast("bigint")
    sides = grid.select(
        *by,
        F.inline(
            F.array(
                F.struct(
                    F.col("actual").alias("class"), F.col("cnt").alias("support"),
                    none.alias("called"), hit.cast("bigint").alias("hits"),
                ),
                F.struct(
                    F.col("predicted").alias("class"), none.alias("support"),
                    F.col("cnt").alias("called"), none.alias("hits"),
                ),
            )
        ),
    )
    sums = sides.groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("called").alias("called"), F.sum("hits").alias("hits")
    )
    zero = F.lit(0.0)
    return sums.select(
        *by,
        "class",
        F.coalesce(ratio(F.col("hits"), F.col("called")), zero).alias("precision"),
        F.coalesce(ratio(F.col("hits"), F.col("support")), zero).alias("recall"),
        F.coalesce(ratio(2 * F.col("hits"), F.col("called") + F.col("support")), zero).alias("f1_score"),
        "support",
    )


def classification_metrics(
    predicted: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    by: Sequence[str] = (),
) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1."""
    report = per_class_report(predicted, label, prediction, by)
    weight, total = F.col("support").cast("double"), F.sum("support")
    # A class is recalled as often as it is hit, so weighted recall is the accuracy.
    return report.groupBy(*by).agg(
        ratio(F.sum(weight * F.col("recall")), total).alias("accuracy"),
        ratio(F.sum(weight * F.col("precision")), total).alias("precision"),
        ratio(F.sum(weight * F.col("recall")), total).alias("recall"),
        ratio(F.sum(weight * F.col("f1_score")), total).alias("f1_score"),
    )


def regression_metrics(
    predicted: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    by: Sequence[str] = (),
) -> DataFrame:
    """R2, absolute and squared errors, and the mean absolute percentage error."""
    predicted = settled(predicted, label, prediction)
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    y, p = F.when(p.isNotNull(), y), F.when(y.isNotNull(), p)
    error = y - p
    sums = predicted.groupBy(*by).agg(
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.var_pop(y).alias("__var"),
        F.avg(F.abs(F.try_divide(error, y))).alias("mape"),
    )
    return sums.select(
        *by,
        (1.0 - F.try_divide(F.col("mse"), F.col("__var"))).alias("r2"),
        "mae",
        "mse",
        F.sqrt("mse").alias("rmse"),
        "mape",
    )


def log_loss(y: Column, p: Column) -> Column:
    """Negative log likelihood of a row, with the score kept inside (0, 1)."""
    y = y.cast("double")
    p = F.least(F.lit(1 - 1e-15), F.greatest(F.lit(1e-15), p))
    return -(y * F.ln(p) + (1 - y) * F.ln(1 - p))


OVERFITTING = ((0.02, "none"), (0.05, "mild"), (0.10, "moderate"))


def learning_aggregates(threshold: float = 0.5, split: str = "split") -> list[Column]:
    """Loss and accuracy of the train and the test rows."""
    y, p = F.col("y"), F.col("p")
    exprs = []
    for part in ("test", "train"):
        inside = F.col(split) == part
        right = ((p >= threshold) == (y == 1)).cast("double")
        exprs += [
            F.avg(F.when(inside, log_loss(y, p))).alias(f"{part}_loss"),
            F.avg(F.when(inside, right)).alias(f"{part}_accuracy"),
        ]
    return exprs


def learning_curve(
    scored: DataFrame, threshold: float = 0.5, by: Sequence[str] = (), split: str = "split"
) -> DataFrame:
    """Loss and accuracy of train and test rows, their gap and how severe it is."""
    sums = settled(scored).groupBy(*by).agg(*learning_aggregates(threshold, split))
    return learning_curve_of(sums, by)


def learning_curve_of(row: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    gap = F.coalesce(F.col("train_accuracy") - F.col("test_accuracy"), F.lit(0.0))
    status = F.when(F.col("gap") <= OVERFITTING[0][0], OVERFITTING[0][1])
    for limit, name in OVERFITTING[1:]:
        status = status.when(F.col("gap") <= limit, name)
    return (
        row.select(*by, "test_loss", "test_accuracy", "train_loss", "train_accuracy")
        .withColumn("gap", gap)
        .withColumn("overfitting_status", status.otherwise("severe"))
    )

