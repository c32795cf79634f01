"""ROC and precision-recall curves and their areas, from a score histogram.

Rows are first counted per distinct score, so tied scores form one point and hot scores
shrink before the shuffle; the running counts over the histogram are chunked by score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabassay.functions.scores import settled
from tabassay.functions.stats import ratio
from tabassay.operators.prefix import ROWS_PER_CHUNK, chunk_edges, running


def score_histogram(
    scored: DataFrame, by: Sequence[str] = (), label: str = "y", score: str = "p"
) -> DataFrame:
    """Positives and negatives per distinct score; NaN is no score."""
    return (
        settled(scored, label, score).filter(F.col(label).isNotNull() & F.col(score).isNotNull())
        .groupBy(*by, F.col(score).alias("p"))
        .agg(
            F.count_if(F.col(label) == 1).alias("pos"),
            F.count_if(F.col(label) != 1).alias("neg"),
        )
    )


def cumulative(
    scored: DataFrame, by: Sequence[str] = (), rows_per_chunk: int = ROWS_PER_CHUNK
) -> DataFrame:
    """True and false positives when every score of at least ``p`` is called positive.

    One row per distinct score; ``tp_total`` and ``fp_total`` are all positives and
    negatives of the model. Chunk edges come from the rows, before any shuffle.
    """
    return running(
        score_histogram(scored, by),
        by,
        [F.col("p").desc()],
        -F.col("p"),
        sums={"tp": F.col("pos"), "fp": F.col("neg")},
        group_totals=True,
        edges=chunk_edges(settled(scored), -F.col("p").cast("double"), rows_per_chunk),
    )


def roc_of(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC points from cumulative ones: threshold, false and true positive rate."""
    return points.select(
        *by,
        F.col("p").alias("threshold"),
        ratio(F.col("fp"), F.col("fp_total")).alias("fpr"),
        ratio(F.col("tp"), F.col("tp_total")).alias("tpr"),
    )


def pr_of(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision-recall points from cumulative ones: threshold, precision and recall."""
    return points.select(
        *by,
        F.col("p").alias("threshold"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("tp_total")).alias("recall"),
    )


def roc_curve(scored: DataFrame, by: Sequence[str] = (), **options: int) -> DataFrame:
    return roc_of(cumulative(scored, by, **options), by)


def pr_curve(scored: DataFrame, by: Sequence[str] = (), **options: int) -> DataFrame:
    return pr_of(cumulative(scored, by, **options), by)


def area_aggregates() -> list[Column]:
    """Sums over cumulative points that make up the areas and the class totals."""
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    return [
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.sum(neg * (F.col("tp") - pos / 2)).alias("__wins"),
        F.sum(pos * ratio(F.col("tp"), F.col("tp") + F.col("fp"))).alias("__precision"),
    ]


def area_columns() -> dict[str, Column]:
    """ROC AUC, ties between classes counting half, and average precision.

    Both are null when a class is absent.
    """
    both = F.col("positives").cast("double") * F.col("negatives")
    return {
        "auc_roc": ratio(F.col("__wins"), both),
        "average_precision": ratio(F.col("__precision"), F.col("positives")),
    }


def areas_of(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve and average precision from cumulative points."""
    sums = points.groupBy(*by).agg(*area_aggregates())
    return sums.select(*by, *[c.alias(n) for n, c in area_columns().items()])


def auc_ap(scored: DataFrame, by: Sequence[str] = (), **options: int) -> DataFrame:
    return areas_of(cumulative(scored, by, **options), by)
