"""Ranking of algorithm results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rank_leaderboard(results: DataFrame, order: str = "algo_order") -> DataFrame:
    """Rank by rounded score, earlier results first on ties. One row per algorithm."""
    w = Window.partitionBy(F.lit(0)).orderBy(F.round("score", 4).desc_nulls_last(), order)
    return results.withColumn("rank", F.row_number().over(w))


def best_algorithm(results: DataFrame, order: str = "algo_order") -> DataFrame:
    """The algorithm with the strictly greatest unrounded score; NaN never wins."""
    usable = results.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    return usable.agg(
        F.max_by("algorithm", F.struct(F.col("score"), -F.col(order))).alias("best_algorithm"),
        F.max("score").alias("best_score"),
    )


def total_time(results: DataFrame) -> DataFrame:
    return results.agg(
        F.round(F.sum("training_time_seconds"), 2).alias("total_training_time_seconds")
    )
