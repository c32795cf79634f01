"""Duplicates, the quality score, recommendations, insights and the executive summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabassay.functions.hashes import row_hashes
from tabassay.functions.scalars import band
from tabassay.functions.stats import percent

# The advice given, in order, the score bands and the severities.
HIGH_MISSING = "High missing data: Consider imputation or removal"
MODERATE_MISSING = "Moderate missing data: Review and handle missing values"
LOW_QUALITY = "Data quality is below optimal: Consider data cleaning"
GOOD_QUALITY = "Data quality is good - proceed with analysis"
BANDS = ((90.0, "Excellent"), (75.0, "Good"), (50.0, "Fair"))
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def duplicates(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of identical rows, nulls being equal.

    Rows travel as 128-bit hashes of all their columns. Copies are counted before the
    shuffle, so a row repeated in a third of the table travels once per task.
    """
    hashed = df.select(*row_hashes(df))
    copies = hashed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("__n"))
    return copies.agg(
        F.coalesce(F.sum("__n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicate_rows"),
    ).withColumn("duplicate_percentage", percent(F.col("duplicate_rows"), F.col("total_rows")))


def quality_score(missing: DataFrame, copies: DataFrame, outlier_count: DataFrame) -> DataFrame:
    """Completeness, uniqueness, their mean and its band, from one-row results."""
    missing_share = F.col("total_missing_percentage")
    completeness = F.when(missing_share.isNotNull(), F.greatest(F.lit(0.0), 100.0 - missing_share))
    uniqueness = 100.0 - F.col("duplicate_percentage")
    score = (F.col("completeness") + F.col("uniqueness")) / 2
    return (
        missing.select("total_missing_percentage")
        .crossJoin(copies.select("duplicate_rows", "duplicate_percentage"))
        .crossJoin(outlier_count.select("outlier_count"))
        .withColumns({"completeness": completeness, "uniqueness": uniqueness})
        .select(
            score.alias("overall_score"),
            F.when(score.isNotNull(), band(score, BANDS, "Poor")).alias("assessment"),
            "completeness",
            "uniqueness",
            F.col("total_missing_percentage").alias("missing_percentage"),
            "duplicate_rows",
            "duplicate_percentage",
            "outlier_count",
        )
    )


def recommendations(quality: DataFrame) -> DataFrame:
    """Ordered advice, one row per message."""
    missing = F.col("missing_percentage")
    advice = F.filter(
        F.array(
            F.when(missing > 30, HIGH_MISSING).when(missing > 10, MODERATE_MISSING),
            F.when(F.col("assessment").isin("Poor", "Fair"), LOW_QUALITY),
        ),
        lambda x: x.isNotNull(),
    )
    fine = F.array(F.lit(GOOD_QUALITY))
    return quality.select(
        F.posexplode(F.when(F.size(advice) > 0, advice).otherwise(fine)).alias(
            "position", "recommendation"
        )
    )


def _insight(source: DataFrame, severity: Column, title: Column, column: Column, value: Column):
    return source.select(
        severity.alias("severity"),
        title.alias("title"),
        column.cast("string").alias("column_name"),
        value.cast("double").alias("value"),
    ).filter(F.col("severity").isNotNull())


def insights(
    missing: DataFrame,
    copies: DataFrame,
    strong: DataFrame,
    outlier_table: DataFrame,
    categories: DataFrame,
) -> DataFrame:
    """Findings with a severity, most severe first and then by title."""
    name = F.col("column_name")
    share, dup = F.col("missing_percentage"), F.col("duplicate_percentage")
    out, distinct = F.col("outlier_percentage"), F.col("unique_values")
    parts = [
        _insight(
            missing,
            F.when(share >= 100, "CRITICAL").when(share > 30, "HIGH").when(share > 10, "MEDIUM"),
            F.when(share >= 100, F.concat(F.lit("Column is empty: "), name)).otherwise(
                F.concat(F.lit("Missing values in "), name)
            ),
            name,
            share,
        ),
        _insight(
            copies,
            F.when(dup > 10, "HIGH").when(dup > 0, "LOW"),
            F.lit("Duplicate rows"),
            F.lit(None),
            dup,
        ),
        _insight(
            strong,
            F.lit("MEDIUM"),
            F.concat(
                F.lit("Strong correlation: "), F.col("feature1"), F.lit(" and "), F.col("feature2")
            ),
            F.col("feature1"),
            F.col("correlation"),
        ),
        _insight(
            outlier_table,
            F.when(out > 5, "MEDIUM").when(out > 0, "LOW"),
            F.concat(F.lit("Outliers in "), name),
            name,
            out,
        ),
        _insight(
            categories,
            F.when(distinct > 50, "LOW"),
            F.concat(F.lit("Many distinct values in "), name),
            name,
            distinct,
        ),
    ]
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    return reduce(DataFrame.unionByName, parts).orderBy(rank, "title")


def insight_totals(found: DataFrame) -> DataFrame:
    """Insights in total and per severity."""
    return found.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES],
    )


def executive_summary(quality: DataFrame, found: DataFrame, features: int) -> DataFrame:
    """One row: score, dimensions, insight counts, top concern and first advice."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity"))
    concern = found.agg(F.min_by("title", F.struct(rank, F.col("title"))).alias("top_concern"))
    first = recommendations(quality).filter(F.col("position") == 0).select("recommendation")
    return (
        quality.select(
            F.col("overall_score").alias("quality_score"), "assessment", "completeness", "uniqueness"
        )
        .crossJoin(insight_totals(found))
        .crossJoin(concern)
        .crossJoin(first)
        .select(
            "quality_score",
            "assessment",
            "completeness",
            "uniqueness",
            F.lit(features).cast("bigint").alias("features"),
            F.col("total").alias("insights_count"),
            F.col("critical").alias("issues_critical"),
            F.col("high").alias("issues_high"),
            F.col("medium").alias("issues_medium"),
            "top_concern",
            "recommendation",
        )
    )
