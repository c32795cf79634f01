"""Full exploratory analysis of one table."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabassay.functions.families import columns_of, require_column
from tabassay.functions.missing import normalize_missing
from tabassay.operators import correlation as corr
from tabassay.operators import outliers as out
from tabassay.operators import profile as prof
from tabassay.operators import quality as qual
from tabassay.operators.frames import one_row_per, settle, to_frame

LONG_SCHEMA = "section string, item string, metric string, value double, text string"


@dataclass
class EdaReport:
    """One DataFrame per section, each small: a few rows per column of the table."""

    dataset_info: DataFrame
    histogram: DataFrame
    categorical: DataFrame
    top_values: DataFrame
    missing_summary: DataFrame
    missing_per_column: DataFrame
    outliers: DataFrame
    outlier_ids: DataFrame | None
    correlation: DataFrame
    strong_correlations: DataFrame
    features: DataFrame | None
    quality: DataFrame
    recommendations: DataFrame
    insights: DataFrame
    summary: DataFrame

    def section(self, name: str) -> DataFrame:
        return getattr(self, name)

    def long(self) -> DataFrame:
        """All sections as rows ``(section, item, metric, value, text)``."""
        items = {
            "histogram": "column_name",
            "categorical": "column_name",
            "missing_per_column": "column_name",
            "outliers": "column_name",
        }
        parts = [
            _long(self.section(s), s, items.get(s))
            for s in (
                "dataset_info", "histogram", "categorical", "missing_summary",
                "missing_per_column", "outliers", "quality", "summary",
            )
        ]
        parts.append(
            self.correlation.select(
                F.lit("correlation").alias("section"),
                F.concat_ws("|", "feature1", "feature2").alias("item"),
                F.lit("correlation").alias("metric"),
                F.col("correlation").alias("value"),
                F.lit(None).cast("string").alias("text"),
            )
        )
        parts.append(
            self.top_values.select(
                F.lit("top_values").alias("section"),
                F.col("column_name").alias("item"),
                F.concat(F.lit("rank_"), F.col("rnk").cast("string")).alias("metric"),
                F.col("cnt").cast("double").alias("value"),
                F.col("value").alias("text"),
            )
        )
        return reduce(DataFrame.unionByName, parts)


def _long(df: DataFrame, section: str, item: str | None) -> DataFrame:
    """Unpivot a small result; numbers go to ``value`` and strings to ``text``."""
    rows = []
    for f in df.schema:
        if f.name == item:
            continue
        name = f"`{f.name}`"
        value, text = f"CAST({name} AS DOUBLE)", "CAST(NULL AS STRING)"
        if isinstance(f.dataType, T.StringType):
            value, text = "CAST(NULL AS DOUBLE)", name
        rows.append(f"'{f.name}', {value}, {text}")
    return df.selectExpr(
        f"'{section}' AS section",
        f"{item or "''"} AS item",
        f"stack({len(rows)}, {', '.join(rows)}) AS (metric, value, text)",
    )


def store_analysis(report: EdaReport, eda_id: str, path: str) -> None:
    """Write an analysis as rows of a result table, partitioned by analysis and section.

    Storing an ``eda_id`` again replaces that analysis whole, and no other one: sections
    that it no longer has go too.
    """
    if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", eda_id):
        raise ValueError(f"'{eda_id}' cannot name an analysis")
    rows = report.long().repartition("section")
    rows.write.mode("overwrite").partitionBy("section").parquet(f"{path}/eda_id={eda_id}")


def read_section(spark: SparkSession, path: str, eda_id: str, section: str) -> DataFrame:
    """One section of a stored analysis; only its own folder is read."""
    schema = "item string, metric string, value double, text string, eda_id string, section string"
    rows = spark.read.schema(schema).parquet(path)
    return rows.filter((F.col("eda_id") == eda_id) & (F.col("section") == section))


def stored_sections(spark: SparkSession, path: str) -> DataFrame:
    """Which analyses and sections a result table holds, from its partitions."""
    return spark.read.parquet(path).select("eda_id", "section").distinct()


def analyze(df: DataFrame, key: str | None = None, target: str | None = None) -> EdaReport:
    """Profile ``df`` with a fixed number of scans, whatever its size.

    Moments, missing counts, sizes and quantile sketches share the first scan, the
    quartiles take two more, outlier counts one and correlations one. Two shuffles
    remain, of hashes: string value counts and whole-row duplicates. ``key`` names the unique row
    key; it is left out of the analysis and used to list outlying rows.
    """
    if target is not None:
        require_column(df, target)
    if key is not None:
        require_column(df, key)
    spark = df.sparkSession
    df = normalize_missing(df)
    body = df.drop(key) if key else df
    facts = prof.numeric_facts(
        body,
        table_aggregates=[
            *prof.summary_aggregates(body),
            prof.bytes_aggregate(body).alias("bytes"),
        ],
    )
    kinds = ", ".join(f"`{k}` bigint" for k in facts.table)
    base = to_frame(spark, [tuple(facts.table.values())], kinds)
    rows = facts.table["rows"]

    bounds = out.outlier_bounds(facts)
    if bounds:
        outlier_row = body.agg(F.lit(rows).alias("rows"), *out.outlier_aggregates(body, bounds))
        outlier_table = settle(out.outliers_of(body, bounds, outlier_row))
    else:
        outlier_table = out.outliers_of(body, bounds, base)
    total_outliers = outlier_table.agg(
        F.coalesce(F.sum("outlier_count"), F.lit(0)).alias("outlier_count")
    )

    numeric = columns_of(body, "numeric")
    if len(numeric) > 1:
        matrix = corr.correlation_matrix(body, numeric)
    else:
        matrix = to_frame(spark, [], corr.PAIR_SCHEMA)
    strong = corr.strong_pairs_of(matrix, numeric)
    features = None
    if target is not None:
        others = [c for c in numeric if c != target]
        features = corr.feature_target_rank(body, target, others)

    counts = prof.hashed_counts(body).persist()
    tops = settle(prof.top_texts(body, counts))
    categorical = settle(prof.categorical_profile(body, counts, rows, tops))
    counts.unpersist()

    missing = prof.missing_summary_of(body, base)
    per_column = one_row_per(
        base,
        [
            F.struct(
                F.lit(n).alias("column_name"),
                F.col(f"missing_{i}").alias("missing_count"),
                prof.percent(F.col(f"missing_{i}"), F.col("rows")).alias("missing_percentage"),
            )
            for i, n in enumerate(body.columns)
        ],
    ).filter(F.col("missing_count") > 0)

    copies = settle(qual.duplicates(body))
    quality = settle(qual.quality_score(missing, copies, total_outliers))
    found = settle(qual.insights(per_column, copies, strong, outlier_table, categorical))
    return EdaReport(
        dataset_info=prof.dataset_info_of(body, base),
        histogram=prof.numeric_profile(body, facts),
        categorical=categorical,
        top_values=tops,
        missing_summary=missing,
        missing_per_column=per_column,
        outliers=outlier_table,
        outlier_ids=out.outlier_ids(df, key, bounds) if key else None,
        correlation=matrix,
        strong_correlations=strong,
        features=features,
        quality=quality,
        recommendations=qual.recommendations(quality),
        insights=found,
        summary=qual.executive_summary(quality, found, len(body.columns)),
    )
