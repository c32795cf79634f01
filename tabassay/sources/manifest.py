"""A table of datasets, and first looks at one."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabassay.functions.families import require_column
from tabassay.functions.missing import quoted
from tabassay.sources.readers import read_any


def manifest_row(df: DataFrame, dataset_id: str, name: str, path: str) -> DataFrame:
    """One row: identity, row count, columns and types. Counting reads no column."""
    types = [F.lit(x) for pair in df.dtypes for x in pair]
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(dataset_id).alias("dataset_id"),
        F.lit(name).alias("name"),
        F.lit(path).alias("path"),
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
        F.create_map(*types).alias("dtypes"),
    )


def manifest(spark: SparkSession, paths: Mapping[str, str]) -> DataFrame:
    """Manifest rows of several datasets, named by their keys."""
    rows = [manifest_row(read_any(spark, p), n, n, p) for n, p in paths.items()]
    return reduce(DataFrame.unionByName, rows)


def register(df: DataFrame, dataset_id: str, name: str, path: str, table_path: str) -> None:
    """Append a dataset to the manifest table."""
    manifest_row(df, dataset_id, name, path).write.mode("append").parquet(table_path)


def list_datasets(table: DataFrame) -> DataFrame:
    """Every dataset with the number of datasets."""
    return table.crossJoin(table.agg(F.count(F.lit(1)).alias("total")))


def dataset_details(
    df: DataFrame, dataset_id: str, name: str, path: str, key: str, rows: int = 5
) -> DataFrame:
    """The manifest row of a dataset with ``sample``, its first rows in key order as JSON."""
    first = preview(df, key, rows).select(F.struct(*[quoted(c) for c in df.columns]).alias("r"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("r")[key].alias("k"), "r")))
    sample = first.agg(F.transform(ordered, lambda x: F.to_json(x["r"])).alias("sample"))
    return manifest_row(df, dataset_id, name, path).crossJoin(sample)


def preview(df: DataFrame, key: str, rows: int = 10) -> DataFrame:
    """The first ``rows`` rows in key order."""
    require_column(df, key)
    return df.orderBy(quoted(key)).limit(rows)
