"""Turning bounded statistics into DataFrames and back."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ARROW = {
    T.StringType: pa.string(),
    T.LongType: pa.int64(),
    T.IntegerType: pa.int32(),
    T.DoubleType: pa.float64(),
    T.BooleanType: pa.bool_(),
}

AGGREGATES_PER_SCAN = 90  # buffers beyond about 100 would leave compiled code
#: Rows of training that are worth a task.
ROWS_PER_TASK = 25_000
TASK = "__task"


def aggregate(
    df: DataFrame, exprs: Sequence[Column], per_scan: int = AGGREGATES_PER_SCAN
) -> dict[str, Any]:
    """Values of aliased aggregates by alias; very many are spread over several scans."""
    out: dict[str, Any] = {}
    for start in range(0, len(exprs), per_scan):
        out.update(df.agg(*exprs[start : start + per_scan]).first().asDict())
    return out


def to_frame(spark: SparkSession, rows: Sequence[tuple], schema: str | T.StructType) -> DataFrame:
    """A small frame from driver-side statistics (one row per column, model or rule).

    Through Arrow it becomes a local relation, so selecting from it starts no job.
    """
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    if not all(type(f.dataType) in _ARROW for f in fields):
        return spark.createDataFrame(list(rows), fields).coalesce(1)
    arrays = [
        pa.array([row[i] for row in rows], _ARROW[type(f.dataType)]) for i, f in enumerate(fields)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, names=fields.names))


def settle(df: DataFrame) -> DataFrame:
    """Compute a result of at most a few rows per column once, for repeated use."""
    return to_frame(df.sparkSession, [tuple(r) for r in df.collect()], df.schema)


def one_row_per(row: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Turn a one-row aggregate into one row per struct."""
    return row.select(F.inline(F.array(*structs)))


def spread(rows: DataFrame, count: int, tasks: int) -> DataFrame | None:
    """Rows that lie in fewer tasks than run at once, dealt out and persisted.

    A file of one row group is read by one task, and every pass of a learner would be that
    task's. Nothing where the rows lie in enough tasks or are not worth more.
    """
    at_once = rows.sparkSession.sparkContext.defaultParallelism
    wanted = min(at_once, -(-count // ROWS_PER_TASK))
    return rows.repartition(wanted).persist() if wanted > tasks else None
