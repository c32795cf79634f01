"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Hashable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabassay.session import enable_checkpoints

BATCH_ROWS = 1000

_REMEMBERED: dict[Hashable, Any] = {}


def remembered(key: Hashable, make: Callable[[], Any]) -> Any:
    """What a Python worker made for ``key``; it remembers one thing at a time.

    Workers live on from one operator to the next, so that what an operator has built up
    goes when another one asks.
    """
    if key not in _REMEMBERED:
        _REMEMBERED.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Arrow batches of few rows, as one text can hold megabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there."""
    enable_checkpoints(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def chunks_for(rows: int, rows_per_chunk: int = 100_000, least: int = 128) -> int:
    """How many chunks a hot group is dealt into."""
    return max(least, -(-rows // rows_per_chunk))


def rank_in_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], chunks: int, name: str
) -> DataFrame:
    """``df`` with the gapless rank from 0 of each row in its group.

    No window holds a whole group: a group is dealt into ``chunks`` by a hash of
    ``order``, rows are numbered inside (group, chunk), and the sizes of the
    earlier chunks are added. ``order`` must tell rows apart. Null keys are a
    group of their own.
    """
    part, before = fresh(df, "chunk_no"), fresh(df, "rows_before")
    size, within = fresh(df, "chunk_rows"), fresh(df, "row_in_chunk")
    keyed = df.withColumn(part, F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    earlier = Window.partitionBy(*keys).orderBy(part)
    sizes = (
        keyed.groupBy(*keys, part)
        .agg(F.count(F.lit(1)).alias(size))
        .withColumn(before, F.sum(size).over(earlier) - F.col(size))
        .drop(size)
    )
    inside = Window.partitionBy(*keys, part).orderBy(*order)
    numbered = keyed.withColumn(within, F.row_number().over(inside) - 1)
    other = sizes.select(*[F.col(k).alias(f"{k}__r") for k in (*keys, part)], before)
    same: Column = F.lit(True)
    for key in (*keys, part):
        same &= numbered[key].eqNullSafe(other[f"{key}__r"])
    return numbered.join(other, same).select(
        *[numbered[c] for c in df.columns], (F.col(within) + F.col(before)).alias(name)
    )
