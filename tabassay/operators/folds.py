"""Fold numbers for cross-validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabassay.functions.missing import quoted
from tabassay.operators.prefix import order_position, ordered_position
from tabassay.sources.sampling import key_hash


def hash_folds(df: DataFrame, key: str, k: int, seed: int = 7, name: str = "fold") -> DataFrame:
    """A fold from the row key alone: no shuffle, sizes equal up to chance."""
    slice_ = F.pmod(F.floor(key_hash(df, key, seed) / F.lit(1024)), F.lit(k))
    return df.withColumn(name, slice_.cast("int"))


def rank_folds(
    df: DataFrame,
    key: str,
    k: int,
    stratify: str | None = None,
    name: str = "fold",
    **options: int,
) -> DataFrame:
    """Contiguous folds in key order, within each class when stratified.

    Text keys are taken in the order of their hash, which spreads over all chunks. Sizes differ by at most one. Places come from chunked running counts, so a class
    that holds most of the rows is not gathered into one task.
    """
    by = [stratify] if stratify else []
    order, position = [quoted(key)], None
    if isinstance(df.schema[key].dataType, (T.StringType, T.BinaryType)):
        hashed = F.xxhash64(quoted(key))
        order, position = [hashed, quoted(key)], hashed.cast("double")
    placed = ordered_position(
        df, by, order, order_position(df, key) if position is None else position, "__place",
        group_totals=True, **options,
    )
    place, size = F.col("__place") - 1, F.col("__place_total")
    small = F.floor(size / k)
    large_rows = (size % k) * (small + 1)
    fold = F.when(place < large_rows, F.floor(place / (small + 1))).otherwise(
        size % k + F.floor(F.try_divide(place - large_rows, small))
    )
    return placed.select(*[quoted(c) for c in df.columns], fold.cast("int").alias(name))
