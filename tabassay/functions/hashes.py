"""128-bit hashes of values and rows, in place of the values as shuffle keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabassay.functions.missing import quoted


def hash_input(field: T.StructField) -> Column:
    """The column in a form in which equal values hash alike.

    Zeros lose their sign and NaN is one value, as when grouping; nested values go as
    JSON, because a hash passes over nulls inside them.
    """
    c = quoted(field.name)
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return F.nanvl(c.cast("double"), F.lit(float("nan"))) + F.lit(0.0)
    if isinstance(field.dataType, (T.ArrayType, T.StructType)):
        return F.when(c.isNotNull(), F.to_json(F.struct(c), {"ignoreNullFields": "false"}))
    return c


def two_hashes(values: Sequence[Column]) -> list[Column]:
    """Two independent 64-bit hashes; nulls count, in their place."""
    parts = [x for v in values for x in (v, v.isNull())]
    return [F.xxhash64(F.lit(1), *parts).alias("h1"), F.xxhash64(F.lit(2), *parts).alias("h2")]


def row_hashes(df: DataFrame) -> list[Column]:
    return two_hashes([hash_input(f) for f in df.schema])
