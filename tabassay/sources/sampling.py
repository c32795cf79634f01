"""Samples and splits that depend on the row key alone, never on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabassay.functions.families import require_column
from tabassay.functions.missing import quoted
from tabassay.operators.selection import kth_smallest

# The multiplier and modulus of the key hash, shared with the SQL checks.
MULTIPLIER = 2654435761
MODULUS = 4294967296
KEY_RANGE = 2147483648
HIGH_MULTIPLIER = 40503


def key_hash(df: DataFrame, key: str, seed: int = 42) -> Column:
    """A hash in ``[0, 2^32)``; integral keys use arithmetic any SQL engine repeats.

    The high bits of a key are folded into the low ones before the multiplication, so
    keys that differ in either spread alike.
    """
    c = quoted(key)
    if isinstance(df.schema[key].dataType, T.IntegralType):
        whole = c.cast("bigint")
        high = F.pmod(F.shiftright(whole, 31), F.lit(KEY_RANGE))
        low = F.pmod(whole, F.lit(KEY_RANGE)) + high * F.lit(HIGH_MULTIPLIER)
        folded = F.pmod(low, F.lit(KEY_RANGE))
        return F.pmod(folded * F.lit(MULTIPLIER) + F.lit(seed), F.lit(MODULUS))
    return F.pmod(F.xxhash64(c, F.lit(seed)), F.lit(MODULUS))


def _hash_edge(df: DataFrame, h: Column, n: int, total: int) -> tuple[int, int, int]:
    """The hash of the n-th lowest row, and the rows below it and on it.

    It is found by counting, so no row is sorted or moved.
    """
    edge = int(kth_smallest(df, h.cast("double"), n - 1, total))
    row = df.agg(F.count_if(h < edge).alias("below"), F.count_if(h == edge).alias("equal")).first()
    return edge, row["below"], row["equal"]


def lowest_hashed(df: DataFrame, key: str, n: int, total: int, seed: int = 42) -> Column:
    """A condition true for the ``n`` rows lowest by (hash, key).

    Rows that share a key stay together, so ``n`` is met exactly when keys are unique.
    """
    if n <= 0 or n >= total:
        return F.lit(n > 0)
    h = key_hash(df, key, seed)
    edge, below, equal = _hash_edge(df, h, n, total)
    if n - below == equal:
        return h <= edge
    tied = df.filter(h == edge).select(quoted(key).alias("k")).distinct()
    last = tied.orderBy("k").limit(n - below).agg(F.max("k")).first()[0]
    return (h < edge) | ((h == edge) & (quoted(key) <= F.lit(last)))


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows chosen by key hash, or all rows when there are no more than ``n``.

    Only rows on the last hash are ordered; with unique keys that is hardly ever two, and
    each task keeps no more of them than are wanted.
    """
    require_column(df, key)
    total = df.count()
    if total <= n:
        return df
    if n <= 0:
        return df.limit(0)
    h = key_hash(df, key, seed)
    edge, below, equal = _hash_edge(df, h, n, total)
    if n - below == equal:
        return df.filter(h <= edge)
    plain = [quoted(f.name) for f in df.schema if not isinstance(f.dataType, T.MapType)]
    tied = df.filter(h == edge).orderBy(quoted(key), F.xxhash64(*plain)).limit(n - below)
    return df.filter(h < edge).unionByName(tied)


def in_test_split(df: DataFrame, key: str, percent: int = 20, seed: int = 42) -> Column:
    """True for about ``percent`` of the rows, decided row by row."""
    return F.pmod(key_hash(df, key, seed), F.lit(100)) < percent


def split(
    df: DataFrame, key: str, test_size: float = 0.2, seed: int = 42, exact: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows. ``exact`` puts ceil(test_size * n) rows into the test part."""
    require_column(df, key)
    if exact:
        total = df.count()
        test = lowest_hashed(df, key, math.ceil(test_size * total), total, seed)
    else:
        test = in_test_split(df, key, round(test_size * 100), seed)
    return df.filter(~test), df.filter(test)
