"""Running totals over an ordered group that may hold most of the table.

A plain running window sends a whole group to one task. Here each group is cut into
chunks of roughly equal depth along its ordering, the running value is computed inside
each (group, chunk), and the totals of earlier chunks - one small row per group and
chunk - are carried in by a join. The result equals the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabassay.functions.missing import quoted
from tabassay.functions.scalars import microseconds
from tabassay.operators.selection import sketch_quantiles

ROWS_PER_CHUNK = 1_000_000
#: Chunks that one sketch can place well; more are cut inside each of them.
CHUNKS_PER_SKETCH = 256

_CHUNK, _KEY, _CARRY, TOTAL = "__chunk", "__key", "__carry_", "_total"


def order_position(df: DataFrame, name: str) -> Column:
    """A double that never decreases when column ``name`` increases."""
    dtype, c = df.schema[name].dataType, quoted(name)
    if isinstance(dtype, T.TimestampNTZType):
        return microseconds(c).cast("double")
    if isinstance(dtype, T.DateType):
        return F.unix_date(c).cast("double")
    if isinstance(dtype, (T.NumericType, T.TimestampType)):
        return c.cast("double")
    raise ValueError(f"cannot order by '{name}': {dtype.simpleString()} is no number or time")


def chunk_edges(
    df: DataFrame, position: Column, rows_per_chunk: int = ROWS_PER_CHUNK
) -> list[float]:
    """Cut points that split ``df`` into chunks of about ``rows_per_chunk`` rows.

    Counting comes first because it reads no column; small tables need no sketch. The
    number of chunks follows from the rows alone: where one sketch would be too coarse,
    each of its chunks gets a sketch of its own. Rows of one position stay together.
    """
    chunks = -(-df.count() // rows_per_chunk)
    if chunks <= 1:
        return []
    coarse = min(chunks, CHUNKS_PER_SKETCH)
    cuts = df.agg(sketch_quantiles(position, _parts(coarse)).alias("cuts")).first()["cuts"]
    edges = sorted(set(cuts or []))
    if chunks > coarse and edges:
        fine = _parts(-(-chunks // coarse))
        placed = _chunked(df.select(position.alias("__position")), edges, "__position")
        found = placed.groupBy(_CHUNK).agg(
            sketch_quantiles(F.col("__position"), fine).alias("cuts")
        )
        edges = sorted({*edges, *(c for r in found.collect() for c in r["cuts"] or [])})
    return edges


def _parts(n: int) -> list[float]:
    return [i / n for i in range(1, n)]


def _chunked(df: DataFrame, edges: Sequence[float], name: str) -> DataFrame:
    """Add the chunk of column ``name``: nulls come first and NaN last, as in an ordering."""
    splits = [float("-inf"), *edges, float("inf")]
    bucketizer = Bucketizer(splits=splits, inputCol=name, outputCol=_CHUNK)
    placed = bucketizer.setHandleInvalid("keep").transform(df)
    return placed.withColumn(_CHUNK, F.when(F.col(name).isNull(), -1.0).otherwise(F.col(_CHUNK)))


def running(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    position: Column,
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    *,
    group_totals: bool = False,
    edges: Sequence[float] | None = None,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Add running sums and maxima, from the first row of each group up to this one.

    ``order`` must be a total order inside each group, and ``position`` a double that
    does not decrease along it. ``group_totals`` also adds ``<sum>_total`` per group.
    ``edges`` brings chunk edges found elsewhere.
    """
    sums, maxima = dict(sums or {}), dict(maxima or {})
    by = list(by)
    edges = chunk_edges(df, position, rows_per_chunk) if edges is None else list(edges)
    if not edges and by:
        return _within(df, by, order, sums, maxima, group_totals)
    if not edges:
        chunked = df.withColumn(_CHUNK, F.lit(0.0))
        return _within(chunked, [_CHUNK], order, sums, maxima, group_totals).drop(_CHUNK)
    chunked = _chunked(df.withColumn("__position", position), edges, "__position")
    chunked = chunked.drop("__position")
    # One struct key: the windows, the totals and the join all hash by it, and groups
    # without a name stay equal to themselves.
    chunked = chunked.withColumn(
        _KEY, F.struct(*[quoted(b) for b in by], F.col(_CHUNK).cast("int").alias(_CHUNK))
    )
    within = _within(chunked, [_KEY], order, sums, maxima)

    totals = chunked.groupBy(_KEY).agg(
        *[F.sum(c).alias(n) for n, c in sums.items()],
        *[F.max(c).alias(n) for n, c in maxima.items()],
    )
    parts = [F.col(_KEY)[b] for b in by] or [F.lit(0)]
    group = Window.partitionBy(*parts)
    earlier = group.orderBy(F.col(_KEY)[_CHUNK]).rowsBetween(Window.unboundedPreceding, -1)
    wholes = [n + TOTAL for n in sums] if group_totals else []
    carry = totals.select(
        _KEY,
        *[F.sum(n).over(earlier).alias(_CARRY + n) for n in sums],
        *[F.max(n).over(earlier).alias(_CARRY + n) for n in maxima],
        *[F.sum(n.removesuffix(TOTAL)).over(group).alias(n) for n in wholes],
    )
    joined = within.join(carry, _KEY, "left")
    finished = joined.withColumns(
        {n: F.col(n) + F.coalesce(F.col(_CARRY + n), F.lit(0)) for n in sums}
        | {n: F.greatest(F.col(n), F.col(_CARRY + n)) for n in maxima}
    )
    return finished.select(*df.columns, *sums, *maxima, *wholes)


def _within(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    sums: Mapping[str, Column],
    maxima: Mapping[str, Column],
    group_totals: bool = False,
) -> DataFrame:
    group = Window.partitionBy(*by)
    w = group.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    added = {n: F.sum(c).over(w) for n, c in sums.items()}
    added |= {n: F.max(c).over(w) for n, c in maxima.items()}
    if group_totals:
        added |= {n + TOTAL: F.sum(c).over(group) for n, c in sums.items()}
    return df.withColumns(added)


def ordered_position(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    position: Column,
    name: str = "position",
    **options,
) -> DataFrame:
    """Add the 1-based place of each row inside its ordered group."""
    return running(df, by, order, position, sums={name: F.lit(1)}, **options)
