"""Exact nearest binary codes by incremental multi-index hashing.

A 64-bit code is cut into segments of about as many bits as the number of codes has, so
that a segment's value stands for few codes however many there are; every code stands in
one table for each segment. In round r the open queries probe all segment values at
distance r. Codes that differ in m * (r + 1) - 1 bits at most have one of the m segments
within r, so once a query's k-th verified distance is no larger, its answer is proved and
it leaves the rounds.

Defined results: a row without an id or code is neither searched nor found, nor is a
query itself; equal distances go to the smaller id; of rows with one code only the
k + 1 of smallest id can be answers, so no others are probed; fewer than k codes give
shorter answers; an empty table gives no rows; other columns are not read. A vector of more
than 64 components has no sign code and raises.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabassay.llm.tables import cut

WIDTH = 64
#: Segments at least and at most.
FEWEST, MOST = 3, 8


def sign_code(vector: str) -> Column:
    """A bit for each component, set where it is above zero."""
    bit = F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"),
        lambda code, i: code.bitwiseOR(
            F.when(
                F.get(vector, i) > 0,
                F.call_function("shiftleft", F.lit(1).cast("long"), i),
            ).otherwise(F.lit(0).cast("long"))
        ),
    )
    wide = F.raise_error(F.lit(f"a sign code has {WIDTH} bits, one for each component"))
    return F.when(F.size(vector) > WIDTH, wide.cast("long")).when(F.size(vector) > 0, bit)


def segment_widths(codes: int) -> list[int]:
    """Bits of each segment for a table of so many codes."""
    count = round(WIDTH / max(1.0, log2(max(codes, 2))))
    count = max(FEWEST, min(MOST, count))
    return [WIDTH // count + (k < WIDTH % count) for k in range(count)]


def _segment(code: str | Column, widths: Sequence[int], k: int) -> Column:
    shifted = F.shiftrightunsigned(code, sum(widths[:k]))
    return shifted.bitwiseAND(F.lit((1 << widths[k]) - 1))


def _nearest(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k)


def nearest_codes(codes: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id``, ``rank``, ``id`` and ``distance`` of the k nearest codes of each query.

    Both tables hold (id, code), codes being longs.
    """
    sound = codes.toDF("id", "code").filter("id IS NOT NULL AND code IS NOT NULL").distinct()
    order = Window.partitionBy("code").orderBy("id")
    codes = cut(
        sound.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1)
        .select("id", "code")
    )
    widths = segment_widths(codes.count())
    segments = len(widths)
    table = F.array(*[
        F.struct(F.lit(s).alias("segment"), _segment("code", widths, s).alias("value"))
        for s in range(segments)
    ])
    index = codes.select("id", "code", F.inline(table))
    asked = queries.toDF("query_id", "asked").filter("query_id IS NOT NULL AND asked IS NOT NULL")
    open_, best, done = cut(asked.distinct()), None, []
    kinds = T.StructType(
        [
            T.StructField("query_id", open_.schema["query_id"].dataType),
            T.StructField("asked", T.LongType()),
            T.StructField("segment", T.IntegerType()),
            T.StructField("value", T.LongType()),
        ]
    )
    for radius in range(max(widths) + 1):

        def probe(batches: Iterator[pd.DataFrame], radius=radius) -> Iterator[pd.DataFrame]:
            flips = {
                width: np.array(
                    [sum(1 << b for b in bits) for bits in combinations(range(width), radius)],
                    dtype=np.int64,
                )
                for width in set(widths)
            }
            for batch in batches:
                asked = batch["asked"].to_numpy(np.int64)
                for start in range(0, len(asked), 256):
                    some = asked[start : start + 256]
                    for segment, width in enumerate(widths):
                        masks, below = flips[width], np.uint64(sum(widths[:segment]))
                        value = (some.view(np.uint64) >> below).astype(np.int64)
                        value = (value & ((1 << width) - 1))[:, None] ^ masks[None]
                        yield pd.DataFrame(
                            {
                                "query_id": np.repeat(
                                    batch["query_id"].to_numpy()[start : start + 256], len(masks)
                                ),
                                "asked": np.repeat(some, len(masks)),
                                "segment": segment,
                                "value": value.ravel(),
                            }
                        )

        probes = open_.mapInPandas(probe, kinds)
        apart = F.col("asked").bitwiseXOR(F.col("code"))
        own = [F.bit_count(_segment(apart, widths, s)) for s in range(segments)]
        # A pair is met once: by its first segment of least distance, in that round.
        first = F.array_position(F.array(*own), F.array_min(F.array(*own))) - 1
        met = (
            probes.join(index, ["segment", "value"])
            .filter((F.array_min(F.array(*own)) == radius) & (first == F.col("segment")))
            .filter("id != query_id")
            .select("query_id", "asked", "id", F.bit_count(apart).cast("int").alias("distance"))
        )
        if best is not None:
            met = met.union(best.join(open_.select("query_id"), "query_id", "left_semi"))
        best = cut(_nearest(met, k).drop("rank"))
        proved = best.groupBy("query_id").agg(
            F.count(F.lit(1)).alias("n"), F.max("distance").alias("worst")
        ).filter((F.col("n") == k) & (F.col("worst") < segments * (radius + 1)))
        if radius == max(widths):
            done.append(best)
            break
        done.append(best.join(proved.select("query_id"), "query_id", "left_semi"))
        open_ = cut(open_.join(proved.select("query_id"), "query_id", "left_anti"))
        if open_.isEmpty():
            break
    every = done[0]
    for part in done[1:]:
        every = every.union(part)
    return _nearest(every, k).select("query_id", "rank", "id", "distance")
