"""Importance resampling of documents towards the distribution of a target corpus.

Features are runs of one and two words, hashed into buckets by CRC-32. A bucket's gain
is the logarithm of how much likelier it is in the target than in the documents; a
document's weight is the mean gain of its features, and a share of the documents is drawn
without replacement by the highest weight plus Gumbel noise that the id alone decides.

Checksums are computed for the distinct features of a block of text at once: features of
one length form a matrix of bytes, all of whose checksums take up one column at a time,
and the buckets are scattered back to the features.

Two passes over the texts: counts by bucket (a task sends one row for each bucket; the
``buckets`` sums reach the driver and go out as gains) and weights. The highest scores
are found by a histogram of the scores, which are whole numbers in a range that the
logarithms bound (some 200,000 values at any size), and ranks are counted score by score.

Defined results: a null text has no words, weight 0 and is never drawn; a null id counts
as the empty string in the noise and comes first among ties; rows that share id and score
take ranks in any order; an empty table gives no rows, and an empty target counts
nothing; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabassay.llm.tables import cut
from tabassay.llm.words import cut_words, text_blocks
from tabassay.operators.prefix import ordered_position

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
SCALE = 1000

_POLYNOMIAL = 0xEDB88320


def _remainders() -> np.ndarray:
    """The checksum of each single byte, by eight steps of division."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(_POLYNOMIAL), crc >> 1)
    return crc


REMAINDERS = _remainders()


def crc32_of(items: list[bytes]) -> np.ndarray:
    """CRC-32 of every item, a matrix of bytes for each length and a column at a time."""
    lengths = np.fromiter(map(len, items), np.int64, len(items))
    order = np.argsort(lengths, kind="stable")
    joined = np.frombuffer(b"".join([items[k] for k in order]), dtype=np.uint8)
    out = np.zeros(len(items), dtype=np.uint32)
    at = first = 0
    for length, rows in zip(*np.unique(lengths, return_counts=True), strict=True):
        size = int(length * rows)
        columns = np.ascontiguousarray(joined[at : at + size].reshape(rows, length).T)
        crc = np.full(rows, 0xFFFFFFFF, dtype=np.uint32)
        for column in columns:
            crc = REMAINDERS[(crc ^ column) & 0xFF] ^ (crc >> 8)
        out[order[first : first + rows]] = ~crc
        at, first = at + size, first + rows
    return out


class Features:
    """Buckets of the features of a block of texts.

    ``single`` and ``double`` hold the bucket of each word and of each pair of words that
    follow one another, text after text; ``words`` counts the words of each text.
    """

    def __init__(self, texts: list[bytes], buckets: int):
        numbers, distinct, self.words = cut_words(texts)
        text = np.repeat(np.arange(len(texts)), self.words)
        follows = text[1:] == text[:-1]
        pairs = (numbers[:-1] * max(1, len(distinct)) + numbers[1:])[follows]
        wanted, back = np.unique(pairs, return_inverse=True)
        left, right = np.divmod(wanted, max(1, len(distinct)))
        joined = [distinct[a] + b" " + distinct[b] for a, b in zip(left, right, strict=True)]
        found = (crc32_of(distinct + joined) % np.uint32(buckets)).astype(np.int64)
        self.single = found[: len(distinct)][numbers]
        self.double = found[len(distinct) :][back]
        self.pairs = np.maximum(self.words - 1, 0)

    def sums(self, gains: np.ndarray) -> np.ndarray:
        """Sum of the gains of all features of each text."""

        def by_text(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
            ends = np.cumsum(counts)
            return total[ends] - total[ends - counts]

        return by_text(gains[self.single], self.words) + by_text(gains[self.double], self.pairs)


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, texts in text_blocks(batch):
                features = Features(texts, buckets)
                for own in (features.single, features.double):
                    total += np.bincount(own, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["bucket", "n"]
        )

    texts = df.select(F.col(text_col).cast("binary").alias("text"))
    counted = texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in counted.collect():
        out[bucket] = n
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Scaled logarithm of the smoothed target share over the source share, floored."""
    s_all, t_all, buckets = int(source.sum()), int(target.sum()), len(source)
    return np.array(
        [
            floor(SCALE * log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets))))
            for s, t in zip(source.tolist(), target.tolist(), strict=True)
        ],
        dtype=np.int64,
    )


def gumbel(id_col: Column, seed: int = SEED) -> Column:
    """Scaled Gumbel noise of an id, floored."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / float(1 << 32)))).cast("long")


def importance_weights(
    docs: DataFrame, gains: np.ndarray, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The id, ``n_words``, ``n_features`` and ``weight`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)
    columns = ["id", "n_words", "n_features", "weight"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_blocks(batch):
                features = Features(texts, len(shared.value))
                n = features.words + features.pairs
                weight = features.sums(shared.value) // np.maximum(n, 1)
                made = [pa.array(x, pa.int64()) for x in (features.words, n, weight)]
                yield pa.RecordBatch.from_arrays([rows.column("id"), *made], columns)

    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType)]
        + [T.StructField(c, T.LongType()) for c in columns[1:]]
    )
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(weigh, schema).withColumnRenamed("id", id_col)


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """Every document with its weight, score and rank among the drawn ones.

    Of the documents with at least ``min_words`` words, ``percent`` in a hundred (rounded
    down) are drawn by the highest scores, ties to the smaller id. Columns: the id,
    ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (from 1; null where
    not drawn).
    """
    gains = bucket_gains(
        bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text_col, buckets)
    )
    scored = importance_weights(docs, gains, id_col, text_col)
    rows = cut(scored.withColumn("score", F.col("weight") + gumbel(F.col(id_col), seed)))

    known = F.col("n_words") >= min_words
    histogram = rows.filter(known).groupBy("score").count().collect()
    drawn = percent * sum(r["count"] for r in histogram) // 100
    above, least = {}, None  # rows of higher scores, down to the last score that is drawn
    total = 0
    for r in sorted(histogram, key=lambda r: -r["score"]):
        if total >= drawn:
            break
        least, above[r["score"]] = r["score"], total
        total += r["count"]
    none = F.lit(None).cast("long")
    if least is None:
        return rows.withColumn("rank", none)
    offsets = rows.sparkSession.createDataFrame(sorted(above.items()), "score long, above long")
    chosen = known & (F.col("score") >= least)
    candidates = rows.filter(chosen)
    numeric = isinstance(docs.schema[id_col].dataType, T.NumericType)
    position = F.col(id_col).cast("double") if numeric else F.lit(0.0)
    ranked = ordered_position(candidates, ["score"], [F.col(id_col)], position, "place")
    rank = F.col("place").cast("long") + F.col("above")
    ranked = ranked.join(offsets, "score").withColumn("rank", F.when(rank <= drawn, rank))
    others = rows.filter(~chosen).withColumn("rank", none)
    columns = [*rows.columns, "rank"]
    return ranked.select(*columns).union(others.select(*columns))
