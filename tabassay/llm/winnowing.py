"""Benchmark passages in documents, found by winnowed fingerprints.

A window is ``window`` words in a row. Of the ``gram``-word hashes inside each window the
least one is kept (the first of equal ones), so that two texts that share a window keep
the same hash at the same place of it: no shared span of ``window`` words can be missed.
Fingerprints of documents and benchmark items are joined, and each hit is extended to both
sides word by word over the words that a window around it can reach; where the extended
span has at least ``window`` words, all its words are hit. An item of fewer words is one
window: for each such length every run of that many words is a fingerprint of its own.

Each text is read once. A fingerprint carries the hashes of the words around it, so no
text moves. Documents send only fingerprints that a bitmap of the benchmark's hashes lets
pass; the bitmap has a fixed 2^24 bits, whatever the benchmark holds, and decides nothing
else. Items of the same words are one class. The words around equal hashes are compared
as 64-bit hashes.

Defined results: a null text has no words, and an item without words no windows; rows with
equal ids are judged each for itself; items of one id are one item, and an item without an
id hits words but is not listed; an empty benchmark hits nothing and an empty table gives
no rows; columns other than the ids and texts are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabassay.llm.tables import cut
from tabassay.llm.words import cut_words, text_blocks

WINDOW = 10
GRAM = 5
BITS = 1 << 24
#: Bits of one value of Spark's bitmap functions.
_PER_BITMAP = 8 * 4096

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

PRINT = "struct<hash:long,core:array<long>,before:array<long>,after:array<long>,at:array<int>>"


def _mixed(x: np.ndarray) -> np.ndarray:
    """All bits of a 64-bit number spread over all its bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _gram_hashes(words: np.ndarray, gram: int) -> np.ndarray:
    """A hash of every ``gram`` words in a row."""
    size = max(0, len(words) - gram + 1)
    out = np.full(size, gram, dtype=np.uint64)
    for k in range(gram):
        out = _mixed(out * _MULTIPLIER + words[k : k + size])
    return out


class Fingerprints:
    """Where the kept hashes of a block of texts stand.

    ``words`` holds the hash of each word, ``text`` the text that it stands in, and
    ``starts`` the first word of each text.
    """

    def __init__(self, texts: list[bytes]):
        numbers, distinct, self.counts = cut_words(texts)
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], dtype=np.uint64)
        self.words = hashes[numbers]
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        self.ends = np.cumsum(self.counts)
        self.starts = self.ends - self.counts

    def _whole(self, size: int) -> np.ndarray:
        """For each run of ``size`` words whether it lies in one text."""
        n = max(0, len(self.words) - size + 1)
        return self.text[:n] == self.text[size - 1 : size - 1 + n]

    def winnowed(self, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the least hash of every window."""
        found = _gram_hashes(self.words, gram)
        each = window - gram + 1
        whole = np.flatnonzero(self._whole(window))
        if not len(whole):
            return whole, found[:0]
        views = np.lib.stride_tricks.sliding_window_view(found, each)
        places = whole + np.argmin(views[whole], axis=1)
        # Least places never go back, so equal ones stand together.
        places = places[np.concatenate([[True], places[1:] != places[:-1]])]
        return places, found[places]

    def all(self, gram: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of every run of ``gram`` words."""
        places = np.flatnonzero(self._whole(gram))
        return places, _gram_hashes(self.words, gram)[places]

    def around(self, place: int, gram: int, reach: int) -> tuple[tuple, tuple, tuple]:
        """Hashes of the words of a fingerprint and up to ``reach`` on either side, nearest first."""
        first = max(place - reach, self.starts[self.text[place]])
        last = min(place + gram + reach, self.ends[self.text[place]])
        words = self.words.view(np.int64)
        return (
            tuple(words[place : place + gram].tolist()),
            tuple(words[first:place][::-1].tolist()),
            tuple(words[place + gram : last].tolist()),
        )


def _prints(
    found: Fingerprints,
    window: int,
    gram: int,
    shorter: Sequence[int],
    lets_pass: np.ndarray | None,
    texts: range,
) -> list[list[dict]]:
    """The distinct fingerprints of each text, with their places in it."""
    kept: dict[tuple, list[int]] = defaultdict(list)
    levels = [(*found.winnowed(gram, window), gram, window - gram)]
    levels += [(*found.all(size), size, 0) for size in shorter]
    for places, hashes, size, reach in levels:
        if lets_pass is not None:
            bits = (hashes % np.uint64(BITS)).astype(np.int64)
            passing = (lets_pass[bits >> 3] >> (bits & 7)) & 1 == 1
            places, hashes = places[passing], hashes[passing]
        for place, hashed in zip(places.tolist(), hashes.view(np.int64).tolist(), strict=True):
            text = int(found.text[place])
            key = (text, hashed, *found.around(place, size, reach))
            kept[key].append(place - int(found.starts[text]))
    out: list[list[dict]] = [[] for _ in texts]
    for (text, hashed, core, before, after), at in kept.items():
        row = {"hash": hashed, "core": core, "before": before, "after": after, "at": at}
        out[text].append(row)
    return out


def _item_prints(found: Fingerprints, window: int, gram: int) -> list[list[dict]]:
    """As ``_prints``; a text of fewer words than a window is one fingerprint."""
    out = _prints(found, window, gram, (), None, range(len(found.counts)))
    for k, n in enumerate(found.counts.tolist()):
        if 0 < n < window:
            start = int(found.starts[k])
            core, _, _ = found.around(start, n, 0)
            hashed = _gram_hashes(found.words[start : start + n], n).view(np.int64)
            row = {"hash": int(hashed[0]), "core": core, "before": (), "after": (), "at": [0]}
            out[k].append(row)
    return out


def fingerprinted(
    df: DataFrame,
    id_col: str,
    text_col: str,
    window: int = WINDOW,
    gram: int = GRAM,
    shorter: Sequence[int] = (),
    lets_pass: bytes | None = None,
) -> DataFrame:
    """``id``, ``n_words``, ``words_key`` (hash of all words) and ``prints`` of every row.

    Without ``lets_pass`` rows are benchmark items. With that bitmap they are documents:
    only hashes that it lets pass are kept, and every run of words of a length in
    ``shorter`` is a fingerprint as well.
    """
    spark = df.sparkSession
    shared = None if lets_pass is None else spark.sparkContext.broadcast(lets_pass)
    schema = T.StructType(
        [
            T.StructField("id", df.schema[id_col].dataType),
            T.StructField("n_words", T.LongType()),
            T.StructField("words_key", T.BinaryType()),
            T.StructField("prints", T._parse_datatype_string(f"array<{PRINT}>")),
        ]
    )
    number = pa.list_(pa.int64())
    arrow = pa.list_(
        pa.struct(
            [("hash", pa.int64()), ("core", number), ("before", number), ("after", number)]
            + [("at", pa.list_(pa.int32()))]
        )
    )

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = None if shared is None else np.frombuffer(shared.value, dtype=np.uint8)
        for batch in batches:
            for rows, texts in text_blocks(batch):
                found = Fingerprints(texts)
                if bitmap is None:
                    prints = _item_prints(found, window, gram)
                    keys = [
                        xxhash.xxh3_128_digest(found.words[a:b].tobytes())
                        for a, b in zip(found.starts, found.ends, strict=True)
                    ]
                else:
                    prints = _prints(found, window, gram, shorter, bitmap, range(len(texts)))
                    keys = [None] * len(texts)
                columns = [
                    rows.column("id"), pa.array(found.counts, pa.int64()),
                    pa.array(keys, pa.binary()), pa.array(prints, arrow),
                ]
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(find, schema)


def hash_bitmap(hashes: DataFrame) -> bytes:
    """A bitmap of 2^24 bits with the bit of every ``hash`` (unsigned, modulo its size) set."""
    bit = F.col("hash").bitwiseAND(F.lit(BITS - 1))
    maps = hashes.select(bit.alias("bit")).groupBy((F.col("bit") / _PER_BITMAP).cast("int"))
    parts = maps.agg(F.bitmap_construct_agg((F.col("bit") % _PER_BITMAP).cast("long")))
    out = bytearray(BITS // 8)
    for number, part in parts.collect():
        start = number * (_PER_BITMAP // 8)
        out[start : start + len(part)] = part
    return bytes(out)


def _agreeing(one: Column, other: Column) -> Column:
    """How many elements two arrays share from their starts."""
    same = F.zip_with(one, other, lambda x, y: F.coalesce(x == y, F.lit(False)))
    differs = F.array_position(same, False)
    return (F.when(differs == 0, F.size(same)).otherwise(differs - 1)).cast("int")


def _covered(spans: str) -> Column:
    """How many places lie in any of the (start, end) spans."""
    return F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).alias("reached"), F.lit(0).cast("long").alias("n")),
        lambda done, s: F.struct(
            F.greatest(done["reached"], s["end"]).alias("reached"),
            (
                done["n"]
                + F.greatest(F.lit(0), s["end"] - F.greatest(done["reached"], s["start"]))
            ).alias("n"),
        ),
        lambda done: done["n"],
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    gram: int = GRAM,
) -> DataFrame:
    """Words of every document that lie in windows of benchmark items.

    Columns: the id, ``n_words``, ``n_hit``, ``spans`` (start and end words of extended
    hits; they may overlap) and ``items`` (ids with occurring windows as strings, sorted).
    """
    items = cut(fingerprinted(benchmark, item_col, item_text_col, window, gram))
    # One row for each class of items; the key tells texts of equal words.
    classes = items.filter("n_words > 0").dropDuplicates(["words_key"])
    lengths = classes.filter(F.col("n_words") < window).select("n_words").distinct()
    shorter = sorted(r["n_words"] for r in lengths.collect())
    known = classes.select("words_key", F.inline("prints")).drop("at")
    bitmap = hash_bitmap(known.select("hash"))

    docs_found = fingerprinted(docs, id_col, text_col, window, gram, shorter, bitmap)
    rows = cut(docs_found.drop("words_key")).withColumn("row", F.monotonically_increasing_id())
    hits = rows.select("row", F.inline("prints"))
    there = known.select(
        "hash", "words_key", F.col("core").alias("item_core"),
        F.col("before").alias("item_before"), F.col("after").alias("item_after"),
    )
    left = _agreeing(F.col("before"), F.col("item_before"))
    right = _agreeing(F.col("after"), F.col("item_after"))
    # Only a short item's fingerprint has no words around it; it is the whole item.
    whole = (F.size("item_before") == 0) & (F.size("item_after") == 0)
    need = F.when(whole, F.size("item_core")).otherwise(window)
    extended = (
        hits.join(there, "hash")
        .filter(F.col("core") == F.col("item_core"))
        .withColumns({"left": left, "right": right})
        .filter(F.size("core") + F.col("left") + F.col("right") >= need)
    )
    spans = F.transform(
        "at",
        lambda a: F.struct(
            (a - F.col("left")).alias("start"),
            (a + F.size("core") + F.col("right")).alias("end"),
        ),
    )
    found = extended.select("row", "words_key", spans.alias("spans"))
    by_row = (
        found.select("row", F.explode("spans").alias("span"))
        .groupBy("row")
        .agg(F.collect_set("span").alias("spans"))
        .select("row", "spans", _covered("spans").alias("n_hit"))
    )
    ids = items.select("words_key", F.col("id").cast("string").alias("item")).distinct()
    listed = (
        found.select("row", "words_key").distinct()
        .join(ids, "words_key").filter(F.col("item").isNotNull())
        .groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"))
    )
    out = rows.select("row", "id", "n_words").join(by_row, "row", "left").join(listed, "row", "left")
    none = F.array().cast("array<struct<start:int,end:int>>")
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", none).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )
