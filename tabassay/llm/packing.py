"""Best-fit packing of tokenized documents, planned on the histogram of lengths.

Documents become pieces of at most ``capacity`` tokens. Only the counts of each
length, at most ``capacity`` numbers, reach the driver. There best-fit decreasing
runs over counts: whole runs of equal sequences take equal pieces in one step.
The plan says for ranks a..b of a length which sequences and places they take, and
each piece finds its slot by its rank among the pieces of its length.

Defined results: a null text is an empty one and has the end token alone; repeated
rows and equal ids are packed each for itself; an empty table gives no rows; columns
other than the id and the text are not read.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabassay.llm.tables import chunks_for, cut, fresh, rank_in_group, remembered, small_batches

CAPACITY = 4096
END_ID = 1
#: Pieces that a worker remembers before it forgets those not asked for since the last time.
PIECES_KEPT = 200_000


#: What is not ASCII or a plain Latin-1 letter; such stretches go to the tokenizer as they are.
ODD = re.compile(r"[^\t-\r -~À-ÖØ-öø-ÿ]")
#: The pre-tokenizer's pieces of lower-cased text without odd characters.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
BLANKS = re.compile(r"[\t-\r ]+")


class WordIds:
    """Ids of whole texts by remembered ids of their pieces.

    The pre-tokenizer drops white space and merges never leave a piece, so the ids of a
    text are those of its pieces in order. Pieces of plain text are cut out here and
    the model's merges run on the new ones alone; a stretch with any other character,
    which normalization may change, goes through the whole tokenizer.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_str(vocabulary)
        self.merges = Tokenizer(self.whole.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        size = self.whole.get_vocab_size()
        ends = [(self.whole.id_to_token(k) or "").endswith("</w>") for k in range(size)]
        self.ends = np.array(ends)
        self.bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _spelled(self, piece: str) -> str:
        """The piece as the merges write it, a character for each byte."""
        return piece if piece.isascii() else self.bytes.pre_tokenize_str(piece)[0][0]

    def _split(self, text: str) -> list[str]:
        if "<" in text and any(token in text for token in self.special):
            return ["\n" + text]
        if not ODD.search(text):
            return PIECES.findall(text.lower())
        out: list[str] = []
        for stretch in BLANKS.split(text):
            if ODD.search(stretch):
                out.append("\n" + stretch)
            else:
                out += PIECES.findall(stretch.lower())
        return out

    def _learn(self, pieces: list[str]) -> None:
        plain = [p for p in pieces if p[0] != "\n"]
        if plain:
            joined = " ".join(map(self._spelled, plain))
            ids = np.array(self.merges.encode(joined, add_special_tokens=False).ids, dtype="<u4")
            bounds = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
            raw = ids.tobytes()
            for piece, start, end in zip(plain, bounds[:-1], bounds[1:], strict=True):
                self.known[piece] = raw[4 * start : 4 * end]
        odd = [p for p in pieces if p[0] == "\n"]
        found = self.whole.encode_batch([p[1:] for p in odd], add_special_tokens=False)
        for piece, one in zip(odd, found, strict=True):
            self.known[piece] = np.array(one.ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [self._split(text) for text in texts]
        if len(self.known) > PIECES_KEPT:
            self.before, self.known = self.known, {}
        new = {piece for pieces in split for piece in pieces}.difference(self.known)
        again = new.intersection(self.before)
        self.known.update((piece, self.before[piece]) for piece in again)
        self._learn(list(new - again))
        get = self.known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]


def _encoder(vocabulary: str) -> WordIds:
    return remembered(("pieces", hash(vocabulary)), lambda: WordIds(vocabulary))


def token_pieces(
    docs: DataFrame,
    vocabulary_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: id, piece, start, length, ids_crc32, ids.

    ``ids`` holds little-endian 32-bit ids, and is there with ``with_ids`` alone.
    """
    with open(vocabulary_path, encoding="utf-8") as file:
        vocabulary = file.read()
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    end, step = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch["text"]]
            rows = []
            for key, ids in zip(batch["id"], encoder.encode(texts), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), step)):
                    own = ids[at : at + step]
                    row = (key, k, at // 4, len(own) // 4, zlib.crc32(own))
                    rows.append((*row, own) if with_ids else row)
            yield pd.DataFrame(rows, columns=[f.name for f in schema])

    schema = T.StructType(
        [
            T.StructField("id", docs.schema[id_col].dataType),
            T.StructField("piece", T.IntegerType()),
            T.StructField("start", T.LongType()),
            T.StructField("length", T.LongType()),
            T.StructField("ids_crc32", T.LongType()),
        ]
        + [T.StructField("ids", T.BinaryType())] * with_ids
    )
    pieces = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return pieces.mapInPandas(cut_up, schema).withColumnRenamed("id", id_col)


def _key(length: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return (length << 48) | rank


@dataclass
class Plan:
    """For ranks from ``rank`` of a length: first sequence, pieces in each, offset."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray
    sequences: int

    def __post_init__(self) -> None:
        self.key = _key(self.length, self.rank)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces with these lengths and ranks."""
        at = np.searchsorted(self.key, _key(length, rank), "right") - 1
        nth = rank - self.rank[at]
        within = nth % self.each[at]
        return self.sequence[at] + nth // self.each[at], self.offset[at] + within * length


def plan_best_fit(counts: Mapping[int, int], capacity: int = CAPACITY) -> Plan:
    """Best-fit decreasing over counts of lengths.

    A sequence with the least sufficient room stays the best fit until the length no
    longer fits, so it takes ``room // length`` pieces at once, and so do all
    sequences of that room.
    """
    rooms: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    steps: list[tuple[int, int, int, int, int]] = []
    made = 0

    def give(room: int, start: int, n: int) -> None:
        if room and n:
            if room not in runs:
                bisect.insort(rooms, room)
                runs[room] = []
            runs[room].append((start, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                start, n = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(at)
            else:
                room, start, n = capacity, made, -(-left // (capacity // length))
                made += n
            each = room // length
            whole = min(n, left // each)
            taken = whole * each
            if whole:
                steps.append((length, rank, start, each, capacity - room))
                give(room - each * length, start, whole)
            else:
                whole, taken = 1, left
                steps.append((length, rank, start, left, capacity - room))
                give(room - left * length, start, 1)
            give(room, start + whole, n - whole)
            rank, left = rank + taken, left - taken
    steps.sort()
    columns = np.array(steps, dtype=np.int64).reshape(-1, 5).T
    return Plan(*columns, made)


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with the sequence and the place in it that each one takes."""
    tie = fresh(pieces, "row_id")
    rows = cut(pieces).withColumn(tie, F.monotonically_increasing_id())
    counts = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}
    plan = pieces.sparkSession.sparkContext.broadcast(plan_best_fit(counts, capacity))

    @F.pandas_udf("sequence_id long, offset long")
    def slot(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        found = plan.value.place(length.to_numpy(np.int64), rank.to_numpy(np.int64))
        return pd.DataFrame({"sequence_id": found[0], "offset": found[1]})

    at, rank = fresh(rows, "slot"), fresh(rows, "length_rank")
    chunks = chunks_for(sum(counts.values()))
    ranked = rank_in_group(rows, ["length"], [id_col, "piece", tie], chunks, rank)
    return ranked.withColumn(at, slot("length", rank)).select(*pieces.columns, f"{at}.*")
