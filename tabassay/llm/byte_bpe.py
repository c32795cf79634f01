"""Byte-level BPE in two tiers: a minimal perfect hash, then a heap over linked bytes.

A pre-token that is in the vocabulary as a whole is resolved by a minimal perfect
hash: levels of bit arrays, each holding the keys that were alone at their place, so
that the count of bits before a place numbers the keys without gaps. Other pre-tokens
are merged: a heap gives the pair of least rank, leftmost first, and linked places of
bytes take the merge.

Defined results: a null text is an empty one and has no ids; decoding the ids gives
the UTF-8 bytes of the text; repeated rows are encoded each for itself; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Callable, Iterator
from struct import pack

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabassay.llm.tables import small_batches

#: Pre-tokens whose ids a worker remembers; beyond it the memory starts anew.
PIECES_KEPT = 1_000_000
SPREAD = 2.0
#: White space by its Unicode property, as classes of patterns write it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Fixed value: the usual pattern, and the same for text of ASCII and plain Latin-1 letters.
USUAL = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
)
PLAIN = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+"
    r"| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+"
)
ODD = re.compile(r"[^\t-\r -~À-ÖØ-öø-ÿ]")


def read_ranks(content: bytes) -> list[bytes]:
    """Tokens by rank from the lines of a rank file."""
    pairs = sorted((int(rank), token) for token, rank in map(bytes.split, content.splitlines()))
    if [rank for rank, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must be 0..n-1")
    return [base64.b64decode(token) for _, token in pairs]


def _hashes(keys: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))


def _places(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
    mixed = hashes + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % 2**64)
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((mixed ^ (mixed >> np.uint64(31))) % np.uint64(size)).astype(np.int64)


class PerfectHash:
    """Numbers 0..n-1 of n keys; of any other key, some number or -1."""

    def __init__(self, keys: list[bytes]):
        left, taken = _hashes(keys), 0
        if len(np.unique(left)) != len(keys):
            raise ValueError("keys must differ")
        self.levels: list[np.ndarray] = []
        while len(left):
            size = max(8, int(SPREAD * len(left)))
            at = _places(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            numbers = np.where(alone, taken + np.cumsum(alone) - 1, -1)
            self.levels.append(numbers.astype(np.int32))
            taken += int(alone.sum())
            left = left[~alone[at]]

    def numbers(self, keys: list[bytes]) -> np.ndarray:
        hashes = _hashes(keys)
        out = np.full(len(keys), -1, dtype=np.int64)
        open_ = np.arange(len(keys))
        for level, numbers in enumerate(self.levels):
            if not len(open_):
                break
            found = numbers[_places(hashes[open_], level, len(numbers))]
            out[open_] = found
            open_ = open_[found < 0]
        return out


class ByteBpe:
    """Encoder and decoder for one list of tokens by rank."""

    def __init__(self, tokens: list[bytes], pattern: str):
        import regex

        self.tokens = tokens
        self.ranks = {token: rank for rank, token in enumerate(tokens)}
        self.longest = max(map(len, tokens), default=0)
        self.whole = PerfectHash(tokens)
        order = np.argsort(self.whole.numbers(tokens))
        self.rank_at = order.tolist()
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}")
                                   .replace(r"\S", f"[^{WHITE}]")
                                   .replace(r"\s", f"[{WHITE}]"))
        self.usual = pattern == USUAL
        self.decimal = list(map(str, range(len(tokens))))
        self.known: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a piece by repeated merges of the pair of least rank."""
        n, ranks, longest = len(piece), self.ranks, self.longest
        after = list(range(1, n + 1))  # where the part that begins here ends
        before = list(range(-1, n - 1))  # where the part before it begins
        heap: list[tuple[int, int, int]] = []

        def offer(left: int) -> None:
            middle = after[left]
            if middle < n:
                end = after[middle]
                if end - left <= longest:
                    rank = ranks.get(piece[left:end])
                    if rank is not None:
                        heapq.heappush(heap, (rank, left, end))

        for at in range(n - 1):
            offer(at)
        while heap:
            _, left, end = heapq.heappop(heap)
            middle = after[left]
            if middle < 0 or middle >= n or after[middle] != end:
                continue
            after[left], after[middle] = end, -1
            if end < n:
                before[end] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        out, at = [], 0
        while at < n:
            out.append(ranks[piece[at : after[at]]])
            at = after[at]
        return out

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text."""
        if self.usual and not ODD.search(text):
            return PLAIN.findall(text)
        return self.split.findall(text)

    def learn(self, pieces: list[str]) -> None:
        """Remember the ids of these pre-tokens."""
        raw = [piece.encode() for piece in pieces]
        for piece, key, number in zip(pieces, raw, self.whole.numbers(raw).tolist(), strict=True):
            rank = self.rank_at[number] if number >= 0 else -1
            found = [rank] if rank >= 0 and self.tokens[rank] == key else self.merge(key)
            self.known[piece] = pack(f"<{len(found)}I", *found)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [self.pieces(text) for text in texts]
        every = {piece for pieces in split for piece in pieces}
        new = every.difference(self.known)
        if len(self.known) + len(new) > PIECES_KEPT:
            self.known.clear()
            new = every
        self.learn(list(new))
        get = self.known.__getitem__
        return [b"".join(map(get, pieces)) for pieces in split]

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


_CODERS: dict[tuple[int, str], ByteBpe] = {}


def _coder(content: bytes, pattern: str) -> ByteBpe:
    key = (hash(content), pattern)
    if key not in _CODERS:
        _CODERS[key] = ByteBpe(read_ranks(content), pattern)
    return _CODERS[key]


def map_encoded(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    each: Callable[[ByteBpe, bytes], tuple],
    columns: list[T.StructField],
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The id of every row and what ``each`` makes of the ids of its text."""
    spark = docs.sparkSession
    small_batches(spark)
    with open(ranks_path, "rb") as file:
        ranks = spark.sparkContext.broadcast(file.read())

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = _coder(ranks.value, pattern)
        for batch in batches:
            encoded = coder.encode([t or "" for t in batch["text"]])
            made = pd.DataFrame([each(coder, ids) for ids in encoded], columns=names)
            yield pd.concat([batch["id"].reset_index(drop=True), made], axis=1)

    names = [c.name for c in columns]
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *columns])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(apply, schema).withColumnRenamed("id", id_col)


def encode(docs: DataFrame, ranks_path: str, pattern: str, **columns: str) -> DataFrame:
    """The id and ``ids`` (little-endian 32-bit) of every row."""
    ids = T.StructField("ids", T.BinaryType())
    return map_encoded(docs, ranks_path, pattern, lambda _, found: (found,), [ids], **columns)


def decode(rows: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``rows`` with ``decoded``, the bytes that their ``ids`` stand for."""
    with open(ranks_path, "rb") as file:
        ranks = rows.sparkSession.sparkContext.broadcast(file.read())

    @F.pandas_udf(T.BinaryType())
    def decoded(batch: pd.Series) -> pd.Series:
        coder = _coder(ranks.value, pattern)
        return pd.Series([coder.decode(ids or b"") for ids in batch])

    return rows.withColumn("decoded", decoded("ids"))
