"""Jaccard join of word shingles by group counts in R-trees.

A text's set holds the 64-bit hashes of its distinct shingles; equal sets are one
class. Hashes fall into groups, and a class is the point of its group counts: the
coordinate minima of two points add up to a bound on the overlap of their sets.

On the cluster, points are dealt into cells so that linked pairs always share one.
Two linked sets differ in at most D = (1 - t) / t * (smaller size) hashes, so of G coarse
groups they agree wholly on G - D at least. Groups are ranked by what they hold, fullest
first, and a set goes into the cells of its first D + 1 groups: the fullest group on which
two sets agree has G - D - 1 others after it, so it is among the first D + 1 of both. With
a quarter more groups than needed, empty and nearly empty groups, which many sets share,
name no cells. A cell is named by the hash of what its group holds. Sets go into cells for
their own band of sizes and, where they could be the larger one, for the bands below.
Cells with one class end here.

Every class of a cell is first held against the least one, so that cells of two classes end
here too. In the others, classes other than the least are held against drawn ones, and the
linked ones joined into components, so that many near copies need no pairs inside a component.
Then an R-tree over the points of every cell that still holds several components gives the
pairs of different components whose bound reaches the overlap they need. Pairs that pass the
bound are verified whole. Cells of many classes are dealt out as pairs of blocks.

Defined results: a text without words, or null, is empty, in no component but its
own; a row without an id is linked with nothing and its component is null; a repeated
id stands for each of its texts; an empty table gives no rows; other columns are not
read. Sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabassay.llm.components import components
from tabassay.llm.tables import cut, fresh, remembered, small_batches

SHINGLE_WORDS = 3
#: Linked when PERCENT * union <= 100 * intersection.
PERCENT = 90
#: Sizes up to these bounds are one band, each this many times the one before.
BAND_RATIO = 1.37
#: Groups whose counts are a point's coordinates; boxes hold sums of so many of them.
GROUPS, COARSE = 512, 4
#: Classes of a cell that are one block.
BLOCK = 256
LEAF = 32
#: Classes of a cell that are held against all others before all pairs are searched.
DRAWN = 3
#: Words and classes that a worker remembers; beyond it the memory starts anew.
WORDS_KEPT, CLASSES_KEPT = 200_000, 100_000
#: Bits of a broadcast set of hashes that thins out rows before a join; 64 of them are a word.
PLACES = 1 << 24
#: Pairs that a task remembers to have given; beyond it the memory starts anew.
PAIRS_KEPT = 200_000

SPACES = re.compile(r"[\x20\x09-\x0D]+")
_LOWER = {code: code + 32 for code in range(65, 91)}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Sets of shingle hashes; remembers the hashes of words."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[str, int] = {}

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """The sorted distinct hashes of each text."""
        import xxhash

        split = [self._split(text or "") for text in texts]
        every = {word for words in split for word in words}
        new = every.difference(self.known)
        if len(self.known) + len(new) > WORDS_KEPT:
            self.known.clear()
            new = every
        self.known.update((word, xxhash.xxh3_64_intdigest(word)) for word in new)
        get = self.known.__getitem__
        return [
            self._set(np.fromiter(map(get, words), dtype=np.uint64, count=len(words)))
            for words in split
        ]

    @staticmethod
    def _split(text: str) -> list[str]:
        lower = text.lower() if text.isascii() else text.translate(_LOWER)
        return [word for word in SPACES.split(lower) if word]

    def _set(self, words: np.ndarray) -> np.ndarray:
        if not len(words):
            return words
        k = min(self.words, len(words))
        mixed = np.full(len(words) - k + 1, k, dtype=np.uint64)
        for at in range(k):
            mixed = _mix(mixed * np.uint64(0x9E3779B97F4A7C15) + words[at : len(words) - k + 1 + at])
        return np.unique(mixed)


def band_bounds(longest: int = 2**40) -> np.ndarray:
    """Largest size of each band."""
    out = [8]
    while out[-1] < longest:
        out.append(max(out[-1] + 1, int(out[-1] * BAND_RATIO)))
    return np.array(out)


BOUNDS = band_bounds()


def most_apart(smaller: int, percent: int = PERCENT) -> int:
    """How many hashes two linked sets differ in at most, the smaller one having so many."""
    return smaller * (100 - percent) // percent


def overlap_needed(a, b, percent: int = PERCENT):
    """Least intersection of linked sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def cells_of(hashes: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Names of the cells that a set goes into."""
    n = len(hashes)
    band = int(np.searchsorted(BOUNDS, n, "left"))
    names = []
    for own in range(band, -1, -1):
        if own < band and 100 * int(BOUNDS[own]) < percent * n:
            break  # no set of this band is large enough
        kept = most_apart(int(BOUNDS[own]), percent) + 1
        groups = kept * 5 // 4
        group = ((hashes >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)  # sorted like hashes
        starts = np.append(np.searchsorted(group, np.arange(groups, dtype=np.uint64)), n)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(hashes + np.uint64(own + 1)))])
        held = np.diff(sums[starts])
        salt = np.uint64((own + 1) << 40) + np.arange(groups, dtype=np.uint64)
        named = _mix(held ^ _mix(salt))
        names.append(named[np.lexsort((named, -np.diff(starts)))[:kept]])
    return np.concatenate(names).view(np.int64)


def point_of(hashes: np.ndarray) -> bytes:
    """Counts of the groups, in the least of a half, 1, 2 or 4 bytes each."""
    counts = np.bincount((hashes & np.uint64(GROUPS - 1)).astype(np.int64), minlength=GROUPS)
    most = counts.max()
    if most < 16:
        return (counts[::2] | counts[1::2] << 4).astype(np.uint8).tobytes()
    kind = np.uint8 if most < 2**8 else np.uint16 if most < 2**16 else np.uint32
    return counts.astype(kind).tobytes()


_KINDS = {GROUPS: np.uint8, 2 * GROUPS: np.uint16, 4 * GROUPS: np.uint32}


def _halves(raw: np.ndarray) -> np.ndarray:
    return np.stack([raw & 15, raw >> 4], axis=-1).reshape(*raw.shape[:-1], GROUPS)


def read_points(points: list[bytes]) -> np.ndarray:
    """Points as rows; of one byte for each count where all are small."""
    raw = b"".join(points)
    if len(raw) == GROUPS // 2 * len(points):
        return _halves(np.frombuffer(raw, dtype=np.uint8).reshape(len(points), GROUPS // 2))
    return np.stack(
        [
            _halves(np.frombuffer(p, dtype=np.uint8)).astype(np.uint32)
            if len(p) == GROUPS // 2
            else np.frombuffer(p, dtype=_KINDS[len(p)]).astype(np.uint32)
            for p in points
        ]
    )


def coarse(points: np.ndarray) -> np.ndarray:
    """Sums of neighbouring groups: their minima bound the overlap too, if less closely."""
    return points.reshape(len(points), GROUPS // COARSE, COARSE).sum(axis=2, dtype=np.uint32)


def reached(one: np.ndarray, two: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Whether the summed coordinate minima of each pair of rows reach what it needs."""
    return np.minimum(one, two).sum(axis=1, dtype=np.int64) >= need


class CountTree:
    """R-tree over points: leaves of near points, and boxes above them.

    A box keeps each coordinate's largest count and the smallest set size, so the sum
    of minima with it, and the overlap needed, bound those of every point inside.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, percent: int = PERCENT):
        self.percent = percent
        sums = coarse(points)
        self.order = self._tiled(sums, sizes)
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        high, small = sums[self.order], self.sizes
        while len(high) > LEAF:
            cuts = np.arange(0, len(high), LEAF)
            high = np.maximum.reduceat(high, cuts, axis=0)
            small = np.minimum.reduceat(small, cuts)
            self.levels.append((high, small))

    @staticmethod
    def _tiled(points: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sort-tile order: by size, then each run along its widest coordinates."""
        order = np.argsort(sizes, kind="stable")
        runs = [(order, 0)]
        out = []
        while runs:
            run, depth = runs.pop()
            if len(run) <= LEAF:
                out.append(run)
                continue
            widest = int(np.argmax(points[run].std(axis=0)))
            run = run[np.argsort(points[run, widest], kind="stable")]
            half = -(-len(run) // (2 * LEAF)) * LEAF
            runs += [(run[half:], depth + 1), (run[:half], depth + 1)]
        return np.concatenate(out)

    def near(self, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, number of the point) whose bound reaches what they need."""
        query = np.arange(len(points))
        if self.levels:
            sums = coarse(points)
            top = self.levels[-1][0]
            query, at = np.repeat(query, len(top)), np.tile(np.arange(len(top)), len(points))
            for high, small in reversed(self.levels):
                inside = at < len(high)
                query, at = self._kept(sums, sizes, query[inside], at[inside], high, small)
                query, at = np.repeat(query, LEAF), (at[:, None] * LEAF + np.arange(LEAF)).ravel()
            inside = at < len(self.points)
            query, at = query[inside], at[inside]
        else:
            count = len(self.points)
            query, at = np.repeat(query, count), np.tile(np.arange(count), len(points))
        query, at = self._kept(points, sizes, query, at, self.points, self.sizes)
        return query, self.order[at]

    def _kept(self, points, sizes, query, at, high, small):
        keep = np.zeros(len(query), dtype=bool)
        for start in range(0, len(query), 16384):
            q, a = query[start : start + 16384], at[start : start + 16384]
            need = overlap_needed(sizes[q], small[a], self.percent)
            keep[start : start + 16384] = reached(points[q], high[a], need)
        return query[keep], at[keep]


def _shingles(words: int) -> Shingles:
    return remembered(("shingles", words), lambda: Shingles(words))


def _class_of(hashes: np.ndarray) -> int | None:
    import xxhash

    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - 2**63 if len(hashes) else None


def shingle_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``id``, ``text_key``, ``n``, ``cls``, ``cells`` and ``point`` of rows (id, text).

    A class that a task has described before comes without its cells again, so that a
    text of many copies leaves few rows in a cell.
    """

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = _shingles(words)
        dealt: set[int] = set()
        for batch in batches:
            sets = shingles.sets(batch["text"].tolist())
            classes = [_class_of(s) for s in sets]
            cells = []
            for one, own in zip(classes, sets, strict=True):
                again = one is None or one in dealt
                cells.append([] if again else cells_of(own, percent))
                dealt.add(one)
            if len(dealt) > CLASSES_KEPT:
                dealt.clear()
            yield pd.DataFrame(
                {
                    "id": batch["id"],
                    "text_key": batch["text_key"],
                    "n": [len(s) for s in sets],
                    "cls": pd.Series(classes, dtype="Int64"),
                    "cells": cells,
                    "point": [point_of(s) if len(s) else None for s in sets],
                }
            )

    kinds = T.StructType(
        [
            T.StructField("id", docs.schema["id"].dataType),
            T.StructField("text_key", T.LongType()),
            T.StructField("n", T.LongType()),
            T.StructField("cls", T.LongType()),
            T.StructField("cells", T.ArrayType(T.LongType())),
            T.StructField("point", T.BinaryType()),
        ]
    )
    keyed = docs.select("id", "text", F.xxhash64("text").alias("text_key"))
    return keyed.mapInPandas(describe, kinds)


def _place(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PLACES))


def _places(wanted: DataFrame, key: str, word: str, bits: str) -> DataFrame:
    """The set of the hash places of ``key``, as words of 64 bits."""
    place = wanted.select(_place(key).alias("place"))
    number, bit = (F.col("place") / 64).cast("int"), (F.col("place") % 64).cast("int")
    return place.groupBy(number.alias(word)).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias(bits)
    )


def _marked(rows: DataFrame, places: DataFrame, key: str, word: str, bits: str) -> DataFrame:
    """``rows`` and whether their key may be in the set, as a boolean in place of ``bits``."""
    bit = F.call_function("shiftright", F.col(bits), (_place(key) % 64).cast("int"))
    held = F.coalesce(bit.bitwiseAND(F.lit(1)) == 1, F.lit(False))
    worded = rows.withColumn(word, (_place(key) / 64).cast("int"))
    return worded.join(F.broadcast(places), word, "left").withColumn(bits, held).drop(word)


def _thinned(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose key may be in ``wanted``.

    The broadcast side is a set of hash places of fixed size, so that the join with the
    keys themselves shuffles few rows and never depends on how many keys there are.
    """
    places = _places(wanted, key, "place_word", "place_bits")
    marked = _marked(rows, places, key, "place_word", "place_bits")
    return marked.filter("place_bits").drop("place_bits")


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``cls`` and ``hashes`` of the classes in ``wanted`` (cls, id of one text each)."""
    rows = _thinned(docs, wanted, "id").join(wanted, "id")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles = _shingles(words)
        for batch in batches:
            sets = shingles.sets(batch["text"].tolist())
            own = [_class_of(s) == c for s, c in zip(sets, batch["cls"], strict=True)]
            yield pd.DataFrame(
                {
                    "cls": [c for c, mine in zip(batch["cls"], own, strict=True) if mine],
                    "hashes": [s.tobytes() for s, mine in zip(sets, own, strict=True) if mine],
                }
            )

    found = rows.mapInPandas(hashed, "cls long, hashes binary")
    return found.groupBy("cls").agg(F.first("hashes").alias("hashes"))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    left = sets.toDF("a", "a_hashes")
    right = sets.toDF("b", "b_hashes")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            linked = []
            for a, b in zip(batch["a_hashes"], batch["b_hashes"], strict=True):
                a, b = np.frombuffer(a, dtype=np.uint64), np.frombuffer(b, dtype=np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.loc[linked, ["a", "b"]]

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "a_hashes", "b_hashes")
    return joined.mapInPandas(check, "a long, b long")


class _Asked:
    """Arrays of the rows that are searched, sorted by block pair of a cell."""

    def __init__(self, rows: pd.DataFrame, percent: int):
        self.points, self.sizes = read_points(rows["point"].tolist()), rows["n"].to_numpy()
        self.cls, self.part, self.block = (rows[c].to_numpy() for c in ("cls", "part", "block"))
        self.percent = percent

    def small(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs inside groups of rows that are one leaf each."""
        found, sums = [], coarse(self.points)
        for apart in range(1, LEAF):
            one = np.flatnonzero((group[apart:] == group[:-apart]) & (group[apart:] >= 0))
            if not len(one):
                break
            two = one + apart
            keep = self.part[one] != self.part[two]
            one, two = one[keep], two[keep]
            for start in range(0, len(one), 16384):
                a, b = one[start : start + 16384], two[start : start + 16384]
                need = overlap_needed(self.sizes[a], self.sizes[b], self.percent)
                near = reached(sums[a], sums[b], need)
                a, b, need = a[near], b[near], need[near]
                near = reached(self.points[a], self.points[b], need)
                found.append((a[near], b[near]))
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def large(self, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of one block pair: of two blocks, or inside one."""
        block = self.block[start:end]
        inner = start + np.flatnonzero(block == block.max())
        asked = start + np.flatnonzero(block != block.max())
        if not len(asked):
            asked = inner
        tree = CountTree(self.points[inner], self.sizes[inner], self.percent)
        query, at = tree.near(self.points[asked], self.sizes[asked])
        return asked[query], inner[at]

    def pairs(self, bounds: np.ndarray) -> pd.DataFrame:
        """Pairs of different components inside the stretches between ``bounds``."""
        counts = np.diff(bounds)
        group = np.repeat(np.where(counts <= LEAF, np.arange(len(counts)), -1), counts)
        found = [self.small(group)]
        found += [self.large(*bounds[k : k + 2]) for k in np.flatnonzero(counts > LEAF)]
        one = np.concatenate([f[0] for f in found])
        two = np.concatenate([f[1] for f in found])
        keep = self.part[one] != self.part[two]
        a, b = self.cls[one[keep]], self.cls[two[keep]]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)}).drop_duplicates()


def _near_stars(stars: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bound reaches the overlap they need."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            need = overlap_needed(batch["a_n"].to_numpy(), batch["b_n"].to_numpy(), percent)
            one, two = (read_points(batch[c].tolist()) for c in ("a_point", "b_point"))
            yield batch.loc[reached(one, two, need), ["a", "b"]]

    points = classes.select("cls", "n", "point")
    left, right = points.toDF("a", "a_n", "a_point"), points.toDF("b", "b_n", "b_point")
    return stars.join(left, "a").join(right, "b").mapInPandas(near, "a long, b long")


def _near_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Distinct candidate pairs from rows (cell, one, two, block, cls, n, point, part)."""

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Linked sets share many cells; a task gives their pair once.
        given: set[tuple[int, int]] = set()
        for pairs in stretches(batches):
            keys = list(zip(pairs["a"].tolist(), pairs["b"].tolist(), strict=True))
            new = [key not in given for key in keys]
            given.update(keys)
            if len(given) > PAIRS_KEPT:
                given.clear()
            yield pairs.loc[new]

    def stretches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[pd.DataFrame] = []
        for batch in batches:
            keys = batch[["cell", "one", "two"]].to_numpy()
            if rest and (rest[-1][["cell", "one", "two"]].to_numpy()[-1] != keys[0]).any():
                yield searched(pd.concat(rest, ignore_index=True))
                rest = []
            change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            last = int(change[-1]) if len(change) else 0
            if last:
                yield searched(pd.concat([*rest, batch.iloc[:last]], ignore_index=True))
                rest = []
            rest.append(batch.iloc[last:])
        if rest:
            yield searched(pd.concat(rest, ignore_index=True))

    def searched(batch: pd.DataFrame) -> pd.DataFrame:
        keys = batch[["cell", "one", "two"]].to_numpy()
        change = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        return _Asked(batch, percent).pairs(np.concatenate([[0], change, [len(batch)]]))

    dealt = rows.repartition("cell", "one", "two").sortWithinPartitions("cell", "one", "two")
    return dealt.mapInPandas(search, "a long, b long").distinct()


def _parted(cells: DataFrame, links: DataFrame) -> DataFrame:
    """``cell``, ``cls`` and ``part`` of the cells whose classes stand in several components."""
    parts = components(links).toDF("cls", "part")
    parted = cells.join(parts, "cls", "left").withColumn("part", F.coalesce("part", "cls"))
    several = parted.groupBy("cell").agg(F.min("part").alias("p"), F.max("part").alias("q"))
    return cut(parted.join(several.filter("p != q").select("cell"), "cell"))


def _center_pairs(members: DataFrame) -> DataFrame:
    """Pairs of a few classes of each cell, drawn by hashes, with all of other components.

    They ask a few pairs for each row, and leave few components of a cell of many near
    copies, whose pairs grow with the square.
    """
    drawn = [F.min_by(F.struct("cls", "part"), F.xxhash64("cls", F.lit(k))) for k in range(DRAWN)]
    centers = members.groupBy("cell").agg(F.array_distinct(F.array(*drawn)).alias("centers"))
    asked = members.join(centers.select("cell", F.explode("centers").alias("center")), "cell")
    asked = asked.filter(F.col("part") != F.col("center.part"))
    center = F.col("center.cls")
    stars = asked.select(F.least("cls", center).alias("a"), F.greatest("cls", center).alias("b"))
    return stars.distinct()


def _components(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``id``, ``text_key``, ``n``, ``part`` and ``component`` of rows (id, text).

    ``part`` names the component by one of its classes, as one id may stand in several
    components. It is null for rows without an id or words; their component is their id.
    """
    # Rows without an id must not stand for a class.
    nameless = shingle_sets(docs.filter("id IS NULL"), words, percent)
    rows = cut(shingle_sets(docs.filter("id IS NOT NULL"), words, percent))
    known = rows.filter(F.col("cls").isNotNull())

    # One shuffle by cell gives every class the least one that shares a cell with it, and
    # the name of the cell where more than these two do.
    dealt = known.select("cls", F.explode("cells").alias("cell"))
    own = Window.partitionBy("cell")
    shared = dealt.withColumn("low", F.min("cls").over(own)).filter("cls != low")
    several = F.min("cls").over(own) != F.max("cls").over(own)
    shared = shared.select("low", "cls", F.when(several, F.col("cell")).alias("cell"))
    shared = cut(shared.distinct())
    stars = cut(shared.select("low", "cls").distinct().toDF("a", "b"))
    cells = shared.filter("cell IS NOT NULL").select("cell", "cls")

    classes = cut(
        known.join(stars.select("a").union(stars.select("b")).distinct().toDF("cls"), "cls", "left_semi")
        .groupBy("cls")
        .agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("point").alias("point"))
    )

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        ends = pairs.select("a").union(pairs.select("b")).distinct().toDF("cls")
        wanted = cut(classes.join(ends, "cls").select("cls", "id"))
        return cut(_verified(pairs, _sets_of(docs, wanted, words), percent))

    links = verified(_near_stars(stars, classes, percent))
    members = _parted(cells, links)
    drawn = verified(_near_stars(_center_pairs(members), classes, percent))
    links = cut(links.union(drawn))
    members = _parted(members.select("cell", "cls"), links)

    # All pairs, the least class of a cell aside, are searched in what is left.
    held = members.groupBy("cell").agg(F.count("cls").alias("held"))
    several = held.select("cell", F.ceil(F.col("held") / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("cls"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    asked = (
        members.join(several, "cell").withColumn("block", block).withColumn("other", other)
        .join(classes.select("cls", "n", "point"), "cls")
        .select(
            "cell", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
            "block", "cls", "n", "point", "part",
        )
    )
    more = verified(_near_pairs(asked, percent))
    linked = components(links.union(more)).toDF("cls", "part")

    ids = known.groupBy("cls").agg(F.min("id").alias("low"))
    ids = ids.join(linked, "cls", "left").withColumn("part", F.coalesce("part", "cls"))
    least = ids.groupBy("part").agg(F.min("low").alias("component"))
    of_class = ids.join(least, "part").select("cls", "part", "component")
    columns = ["id", "text_key", "n", "part"]
    found = known.select("id", "text_key", "n", "cls").join(of_class, "cls")
    alone = rows.filter(F.col("cls").isNull()).unionByName(nameless)
    alone = alone.withColumn("part", F.lit(None).cast("long"))
    return found.select(*columns, "component").union(alone.select(*columns, "id"))


def similar_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """Id, ``n_shingles`` and ``component_id`` (least id reachable by links) of every row."""
    small_batches(docs.sparkSession, 250)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = _components(docs, words, percent).select("id", "n", "component")
    return found.toDF(id_col, "n_shingles", "component_id")


def keep_one_of_each(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = SHINGLE_WORDS,
    percent: int = PERCENT,
) -> DataFrame:
    """``docs`` with one document of each component, the one of least id.

    Rows equal in id and text are one document. Where the least id stands on several
    texts of its component, the text of the least hash stays; its texts in other
    components are judged there. Texts without words all stay, and so do rows without
    an id, copies too: they can neither be linked nor stand for a component.
    """
    small_batches(docs.sparkSession, 250)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = cut(_components(texts, words, percent)).filter("id IS NOT NULL")
    linked = found.filter("part IS NOT NULL")
    least = linked.filter("id = component")
    first = least.groupBy("part").agg(F.min("text_key").alias("first"))
    later = least.join(first, "part").filter("text_key != first")
    dropped = linked.filter("id != component").select("id", "text_key")
    dropped = dropped.union(later.select("id", "text_key")).distinct()
    repeated = found.groupBy("id").count().filter("count > 1")
    id_, text_key = fresh(docs, "id"), fresh(docs, "text_key")
    gone_key = fresh(docs, "gone_key")
    word, touched = fresh(docs, "place_word"), fresh(docs, "place_bits")
    dropped = cut(dropped)
    ids = dropped.select("id").union(repeated.select("id"))
    places = cut(_places(ids, "id", word, touched))
    marked = _marked(docs, places, id_col, word, touched)
    untouched = marked.filter(~F.col(touched)).drop(touched)
    maybe = marked.filter(F.col(touched)).drop(touched)
    gone = dropped.toDF(id_, gone_key)
    missing = maybe.filter(F.col(id_col).isNull())
    rest = maybe.filter(F.col(id_col).isNotNull()).withColumn(text_key, F.xxhash64(text_col))
    same = (rest[id_col] == gone[id_]) & (rest[text_key] == gone[gone_key])
    rest = rest.join(gone, same, "left_anti").dropDuplicates([id_col, text_key, text_col])
    rest = rest.select(*docs.columns)
    return untouched.union(missing).union(rest).select(*docs.columns)
