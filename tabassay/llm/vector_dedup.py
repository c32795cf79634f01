"""Near copies among vectors by an inverted multi-index.

Each half of the unit vectors has a codebook of its own; the pairs of codes are a
product grid of cells. A vector lies in the cell of its nearest codes and visits cells
in the order of their distance (multi-sequence traversal: a heap that advances in two
sorted lists) until the margin is passed that reaches a true partner with the target
recall. The margin is calibrated on the fitted sample with partners drawn at exactly
the threshold, the hardest ones. In a cell, cosines of its vectors and its visitors are
computed whole, in double precision.

Codebooks are fitted on at most ``sample`` vectors; every vector is indexed. Equal
vectors are one class and are never compared with each other. Cells of many vectors
or visitors are dealt out in blocks. A cell gives counts of links, and links that span
what hangs together in it, never all its pairs.

Defined results: a vector that is null, zero, or holds null or non-finite components
is linked with nothing, and so is a row without an id, whose component is null;
vectors of different lengths are never linked; repeated rows are vectors of their own;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabassay.llm.components import components
from tabassay.llm.tables import cut, small_batches

THRESHOLD = 0.95
TARGET_RECALL = 0.99
SAMPLE = 20_000
#: Vectors of one cell, on average, that the codebooks are made for.
CELL_ROWS = 128
#: Vectors and visitors of one block of a cell.
BLOCK_ROWS, BLOCK_VISITORS = 512, 2048
ROUNDS = 12


def _squares(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances of rows and codes."""
    return np.maximum(
        (x * x).sum(axis=1)[:, None] - 2 * x @ codes.T + (codes * codes).sum(axis=1)[None], 0
    )


def _codebook(x: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from rows drawn with a fixed seed; empty codes stay where they were."""
    codes = x[np.random.default_rng(seed).choice(len(x), size, replace=False)].copy()
    for _ in range(ROUNDS):
        own = _squares(x, codes).argmin(axis=1)
        counts = np.bincount(own, minlength=size)
        sums = np.zeros_like(codes)
        np.add.at(sums, own, x)
        codes[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return codes


def visits(first: np.ndarray, second: np.ndarray, bound: float) -> list[tuple[int, int]]:
    """Cells whose two squared distances add up to ``bound`` at most, nearest first."""
    one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[one].tolist(), second[two].tolist()
    heap, out = [(a[0] + b[0], 0, 0)], []
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > bound:
            break
        out.append((int(one[i]), int(two[j])))
        if j + 1 < len(b):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[0], i + 1, 0))
    return out


@dataclass
class Grid:
    """Codebooks of both halves and the margin of the traversal."""

    first: np.ndarray
    second: np.ndarray
    margin: float = 0.0

    @property
    def cells(self) -> int:
        return len(self.first) * len(self.second)

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _squares(x[:, :half], self.first), _squares(x[:, half:], self.second)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Own cell of each row, the largest distance that it visits, and its distances."""
        one, two = self.distances(x)
        i, j = one.argmin(axis=1), two.argmin(axis=1)
        rows = np.arange(len(x))
        return i * len(self.second) + j, one[rows, i] + two[rows, j] + self.margin, one, two


def fit(sample: np.ndarray, rows: int, threshold: float, recall: float) -> Grid:
    """Codebooks for so many rows, and the margin for this recall at the threshold."""
    width = sample.shape[1]
    size = max(1, min(ceil(sqrt(rows / CELL_ROWS)), len(sample) // 4))
    half = width // 2
    grid = Grid(_codebook(sample[:, :half], size, 1), _codebook(sample[:, half:], size, 2))
    rng = np.random.default_rng(3)
    x = sample[rng.permutation(len(sample))[:4000]]
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-300)
    y = threshold * x + sqrt(1 - threshold**2) * noise
    x_cell, x_bound, x_one, x_two = grid.place(x)
    y_cell, y_bound, y_one, y_two = grid.place(y)
    at, codes = np.arange(len(x)), len(grid.second)
    there = x_one[at, y_cell // codes] + x_two[at, y_cell % codes] - x_bound
    back = y_one[at, x_cell // codes] + y_two[at, x_cell % codes] - y_bound
    # A hair more, as distances of one vector may differ in their last bits.
    grid.margin = float(np.quantile(np.minimum(there, back), recall)) + 1e-9
    return grid


def _units(vectors: list) -> np.ndarray:
    x = np.asarray(np.stack(vectors), dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _forest(one: np.ndarray, two: np.ndarray, total: int) -> np.ndarray:
    """For rows 0..total-1 linked by these pairs, the least row each hangs together with."""
    low = np.arange(total)
    while True:
        least = np.minimum(low[one], low[two])
        after = low.copy()
        np.minimum.at(after, low[one], least)
        np.minimum.at(after, low[two], least)
        np.minimum.at(after, one, least)
        np.minimum.at(after, two, least)
        after = after[after]
        if (after == low).all():
            return low
        low = after


def _linked(group: pd.DataFrame, grid: Grid, threshold: float) -> pd.DataFrame:
    """Links of one block: (cls, links, other)."""
    own = group["own"].to_numpy()
    cls, copies = group["cls"].to_numpy(), group["copies"].to_numpy()
    x = _units(group["vector"].tolist())
    inside, visiting = np.flatnonzero(own), np.flatnonzero(~own)
    if not len(inside) or not len(visiting):
        return pd.DataFrame({"cls": [], "links": [], "other": []}).astype("int64")
    found = x[visiting] @ x[inside].T >= threshold
    v, m = np.nonzero(found)
    v, m = visiting[v], inside[m]
    other = cls[v] != cls[m]
    v, m = v[other], m[other]
    cell, bound, one, two = grid.place(x)
    codes = len(grid.second)
    # Where the vector visits its visitor's cell too, that cell counts the visitor for it.
    returns = one[m, cell[v] // codes] + two[m, cell[v] % codes] <= bound[m]
    links = np.bincount(v, copies[m], minlength=len(cls))
    links += np.bincount(m[~returns], copies[v[~returns]], minlength=len(cls))
    low = _forest(v, m, len(cls))
    some = np.flatnonzero((links > 0) | (low != np.arange(len(cls))))
    # A class may stand here twice, as a vector of the cell and as a visitor of it.
    return pd.DataFrame(
        {"cls": cls[some], "links": links[some].astype(np.int64), "other": cls[low[some]]}
    )


def near_copies(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    recall: float = TARGET_RECALL,
    sample: int = SAMPLE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Id, ``n_links``, ``component_id`` and ``kept`` of every row."""
    spark = vectors.sparkSession
    small_batches(spark)
    value = F.col(vector_col).cast("array<double>")
    sound = (
        F.col("id").isNotNull()
        & F.coalesce(F.exists("vector", lambda c: c != 0), F.lit(False))
        & F.forall("vector", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    )
    rows = vectors.select(F.col(id_col).alias("id"), value.alias("vector"))
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    key = F.when(F.col("sound"), F.xxhash64("vector"))
    rows = cut(rows.withColumn("cls", key))
    known = rows.filter("sound")
    classes = cut(
        known.groupBy("cls").agg(
            F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"),
            F.first("vector").alias("vector"),
        ).withColumn("width", F.size("vector"))
    )
    parts = []
    for width, count in classes.groupBy("width").count().collect():
        same = classes.filter(F.col("width") == width)
        parts.append(_links_of(same, width, count, threshold, recall, sample))
    if not parts:
        parts = [classes.select("cls", F.lit(0).alias("links"), F.col("cls").alias("other"))]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part)
    every = cut(every)
    counted = every.groupBy("cls").agg(F.sum("links").alias("links"))
    linked = components(every.select("cls", "other")).toDF("cls", "part")
    ids = classes.select("cls", "low", "copies").join(linked, "cls", "left")
    ids = ids.withColumn("part", F.coalesce("part", "cls"))
    least = ids.groupBy("part").agg(F.min("low").alias("component"))
    of_class = ids.join(least, "part").join(counted, "cls", "left").select(
        "cls", "component", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")
    )
    found = known.select("id", "cls").join(of_class, "cls").select("id", "n_links", "component")
    alone = rows.filter("not sound").select("id", F.lit(0).cast("long"), "id")
    done = found.union(alone).toDF(id_col, "n_links", "component_id")
    return done.withColumn("kept", F.col(id_col) == F.col("component_id"))


def _links_of(
    classes: DataFrame, width: int, count: int, threshold: float, recall: float, sample: int
) -> DataFrame:
    """Counted links (cls, links, other) of the classes of one width."""
    spark = classes.sparkSession
    hashed = F.pmod(F.xxhash64(F.lit(11), "cls"), F.lit(1 << 30))
    share = min(1.0, sample / count)
    chosen = classes.filter(hashed < int(share * (1 << 30))).select("cls", "vector").toPandas()
    if width < 2 or len(chosen) < 4:
        fitted = np.zeros((1, width))
        grid = Grid(fitted[:, : width // 2], fitted[:, width // 2 :])
    else:
        units = _units(chosen.sort_values("cls")["vector"].tolist())
        grid = fit(units, count, threshold, recall)
    shared = spark.sparkContext.broadcast(grid)

    def visit(batch: pd.DataFrame) -> tuple[np.ndarray, list[list[int]]]:
        grid = shared.value
        cell, bound, one, two = grid.place(_units(batch["vector"].tolist()))
        codes = len(grid.second)
        seen = [
            [i * codes + j for i, j in visits(one[k], two[k], bound[k])] for k in range(len(batch))
        ]
        return cell, seen

    def count_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        size = shared.value.cells
        held, come = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        for batch in batches:
            cell, seen = visit(batch)
            held += np.bincount(cell, minlength=size)
            come += np.bincount(np.concatenate(seen).astype(np.int64), minlength=size)
        some = np.flatnonzero(come)
        yield pd.DataFrame({"cell": some, "held": held[some], "come": come[some]})

    # As many rows as the grid has cells, which the size of the sample bounds.
    sizes = (
        classes.select("vector").mapInPandas(count_up, "cell long, held long, come long")
        .groupBy("cell").agg(F.sum("held").alias("held"), F.sum("come").alias("come")).toPandas()
    )
    blocks = np.ones((grid.cells, 2), dtype=np.int64)
    blocks[sizes["cell"], 0] = -(-sizes["held"].to_numpy() // BLOCK_ROWS)
    blocks[sizes["cell"], 1] = -(-sizes["come"].to_numpy() // BLOCK_VISITORS)
    dealt = spark.sparkContext.broadcast(np.maximum(blocks, 1))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = dealt.value
        for batch in batches:
            cell, seen = visit(batch)
            out = []
            for row, (own, cells) in enumerate(zip(cell.tolist(), seen, strict=True)):
                mark = int(batch["cls"].iat[row])
                rows, visitors = blocks[own]
                out += [(row, own, mark % rows, k, True) for k in range(visitors)]
                for other in cells:
                    rows, visitors = blocks[other]
                    out += [(row, other, k, (mark >> 20) % visitors, False) for k in range(rows)]
            made = pd.DataFrame(out, columns=["row", "cell", "block", "guests", "own"])
            data = batch[["cls", "copies", "vector"]].iloc[made.pop("row")].reset_index(drop=True)
            yield pd.concat([made, data], axis=1)

    kinds = (
        "cell long, block long, guests long, own boolean, cls long, copies long, "
        "vector array<double>"
    )
    placed = classes.select("cls", "copies", "vector").mapInPandas(deal, kinds)

    def link(group: pd.DataFrame) -> pd.DataFrame:
        return _linked(group, shared.value, threshold)

    return placed.groupBy("cell", "block", "guests").applyInPandas(
        link, "cls long, links long, other long"
    )
