"""Exact order statistics and quantiles without sorting or gathering a column.

``percentile`` keeps every distinct value of a column in one task. Here a bounded KLL
sketch proposes a narrow bracket round each wanted rank, a counting aggregate says
exactly how many rows lie before each edge, and the step repeats inside the bracket
until at most ``FINAL_ROWS`` rows are left, which are then sorted. A wrong
sketch costs a further round, never a wrong answer: ranks are placed by exact counts.

Every round is a scan of a few columns with map-side aggregation; only counts and
bracket edges come back to the driver. One round serves about 10^7 rows and each further
round about 200 times as many.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabassay.operators.frames import aggregate

SKETCH_SIZE = 4096
SLACK = 0.002  # bracket half-width, well above the rank error of a sketch of that size
FINAL_ROWS = 50_000  # most rows one task orders, per bracket
SKETCHES_PER_SCAN = 32

Edge = tuple[float, bool]  # a value, and whether rows equal to it count as before the edge


@dataclass
class _Bracket:
    """Rows of one column after edge ``low`` and before edge ``high``."""

    column: str
    low: Edge | None
    high: Edge | None
    below: int
    inside: int
    ranks: list[int] = field(default_factory=list)

    def holds(self, c: Column) -> Column:
        cond = c.isNotNull()
        if self.low is not None:
            value, passed = self.low
            cond = cond & ((c > value) if passed else (c >= value))
        if self.high is not None:
            value, within = self.high
            cond = cond & ((c <= value) if within else (c < value))
        return cond

    def rows(self, c: Column) -> Column:
        return c if self.low is None and self.high is None else F.when(self.holds(c), c)


def _batches(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]


def sketch_quantiles(c: Column, fractions: Sequence[float], size: int = SKETCH_SIZE) -> Column:
    """Approximate values at the given fractions; null when there is no value."""
    sketch = F.kll_sketch_agg_double(c, size)
    wanted = F.array(*[F.lit(float(f)) for f in fractions])
    return F.when(F.count(c) > 0, F.kll_sketch_get_quantile_double(sketch, wanted))


def _targets(b: _Bracket, slack: float) -> list[tuple[float, float]]:
    """Fractions of the bracket's rows to enclose; neighbouring ranks share one pair."""
    groups: list[list[int]] = []
    for rank in b.ranks:
        if groups and rank - groups[-1][0] <= max(1, slack * b.inside / 2):
            groups[-1].append(rank)
        else:
            groups.append([rank])
    last = b.inside - 1
    return [((g[0] - b.below) / last, (g[-1] - b.below) / last) for g in groups]


def _propose(
    df: DataFrame,
    columns: Mapping[str, Column],
    brackets: list[_Bracket],
    size: int,
    slack: float,
) -> list[list[Edge]]:
    """Edges round the wanted ranks, from one sketch per bracket.

    Usually the open interval between two values. Where the sketch shows that a value
    repeats a lot, the edges on both sides of it are counted too, so that a rank inside
    such a run is found at once.
    """
    out = []
    for batch in _batches(brackets, SKETCHES_PER_SCAN):
        exprs = []
        for i, b in enumerate(batch):
            wanted = [
                min(1.0, max(0.0, f))
                for low, high in _targets(b, slack)
                for f in (low - 2 * slack, low - slack, high + slack, high + 2 * slack)
            ]
            v = b.rows(columns[b.column])
            exprs.append(sketch_quantiles(v, wanted, size).alias(str(i)))
        row = df.agg(*exprs).first()
        for i in range(len(batch)):
            values, edges = row[str(i)], set()
            for k in range(0, len(values), 4):
                before, low, high, after = values[k : k + 4]
                edges |= {(low, True), (high, False)}
                if before == low or low == high:
                    edges.add((low, False))
                if after == high or low == high:
                    edges.add((high, True))
            out.append(sorted(edges))
    return out


def _place(
    df: DataFrame,
    columns: Mapping[str, Column],
    work: list[tuple[_Bracket, list[Edge]]],
    riders: list[Column],
) -> tuple[list[_Bracket], dict[tuple[str, int], float], dict[str, Any]]:
    """Cut brackets at the edges and place each rank by exact counts."""
    exprs = []
    for i, (b, edges) in enumerate(work):
        c = columns[b.column]
        v = b.rows(c)
        for j, (value, passed) in enumerate(edges):
            exprs.append(F.count_if((v <= value) if passed else (v < value)).alias(f"e_{i}_{j}"))
    counts = aggregate(df, [*exprs, *riders])
    found: dict[tuple[str, int], float] = {}
    narrower: list[_Bracket] = []
    for i, (b, edges) in enumerate(work):
        before = [counts.pop(f"e_{i}_{j}") for j in range(len(edges))]
        parts: dict[int, _Bracket] = {}
        for rank in b.ranks:
            slot = sum(rank - b.below >= n for n in before)
            low = edges[slot - 1] if slot else b.low
            high = edges[slot] if slot < len(edges) else b.high
            if low and high and low[0] == high[0]:
                found[(b.column, rank)] = low[0]
                continue
            if slot not in parts:
                passed = before[slot - 1] if slot else 0
                upto = before[slot] if slot < len(edges) else b.inside
                parts[slot] = _Bracket(b.column, low, high, b.below + passed, upto - passed)
            parts[slot].ranks.append(rank)
        narrower += parts.values()
    return narrower, found, counts


def _order_few(
    df: DataFrame, columns: Mapping[str, Column], brackets: list[_Bracket]
) -> dict[tuple[str, int], float]:
    """Read the wanted ranks off the few rows inside each bracket, at most ``FINAL_ROWS``."""
    found: dict[tuple[str, int], float] = {}
    for batch in _batches(brackets, SKETCHES_PER_SCAN):
        anywhere = reduce(lambda x, y: x | y, [b.holds(columns[b.column]) for b in batch])
        ordered = df.filter(anywhere).agg(
            *[
                F.sort_array(F.collect_list(b.rows(columns[b.column]))).alias(f"v_{i}")
                for i, b in enumerate(batch)
            ]
        )
        picks = [
            F.get(F.col(f"v_{i}"), F.lit(rank - b.below)).alias(f"{i}_{rank}")
            for i, b in enumerate(batch)
            for rank in b.ranks
        ]
        row = ordered.select(*picks).first()
        for i, b in enumerate(batch):
            found.update({(b.column, rank): row[f"{i}_{rank}"] for rank in b.ranks})
    return found


def select_ranks(
    df: DataFrame,
    columns: Mapping[str, Column],
    counts: Mapping[str, int],
    ranks: Mapping[str, Sequence[int]],
    riders: list[Column] | None = None,
    *,
    sketch_size: int = SKETCH_SIZE,
    slack: float = SLACK,
    final_rows: int = FINAL_ROWS,
) -> tuple[dict[tuple[str, int], float], dict[str, Any]]:
    """The values at the given 0-based ranks of each column's non-null values.

    ``riders`` are aliased aggregates that share the first counting scan.
    """
    riders, ridden = list(riders or []), {}
    found: dict[tuple[str, int], float] = {}
    brackets = [
        _Bracket(c, None, None, 0, counts[c], sorted(set(ranks[c]))) for c in columns if ranks[c]
    ]
    while wide := [b for b in brackets if b.inside > final_rows]:
        narrow = [b for b in brackets if b.inside <= final_rows]
        work = list(zip(wide, _propose(df, columns, wide, sketch_size, slack)))
        narrower, placed, values = _place(df, columns, work, riders)
        ridden.update(values)
        found.update(placed)
        brackets, riders = narrow + narrower, []
    if riders:
        ridden.update(aggregate(df, riders))
    if brackets:
        found.update(_order_few(df, columns, brackets))
    return found, ridden


def exact_quantiles(
    df: DataFrame,
    columns: Mapping[str, Column],
    probs: Sequence[float],
    counts: Mapping[str, int] | None = None,
    riders: list[Column] | None = None,
    **options: Any,
) -> tuple[dict[str, dict[float, float | None]], dict[str, Any]]:
    """Linearly interpolated quantiles per column, null where a column has no value."""
    if counts is None:
        row = aggregate(df, [F.count(c).alias(str(i)) for i, c in enumerate(columns.values())])
        counts = {n: row[str(i)] for i, n in enumerate(columns)}
    places = {c: {p: p * (counts[c] - 1) for p in probs} for c in columns if counts[c]}
    ranks = {
        c: sorted({r for at in places.get(c, {}).values() for r in (math.floor(at), math.ceil(at))})
        for c in columns
    }
    found, ridden = select_ranks(df, columns, counts, ranks, riders, **options)
    out: dict[str, dict[float, float | None]] = {}
    for c in columns:
        out[c] = dict.fromkeys(probs)
        for p, at in places.get(c, {}).items():
            low, high = found[(c, math.floor(at))], found[(c, math.ceil(at))]
            out[c][p] = low if low == high else low + (high - low) * (at - math.floor(at))
    return out, ridden


def kth_smallest(df: DataFrame, c: Column, k: int, count: int, **options: Any) -> float:
    """The value with exactly ``k`` rows before it in sorted order."""
    return select_ranks(df, {"c": c}, {"c": count}, {"c": [k]}, **options)[0][("c", k)]
