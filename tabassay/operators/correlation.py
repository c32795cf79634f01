"""Pearson correlation over the rows where both columns are present."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabassay.functions.families import columns_of
from tabassay.functions.missing import quoted
from tabassay.functions.stats import correlation
from tabassay.operators.frames import AGGREGATES_PER_SCAN, aggregate, to_frame
from tabassay.operators.profile import doubles

MANY_COLUMNS = 16
COLUMNS_PER_SCAN = 16
STRONG = 0.7

PAIR_SCHEMA = "feature1 string, feature2 string, correlation double"


def _dense_block(df: DataFrame, names: Sequence[str]) -> dict[tuple[str, str], float | None]:
    """All pairs of many columns without missing values, as one tree aggregation."""
    vectors = VectorAssembler(inputCols=list(names), outputCol="__v").transform(df.select(*names))
    matrix = Correlation.corr(vectors.select("__v"), "__v").first()[0].toArray()
    out: dict[tuple[str, str], float | None] = {}
    for i, j in combinations(range(len(names)), 2):
        r = float(matrix[i, j])
        out[(names[i], names[j])] = None if math.isnan(r) else r
    return out


def _masked_sums(sums: _Sums, names: Sequence[str]) -> np.ndarray:
    """Sums over all pairs of many columns with missing values, in one tree aggregation.

    Each column becomes its mask, its centred value and the square of that, both 0 where
    it is missing. The products of these, summed over the rows, are all that the
    correlations over shared rows need; they follow from the covariances.
    """
    made = []
    for n in names:
        s = sums.slots[n]
        d = F.coalesce(F.col(s) - F.lit(sums.base["mean_" + s]), F.lit(0.0))
        made += [F.col(s).isNotNull().cast("double"), d, d * d]
    parts = [c.alias(f"x{i}") for i, c in enumerate(made)]
    assembler = VectorAssembler(inputCols=[f"x{i}" for i in range(len(parts))], outputCol="__v")
    vectors = assembler.transform(sums.narrow.select(*parts)).select("__v")
    facts = vectors.select(Summarizer.metrics("mean", "std").summary(F.col("__v")).alias("f"))
    mean, spread = (np.array(x.toArray()) for x in facts.first()["f"])
    matrix = np.nan_to_num(Correlation.corr(vectors, "__v").first()[0].toArray())
    np.fill_diagonal(matrix, (spread > 0).astype(float))
    rows = sums.base["rows"]
    return (rows - 1) * matrix * np.outer(spread, spread) + rows * np.outer(mean, mean)


class _Sums:
    """Centred sums over the rows where two columns are present, each needed once.

    A column without missing values adds nothing to a mask, so most pairs of a complete
    table cost one product sum each and stay inside one compiled aggregate.
    """

    def __init__(self, df: DataFrame, names: Sequence[str]):
        cols = doubles(df, names)
        self.slots = {n: f"c{i}" for i, n in enumerate(names)}
        self.narrow = df.select(*[cols[n].alias(s) for n, s in self.slots.items()])
        exprs = [F.count(F.lit(1)).alias("rows")]
        for s in self.slots.values():
            exprs += [
                F.count(s).alias(f"n_{s}"),
                F.avg(s).alias(f"mean_{s}"),
                F.min(s).alias(f"min_{s}"),
                F.max(s).alias(f"max_{s}"),
            ]
        self.base: dict[str, float] = aggregate(self.narrow, exprs)
        self.exprs: dict[str, Column] = {}
        self.values: dict[str, float] = {}

    def complete(self, name: str) -> bool:
        return self.base["n_" + self.slots[name]] == self.base["rows"]

    def varies(self, name: str) -> bool:
        s = self.slots[name]
        return self.base["n_" + s] > 0 and self.base["min_" + s] < self.base["max_" + s]

    def _sum(self, power: str, s: str, other: str) -> str:
        """Sum of ``s`` centred, to a power, where ``other`` is present too."""
        free = self.base["n_" + other] == self.base["rows"]
        key = f"{power}_{s}" if free else f"{power}_{s}_{other}"
        if key not in self.exprs:
            d = F.col(s) - F.lit(self.base["mean_" + s])
            d = {"n": F.when(F.col(s).isNotNull(), 1.0), "s": d, "q": d * d}[power]
            d = d if free else F.when(F.col(other).isNotNull(), d)
            self.exprs[key] = F.sum(d).alias(key)
        return key

    def want(self, a: str, b: str) -> tuple[str, ...]:
        """Names of the sums that make up one correlation."""
        x, y = self.slots[a], self.slots[b]
        both = f"p_{x}_{y}"
        dx = F.col(x) - F.lit(self.base["mean_" + x])
        dy = F.col(y) - F.lit(self.base["mean_" + y])
        self.exprs[both] = F.sum(dx * dy).alias(both)
        n = self._sum("n", y, x) if self.complete(a) else self._sum("n", x, y)
        return (
            n,
            self._sum("s", x, y), self._sum("s", y, x),
            self._sum("q", x, y), self._sum("q", y, x),
            both,
        )

    def compute(self) -> None:
        self.values.update(aggregate(self.narrow, list(self.exprs.values())))


def correlations(
    df: DataFrame, pairs: Sequence[tuple[str, str]]
) -> tuple[dict[tuple[str, str], float | None], dict[str, bool]]:
    """Correlation of the given pairs, and which columns vary.

    Many complete columns go through one tree aggregation of their products. All other
    pairs are sums about the column means. Where a column hardly varies on the rows a
    pair shares, the sums cancel, and the pair is computed again the stable way.
    """
    names = list(dict.fromkeys(n for p in pairs for n in p))
    sums = _Sums(df, names)
    varies = {n: sums.varies(n) for n in names}
    found: dict[tuple[str, str], float | None] = {
        p: None for p in pairs if not (varies[p[0]] and varies[p[1]])
    }
    dense = [n for n in names if varies[n] and sums.complete(n)]
    open_pairs = [p for p in pairs if p not in found]
    if len(dense) > MANY_COLUMNS and len(open_pairs) > 4 * AGGREGATES_PER_SCAN:
        block = _dense_block(sums.narrow, [sums.slots[n] for n in dense])
        back = {s: n for n, s in sums.slots.items()}
        known = {frozenset((back[a], back[b])): r for (a, b), r in block.items()}
        found.update({p: known[frozenset(p)] for p in open_pairs if frozenset(p) in known})
    rest = [p for p in open_pairs if p not in found]
    if len(rest) > 4 * AGGREGATES_PER_SCAN:
        used = list(dict.fromkeys(n for p in rest for n in p))
        gram, place = _masked_sums(sums, used), {n: 3 * i for i, n in enumerate(used)}
        values = {
            (a, b): [
                float(gram[i, j]), float(gram[i + 1, j]), float(gram[j + 1, i]),
                float(gram[i + 2, j]), float(gram[j + 2, i]), float(gram[i + 1, j + 1]),
            ]
            for a, b in rest for i, j in [(place[a], place[b])]
        }
    else:
        parts = {p: sums.want(*p) for p in rest}
        sums.compute()
        values = {p: [sums.values[k] or 0.0 for k in keys] for p, keys in parts.items()}
    unstable = []
    for p, (n, sx, sy, qx, qy, sxy) in values.items():
        if n < 0.5:
            found[p] = None
            continue
        vx, vy = qx / n - (sx / n) ** 2, qy / n - (sy / n) ** 2
        if min(vx / qx if qx else 0.0, vy / qy if qy else 0.0) * n < 1e-9:
            unstable.append(p)
            continue
        r = (sxy / n - (sx / n) * (sy / n)) / math.sqrt(vx * vy)
        found[p] = r if math.isfinite(r) else None
    for start in range(0, len(unstable), COLUMNS_PER_SCAN):
        chunk = unstable[start : start + COLUMNS_PER_SCAN]
        row = sums.narrow.agg(
            *[
                correlation(F.col(sums.slots[a]), F.col(sums.slots[b])).alias(f"r_{i}")
                for i, (a, b) in enumerate(chunk)
            ]
        ).first()
        found.update({p: row[f"r_{i}"] for i, p in enumerate(chunk)})
    return found, varies


def correlation_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The full matrix as rows ``(feature1, feature2, correlation)``."""
    names = columns_of(df, "numeric") if columns is None else list(columns)
    if len(names) < 2:
        raise ValueError("not enough numeric columns for correlation analysis")
    found, varies = correlations(df, list(combinations(names, 2)))
    rows = [(n, n, 1.0 if varies[n] else None) for n in names]
    for (a, b), r in found.items():
        rows += [(a, b, r), (b, a, r)]
    return to_frame(df.sparkSession, rows, PAIR_SCHEMA)


def strong_pairs_of(matrix: DataFrame, order: Sequence[str], limit: float = STRONG) -> DataFrame:
    """Pairs of the upper triangle with ``|r|`` above ``limit``, strongest first."""
    place = F.array(*[F.lit(n) for n in order])
    return (
        matrix.filter(
            (F.array_position(place, F.col("feature1")) < F.array_position(place, F.col("feature2")))
            & (F.abs("correlation") > limit)
        )
        .orderBy(F.abs("correlation").desc(), "feature1", "feature2")
    )


def strong_correlations(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = columns_of(df, "numeric") if columns is None else list(columns)
    return strong_pairs_of(correlation_matrix(df, names), names)


def target_correlations(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Rows ``(feature, correlation)`` against one target."""
    found, _ = correlations(df, [(f, target) for f in features])
    rows = [(f, found[(f, target)]) for f in features]
    return to_frame(df.sparkSession, rows, "feature string, correlation double")


def class_target_strengths(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Rows ``(feature, correlation)``: correlation ratios against a class target.

    The ratio is the root of the share of a feature's variance that lies between the
    classes. Classes are summed first, so their number may grow with the table.
    """
    known = df.filter(quoted(target).isNotNull())
    values = {f: F.nanvl(quoted(f).cast("double"), F.lit(None).cast("double")) for f in features}
    means = aggregate(known, [F.avg(v).alias(f"m_{i}") for i, v in enumerate(values.values())])
    sums = []
    for i, value in enumerate(values.values()):
        moved = value - F.lit(means[f"m_{i}"]).cast("double")
        sums += [
            F.count(value).alias(f"n_{i}"), F.sum(moved).alias(f"s_{i}"),
            F.sum(moved * moved).alias(f"q_{i}"),
        ]
    by_class = known.groupBy(quoted(target)).agg(*sums)
    totals = []
    for i in range(len(values)):
        n, s = F.col(f"n_{i}"), F.col(f"s_{i}")
        rest = F.try_divide(F.sum(s) * F.sum(s), F.sum(n))
        totals += [
            (F.sum(F.try_divide(s * s, n)) - rest).alias(f"b_{i}"),
            (F.sum(f"q_{i}") - rest).alias(f"t_{i}"),
        ]
    found = aggregate(by_class, totals)
    rows = []
    for i, f in enumerate(features):
        between, total = found[f"b_{i}"], found[f"t_{i}"]
        defined = total is not None and total > 0 and math.isfinite(total)
        rows.append((f, math.sqrt(min(1.0, max(0.0, between / total))) if defined else None))
    return to_frame(df.sparkSession, rows, "feature string, correlation double")


def feature_target_rank(
    df: DataFrame, target: str, features: Sequence[str] | None = None, limit: int = 10
) -> DataFrame:
    """Numeric features by strength against the target; undefined ones last.

    A numeric target takes the absolute correlation, any other the correlation ratio
    of its classes.
    """
    names = features or [c for c in columns_of(df, "numeric") if c != target]
    numeric = isinstance(df.schema[target].dataType, T.NumericType)
    found = (target_correlations if numeric else class_target_strengths)(df, target, names)
    strength = F.abs("correlation")
    w = Window.partitionBy(F.lit(0)).orderBy(strength.desc_nulls_last(), "feature")
    ranked = found.select(
        F.row_number().over(w).alias("rank"), "feature", "correlation", strength.alias("importance")
    )
    return ranked.filter(F.col("rank") <= limit)
