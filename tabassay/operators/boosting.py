"""Second-order gradient boosting on binned features.

Every row carries a margin for each output. A round takes the first and second derivative
of the loss at the margins, and grows a tree of every output level by level: one pass
sums both by (model, output, node, feature, bin), and a node is split where the regularised
gain is the greatest, ties to the first feature and the lowest edge. A leaf weighs
-G / (H + penalty). K classes take K trees and still one pass a level.

Several training tables, such as the folds of a cross-validation, are fitted side by side:
their rows are one table with the model's number, and each pass serves all of them.

Rows whose features all fall into the same bins stay together in every tree, so they are
one row with their number and mean label (or one for each class): a round works on at most
as many rows as there are combinations of bins, whatever the table's size.

Rows never leave the executors. They lie in blocks of bytes that a pass reads as arrays; the
tree that grows travels with the pass and not in its plan, so that plans, which the driver
keeps for a while, stay small. What reaches the driver is bounded by models, outputs, nodes,
features and bins; only the derivatives' sums are shuffled. Margins are cut from their
lineage every few rounds through the shared checkpoint folder.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabassay.operators.binning import gathered, tasks_worth
from tabassay.session import enable_checkpoints

ROUNDS_PER_CHECKPOINT = 10
#: Rows of one model, as bytes: a pass only copies them.
BLOCK = "model int, bins binary, y binary, n binary, margins binary"
#: Sums of all tasks that the driver may add up itself.
FEW_CELLS = 250_000
#: The least second derivative of a row, so that no sum of them is zero.
LEAST = 1e-16
_ACCURACY = 10_000


def derivatives(objective: str, margins: Column, label: Column) -> Column:
    """An array of (g, h), the loss's two derivatives at the margin of every output."""
    if objective == "squared":
        return F.array(F.struct((margins[0] - label).alias("g"), F.lit(1.0).alias("h")))
    if objective == "logistic":
        p = 1.0 / (1.0 + F.exp(-margins[0]))
        second = F.greatest(p * (1.0 - p), F.lit(LEAST))
        return F.array(F.struct((p - label).alias("g"), second.alias("h")))
    powers = F.transform(margins, lambda m: F.exp(m - F.array_max(margins)))
    total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)

    def both(power: Column, k: Column) -> Column:
        p = power / total
        hit = (k == label.cast("int")).cast("double")
        return F.struct(
            (p - hit).alias("g"), F.greatest(2.0 * p * (1.0 - p), F.lit(LEAST)).alias("h")
        )

    return F.transform(powers, both)


def slopes(objective: str, margins: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same two derivatives of many rows at once, a column for every output."""
    if objective == "squared":
        return margins - label[:, None], np.ones_like(margins)
    if objective == "logistic":
        with np.errstate(over="ignore"):  # a chance of zero
            p = 1.0 / (1.0 + np.exp(-margins))
        return p - label[:, None], np.maximum(p * (1.0 - p), LEAST)
    powers = np.exp(margins - margins.max(axis=1, keepdims=True))
    p = powers / powers.sum(axis=1, keepdims=True)
    hit = np.arange(margins.shape[1]) == label.astype(int)[:, None]
    return p - hit, np.maximum(2.0 * p * (1.0 - p), LEAST)


def start_margins(objective: str, shares: Sequence[float], mean: float) -> list[float]:
    """Margins before the first tree: the label's mean, or the logarithms of class shares."""
    if objective == "squared":
        return [mean]
    kept = np.clip(shares, 1e-6, 1 - 1e-6)
    if objective == "logistic":
        return [float(np.log(kept[1] / (1 - kept[1])))]
    return np.log(kept).tolist()


@dataclass
class Settings:
    """How trees grow."""

    rounds: int = 100
    step: float = 0.1
    depth: int = 6
    penalty: float = 1.0
    least_gain: float = 0.0
    least_weight: float = 1.0
    bins: int = 64


@dataclass
class Split:
    """Places of the best splits of a level, an entry for each tree and node."""

    feature: np.ndarray
    edge: np.ndarray
    gain: np.ndarray


def weights_of(sums: np.ndarray, settings: Settings) -> np.ndarray:
    """Weights of leaves with these sums of (g, h)."""
    g, h = sums[..., 0], sums[..., 1]
    return np.where(h > 0, -g / (h + settings.penalty + LEAST), 0.0)


def best_splits(sums: np.ndarray, settings: Settings) -> tuple[Split, np.ndarray]:
    """The best split of every (tree, node), -1 where none gains, and its sides' sums.

    ``sums`` has the axes tree, node, feature, bin and (g, h); the sides' sums have the
    axes tree, child and (g, h). A node that is not split is its own left child.
    """
    left = np.cumsum(sums, axis=3)[:, :, :, :-1]
    whole = sums.sum(axis=3)
    right = whole[:, :, :, None] - left

    def score(x: np.ndarray) -> np.ndarray:
        return x[..., 0] ** 2 / (x[..., 1] + settings.penalty + LEAST)

    gain = 0.5 * (score(left) + score(right) - score(whole)[..., None]) - settings.least_gain
    least = max(settings.least_weight, LEAST)
    gain[(left[..., 1] < least) | (right[..., 1] < least)] = -np.inf
    trees, nodes, features, edges = gain.shape
    flat = gain.reshape(trees, nodes, features * edges)
    best = flat.argmax(axis=2)
    top = np.take_along_axis(flat, best[..., None], axis=2)[..., 0]
    splits = top > 1e-12
    feature, edge = best // edges, best % edges
    at = (np.arange(trees)[:, None], np.arange(nodes)[None], np.where(splits, feature, 0), edge)
    # All features of a node hold the same rows; the first one's sums are the node's.
    sides = np.stack(
        [
            np.where(splits[..., None], left[at], whole[:, :, 0]),
            np.where(splits[..., None], right[at], 0.0),
        ],
        axis=2,
    )
    split = Split(
        np.where(splits, feature, -1), np.where(splits, edge, -1), np.where(splits, top, 0.0)
    )
    return split, sides.reshape(trees, 2 * nodes, 2)


def feature_edges(frame: DataFrame, bins: int, width: int) -> list[list[float]]:
    """Edges of the bins of every feature of ``x``: distinct values at even ranks."""
    shares = [k / bins for k in range(1, bins)]
    found = (
        frame.select(F.posexplode("x").alias("feature", "value"))
        .groupBy("feature")
        .agg(F.percentile_approx("value", shares, _ACCURACY).alias("edges"))
        .collect()
    )
    edges = [[0.0] for _ in range(width)]
    for row in found:
        finite = sorted({float(e) for e in row["edges"] or [] if np.isfinite(e)})
        edges[row["feature"]] = finite or [0.0]
    return edges


def _binned(frame: DataFrame, edges: Sequence[Sequence[float]], by_label: bool) -> DataFrame:
    """Rows of equal ``bins``, the number of edges up to each feature's value, as one row.

    ``n`` is their number and ``y`` their mean label; with ``by_label`` every label has a row
    of its own.
    """
    names = [f"x_{i}" for i in range(len(edges))]
    bins = [f"b_{i}" for i in range(len(edges))]
    wide = frame.select("y", *[F.coalesce(F.get("x", i), F.lit(0.0)).alias(n) for i, n in enumerate(names)])
    splits = [[float("-inf"), *e, float("inf")] for e in edges]
    bucketizer = Bucketizer(
        splitsArray=splits, inputCols=names, outputCols=bins, handleInvalid="keep"
    )
    binned = bucketizer.transform(wide).select(
        "y", F.array(*[F.col(b).cast("int") for b in bins]).alias("bins")
    )
    counted = F.count(F.lit(1)).cast("double").alias("n")
    if by_label:
        return binned.groupBy("bins", "y").agg(counted)
    return binned.groupBy("bins").agg(F.avg("y").alias("y"), counted)


def _nodes(bins: np.ndarray, levels: Sequence[Split], tree: int) -> np.ndarray:
    """The node of every row below the levels of a tree."""
    node, every = np.zeros(len(bins), dtype=np.int64), np.arange(len(bins))
    for level in levels:
        feature = level.feature[tree][node]
        # A node without a split has feature -1: its rows go to the left.
        right = (feature >= 0) & (bins[every, feature] > level.edge[tree][node])
        node = 2 * node + right
    return node


def _packed(state: DataFrame, starts: Sequence[Sequence[float]]) -> DataFrame:
    """The rows of a model in one batch as the bytes of one block, with their start margins."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            models, y, n = (batch.column(c).to_numpy() for c in ("model", "y", "n"))
            bins = batch.column("bins").flatten().to_numpy().reshape(batch.num_rows, -1)
            for model in np.unique(models):
                own = models == model
                margins = np.tile(np.asarray(starts[model], dtype=float), (own.sum(), 1))
                yield _block(int(model), bins[own], y[own], n[own], margins)

    return state.select("model", "bins", "y", "n").mapInArrow(pack, BLOCK)


def _block(model: int, *parts: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([part.tobytes()], pa.binary()) for part in parts]
    return pa.RecordBatch.from_arrays(
        [pa.array([model], pa.int32()), *columns], ["model", "bins", "y", "n", "margins"]
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, ...]]:
    """Model, bins, labels, numbers and margins of each block, a row of them for each row."""
    for batch in batches:
        for model, bins, y, n, margins in zip(*batch.columns, strict=True):
            y = np.frombuffer(y.as_buffer())
            yield (
                model.as_py(), np.frombuffer(bins.as_buffer(), dtype=np.int32).reshape(len(y), -1), y,
                np.frombuffer(n.as_buffer()), np.frombuffer(margins.as_buffer()).reshape(len(y), -1),
            )


class _Growth:
    """Trees of several models, level by level and round by round."""

    def __init__(
        self, frames: Sequence[DataFrame], objective: str, classes: int, settings: Settings
    ):
        self.objective, self.settings = objective, settings
        self.outputs = classes if objective == "softmax" else 1
        self.models = len(frames)
        self.trees = self.models * self.outputs
        rows = [f.select(F.col("y"), F.col("x")) for f in frames]
        shares = [F.avg((F.col("y") == k).cast("double")) for k in range(classes)]
        self.starts, widths, self.edges = [], [], []
        for frame in rows:
            first = frame.agg(F.max(F.size("x")), F.avg("y"), *shares).first()
            if first[1] is None:
                raise ValueError("there is no training row")
            widths.append(first[0])
            self.starts.append(start_margins(objective, first[2:], first[1]))
        self.width = max(widths)
        for frame in rows:
            self.edges.append(feature_edges(frame, settings.bins, self.width))
        self.bins = max(len(e) for edges in self.edges for e in edges) + 2  # the last is NaN's
        states = [
            _binned(frame, edges, objective == "softmax").selectExpr(f"{m} AS model", "y", "n", "bins")
            for m, (frame, edges) in enumerate(zip(rows, self.edges, strict=True))
        ]
        self.state = states[0]
        for other in states[1:]:
            self.state = self.state.union(other)
        self.state = gathered(self.state)

    def _sums(self, levels: Sequence[Split], active: np.ndarray) -> np.ndarray:
        """Sums of g and h by tree, node, feature and bin, of the active nodes below ``levels``."""
        objective, outputs, width, bins = self.objective, self.outputs, self.width, self.bins
        cells = active.shape[1] * width * bins

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            for model, places, y, n, margins in _blocks(batches):
                g, h = slopes(objective, margins, y)
                for k in range(outputs):
                    tree = model * outputs + k
                    node = _nodes(places, levels, tree)
                    own = active[tree][node]
                    cell = (node[own, None] * width + np.arange(width)) * bins + places[own]
                    total = totals.setdefault(tree, np.zeros((2, cells)))
                    for sums, one in zip(total, (g, h), strict=True):
                        each = np.repeat(one[own, k] * n[own], width)
                        sums += np.bincount(cell.ravel(), each, minlength=cells)
            for tree, (g, h) in totals.items():
                at = np.flatnonzero(h)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tree * cells + at), pa.array(g[at]), pa.array(h[at])], ["at", "g", "h"]
                )

        found = self.blocks.mapInArrow(add, "at long, g double, h double")
        if self.tasks * self.trees * cells > FEW_CELLS:
            found = found.groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
        table = found.toArrow()
        at, size = table["at"].to_numpy(), self.trees * cells
        out = [np.bincount(at, table[c].to_numpy(), minlength=size) for c in ("g", "h")]
        return np.stack(out, axis=1).reshape(self.trees, active.shape[1], width, bins, 2)

    def _moved(self, levels: Sequence[Split], leaves: np.ndarray) -> DataFrame:
        """The blocks with margins moved by the leaves of their trees."""
        outputs = self.outputs

        def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for model, bins, y, n, margins in _blocks(batches):
                trees = range(model * outputs, (model + 1) * outputs)
                steps = [leaves[tree][_nodes(bins, levels, tree)] for tree in trees]
                yield _block(model, bins, y, n, margins + np.stack(steps, axis=1))

        return self.blocks.mapInArrow(move, BLOCK)

    def grow(self) -> list[list[dict[str, Any]]]:
        """One tree of every (model, output), and the margins that follow."""
        levels: list[Split] = []
        active = np.ones((self.trees, 1), dtype=bool)
        sums = self._sums(levels, active)
        own = sums[:, :, 0].sum(axis=2)
        for level in range(self.settings.depth):
            if level:
                sums = self._sums(levels, active)
            splits, sides = best_splits(sums, self.settings)
            split = splits.feature >= 0
            if not split.any():
                break
            levels.append(splits)
            # What is no longer summed keeps the sums it had.
            kept = np.stack([own, np.zeros_like(own)], axis=2).reshape(self.trees, -1, 2)
            active = np.repeat(split, 2, axis=1)
            own = np.where(active[..., None], sides, kept)
        leaves = weights_of(own, self.settings) * self.settings.step
        self.moved = self._moved(levels, leaves)
        return [
            [
                {
                    "features": [s.feature[t].tolist() for s in levels],
                    "edges": [
                        [
                            self.edges[m][f][e] if f >= 0 else 0.0
                            for f, e in zip(s.feature[t].tolist(), s.edge[t].tolist(), strict=True)
                        ]
                        for s in levels
                    ],
                    "gains": [s.gain[t].tolist() for s in levels],
                    "leaves": leaves[t].tolist(),
                }
                for t in range(m * self.outputs, (m + 1) * self.outputs)
            ]
            for m in range(self.models)
        ]

    def fit(self) -> list[list[list[dict[str, Any]]]]:
        """For each model its rounds, each with a tree of every output."""
        made: list[list[list[dict[str, Any]]]] = [[] for _ in range(self.models)]
        self.tasks = tasks_worth(self.state.count())
        enable_checkpoints(self.state.sparkSession)
        self.blocks = _packed(self.state, self.starts).checkpoint()
        self.state.unpersist()
        before = None
        for number in range(1, self.settings.rounds + 1):
            trees = self.grow()
            if before is not None:  # the round has read the margins made from it
                before.unpersist()
            before = self.blocks
            for model, own in zip(made, trees, strict=True):
                model.append(own)
            if number % ROUNDS_PER_CHECKPOINT == 0 and number < self.settings.rounds:
                self.blocks = self.moved.checkpoint()
            else:
                self.blocks = self.moved.persist()
        for rows in (before, self.blocks):
            if rows is not None:
                rows.unpersist()
        return made


class _Common(HasFeaturesCol, HasLabelCol, HasPredictionCol):
    objective = Param(Params._dummy(), "objective", "squared, logistic or softmax", TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)


class SecondOrderBoosting(Estimator, _Common, HasMaxIter, DefaultParamsReadable, DefaultParamsWritable):
    """Estimator of boosted trees grown on both derivatives of the loss."""

    stepSize = Param(Params._dummy(), "stepSize", "share of each tree", TypeConverters.toFloat)
    maxDepth = Param(Params._dummy(), "maxDepth", "levels of splits", TypeConverters.toInt)
    penalty = Param(Params._dummy(), "penalty", "added to the second derivatives", TypeConverters.toFloat)
    leastGain = Param(Params._dummy(), "leastGain", "taken from every gain", TypeConverters.toFloat)
    leastWeight = Param(Params._dummy(), "leastWeight", "least second derivatives of a child", TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "bins of a feature", TypeConverters.toInt)

    @keyword_only
    def __init__(self, **kwargs: Any):
        super().__init__()
        self._setDefault(
            objective="squared", classes=2, maxIter=100, stepSize=0.1, maxDepth=6, penalty=1.0,
            leastGain=0.0, leastWeight=1.0, maxBins=64, predictionCol="prediction",
        )
        self._set(**self._input_kwargs)

    @keyword_only
    def setParams(self, **kwargs: Any) -> SecondOrderBoosting:
        return self._set(**self._input_kwargs)

    def _settings(self) -> Settings:
        names = ("maxIter", "stepSize", "maxDepth", "penalty", "leastGain", "leastWeight", "maxBins")
        return Settings(*[self.getOrDefault(n) for n in names])

    def fit_together(self, tables: Sequence[DataFrame]) -> list[BoostedTrees]:
        """A model of each table, grown in the same jobs."""
        objective, classes = self.getOrDefault("objective"), self.getOrDefault("classes")
        frames = [
            t.select(
                F.col(self.getLabelCol()).cast("double").alias("y"),
                vector_to_array(F.col(self.getFeaturesCol())).alias("x"),
            )
            for t in tables
        ]
        growth = _Growth(frames, objective, classes, self._settings())
        made = growth.fit()
        return [
            BoostedTrees(
                featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(),
                predictionCol=self.getPredictionCol(), objective=objective, classes=classes,
                trees=json.dumps(
                    {
                        "start": start, "rounds": rounds,
                        "width": len(table.select(self.getFeaturesCol()).first()[0]),
                    }
                ),
            )
            for table, start, rounds in zip(tables, growth.starts, made, strict=True)
        ]

    def _fit(self, dataset: DataFrame) -> BoostedTrees:
        return self.fit_together([dataset])[0]


def tree_margins(
    x: np.ndarray, start: Sequence[float], rounds: Sequence[Sequence[dict[str, Any]]]
) -> np.ndarray:
    """Margins of many rows of features, all rows going down one tree together."""
    out = np.tile(np.asarray(start, dtype=float), (len(x), 1))
    every = np.arange(len(x))
    for trees in rounds:
        for k, tree in enumerate(trees):
            node = np.zeros(len(x), dtype=np.int64)
            for features, edges in zip(tree["features"], tree["edges"], strict=True):
                feature = np.asarray(features)[node]
                right = (feature >= 0) & ~(x[every, feature] < np.asarray(edges)[node])
                node = 2 * node + right
            out[:, k] += np.asarray(tree["leaves"])[node]
    return out


class BoostedTrees(Model, _Common, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees; scores in Arrow batches, all rows of a batch at once."""

    trees = Param(Params._dummy(), "trees", "start margins and trees as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, **kwargs: Any):
        super().__init__()
        self._set(**self._input_kwargs)

    @property
    def content(self) -> dict[str, Any]:
        return json.loads(self.getOrDefault("trees"))

    @property
    def featureImportances(self) -> DenseVector:
        """Share of each feature in the gains of all splits."""
        content = self.content
        total = np.zeros(content["width"])
        for trees in content["rounds"]:
            for tree in trees:
                for features, gains in zip(tree["features"], tree["gains"], strict=True):
                    at = np.asarray(features)
                    np.add.at(total, at[at >= 0], np.asarray(gains)[at >= 0])
        return DenseVector(total / total.sum() if total.sum() > 0 else total)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        content = self.content
        start, rounds = content["start"], content["rounds"]

        @F.pandas_udf("array<double>")
        def margins(x: pd.Series) -> pd.Series:
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(list(tree_margins(np.stack(x.to_list()), start, rounds)))

        found = margins(vector_to_array(F.col(self.getFeaturesCol())))
        prediction = self.getPredictionCol()
        objective = self.getOrDefault("objective")
        if objective == "squared":
            return dataset.withColumn(prediction, found[0])
        scored = dataset.withColumn("rawPrediction", found)
        raw = F.col("rawPrediction")
        if objective == "logistic":
            p = 1.0 / (1.0 + F.exp(-raw[0]))
            chances = F.array(1.0 - p, p)
            raw = F.array(-raw[0], raw[0])
        else:
            powers = F.transform(raw, lambda m: F.exp(m - F.array_max(raw)))
            total = F.aggregate(powers, F.lit(0.0), lambda a, x: a + x)
            chances = F.transform(powers, lambda e: e / total)
        scored = scored.withColumns({"probability": chances, "rawPrediction": raw})
        top = F.array_position("probability", F.array_max("probability")) - 1
        return scored.withColumns(
            {
                prediction: top.cast("double"),
                "probability": array_to_vector("probability"),
                "rawPrediction": array_to_vector("rawPrediction"),
            }
        )
