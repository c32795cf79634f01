"""Rows of equal bins as one weighted row, for the trees of ``pyspark.ml``.

Spark's trees see a feature only by its bin, between thresholds that they take from the
values of some ten thousand rows. So rows whose features fall into the same bins are one row
to them: here they become one, with their number as weight and, for a number, their mean
label (a tree that splits on variance needs sums of labels alone); every class keeps a row of
its own. A tree then works on at most as many rows as there are combinations of bins.

A forest draws every row for every tree, as often as a Poisson number of mean one says. All
rows of one combination and class are drawn as often as one Poisson number of mean n says,
so that a forest of classes grows on the same bootstrap, each tree a fit of its own. For a
forest of numbers the draws of all rows are made, and added up with their labels.

The thresholds are found as ``RandomForest.findSplitsForContinuousFeature`` documents it:
halfway between neighbours where all distinct values fit, at even ranks otherwise.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, inheritable_thread_target, keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import Bucketizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabassay.operators.frames import ROWS_PER_TASK

BINNED = "__binned_features"
WEIGHT = "__weight"
DRAWS = "__draws"
MEANS = "__means"
TREES_AT_ONCE = 8
#: The fixed costs of a fit, in rows of its pass, and how many rows one of all must stand for.
ROWS_OF_A_FIT = 50_000
WORTH = 20
#: Rows that Spark takes thresholds from, at least.
ENOUGH_ROWS = 10_000


def tasks_worth(rows: int) -> int:
    """Tasks that so many rows are worth."""
    return max(-(-rows // ROWS_PER_TASK), 1)


def gathered(rows: DataFrame) -> DataFrame:
    """Grouped rows, persisted in as many tasks as they are worth, their groups made once."""
    grouped = rows.persist()
    kept = grouped.coalesce(tasks_worth(grouped.count())).persist()
    kept.count()
    grouped.unpersist()
    return kept


def thresholds(values: np.ndarray, most: int) -> list[float]:
    """At most about ``most`` thresholds of a feature: values up to one go to its left."""
    distinct, counts = np.unique(values + 0.0, return_counts=True)
    halfway = (distinct[:-1] + distinct[1:]) / 2.0
    if len(halfway) <= most:
        return halfway.tolist()
    stride = len(values) / (most + 1)
    found, passed, wanted = [], counts[0], stride
    for edge, count in zip(halfway.tolist(), counts[1:].tolist(), strict=True):
        before, passed = passed, passed + count
        if abs(before - wanted) < abs(passed - wanted):
            found.append(edge)
            wanted += stride
    return found


class BinNumbers(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The number of thresholds below each feature, as a vector."""

    edges = Param(Params._dummy(), "edges", "thresholds of every feature as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, **kwargs: Any):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        edges = json.loads(self.getOrDefault("edges"))
        names = [f"__value_{i}" for i in range(len(edges))]
        bins = [f"__bin_{i}" for i in range(len(edges))]
        values = vector_to_array(F.col(self.getInputCol()))
        wide = dataset.withColumns({n: values[i] for i, n in enumerate(names)})
        # A bucket holds its lower end, a tree's left side its threshold.
        splits = [
            [float("-inf"), *np.nextafter(e, np.inf).tolist(), float("inf")]
            if e else [float("-inf"), float("inf")] for e in edges
        ]
        numbered = [
            (n, b, s) for n, b, s in zip(names, bins, splits, strict=True) if len(s) > 2
        ]
        if numbered:
            inputs, outputs, all_splits = map(list, zip(*numbered, strict=True))
            wide = Bucketizer(
                splitsArray=all_splits, inputCols=inputs, outputCols=outputs, handleInvalid="keep"
            ).transform(wide)
        flat = [F.col(b) if b in wide.columns else F.lit(0.0) for b in bins]
        made = wide.withColumn(self.getOutputCol(), array_to_vector(F.array(*flat)))
        return made.drop(*names, *bins)


def bin_numbers(vectors: DataFrame, features: str, rows: int, bins: int, seed: int) -> BinNumbers:
    """The stage that numbers the bins; ``rows`` is the table's size."""
    wanted = max(bins * bins, ENOUGH_ROWS)
    taken = vectors.select(vector_to_array(F.col(features)).alias("x"))
    if wanted < rows:
        taken = taken.sample(withReplacement=False, fraction=wanted / rows, seed=seed)
    x = np.array([r["x"] for r in taken.collect()], dtype=float)
    if not len(x):
        raise ValueError("there is no training row")
    most = min(bins, rows) - 1
    edges = [thresholds(x[:, i], most) for i in range(x.shape[1])]
    return BinNumbers(inputCol=features, outputCol=BINNED, edges=json.dumps(edges))


def weighted_rows(vectors: DataFrame, numbers: BinNumbers, label: str, by_label: bool) -> DataFrame:
    """One row of each combination of bins (and label), with its weight."""
    binned = numbers.transform(vectors).select(
        vector_to_array(F.col(BINNED)).alias("bins"), F.col(label)
    )
    weight = F.count(F.lit(1)).cast("double").alias(WEIGHT)
    if by_label:
        grouped = binned.groupBy("bins", label).agg(weight)
    else:
        grouped = binned.groupBy("bins").agg(F.avg(label).alias(label), weight)
    return grouped.select(array_to_vector("bins").alias(BINNED), label, WEIGHT)


#: The stage that numbers bins, and the persisted weighted rows.
Binned = tuple[BinNumbers, DataFrame]


def binned_rows(made: Estimator, vectors: DataFrame, rows: int, by_label: bool) -> Binned:
    """What estimators of the same features, bins and seed are fitted on."""
    numbers = bin_numbers(vectors, made.getFeaturesCol(), rows, made.getMaxBins(), made.getSeed())
    return numbers, gathered(weighted_rows(vectors, numbers, made.getLabelCol(), by_label))


def fit_binned(
    made: Estimator, vectors: DataFrame, rows: int, by_label: bool, binned: Binned | None = None
) -> list[Transformer | Model]:
    """A tree estimator fitted on weighted rows: the stage that numbers bins, and the model.

    Its least number of rows in a node is stated as a share of the weights. Weighted rows
    that are given serve several estimators and stay persisted.
    """
    own = made.copy().setFeaturesCol(BINNED).setWeightCol(WEIGHT)
    share = (own.getMinInstancesPerNode() - 0.5) / rows
    if share >= 0.5:  # both sides would need more than half of the rows
        own.setMaxDepth(0)
    elif own.getMinInstancesPerNode() > 1:
        own.setMinWeightFractionPerNode(share)
    own.setMinInstancesPerNode(1)
    numbers, table = binned or binned_rows(made, vectors, rows, by_label)
    try:
        return [numbers, own.fit(table)]
    finally:
        if binned is None:
            table.unpersist()


def with_draws(table: DataFrame, label: str, trees: int, seed: int) -> DataFrame:
    """Weighted rows with the number of times that each tree draws them.

    The numbers follow from the row, so that a lost task draws them again.
    """

    @F.pandas_udf("array<long>")
    def draws(weights: pd.Series, keys: pd.Series) -> pd.Series:
        sources = (np.random.default_rng([seed, int(k) % 2**64]) for k in keys)
        return pd.Series([s.poisson(w, trees) for s, w in zip(sources, weights, strict=True)])

    key = F.xxhash64(vector_to_array(F.col(BINNED)), F.col(label))
    return table.withColumn(DRAWS, draws(F.col(WEIGHT), key))


def with_drawn_labels(
    vectors: DataFrame, numbers: BinNumbers, label: str, trees: int, seed: int, tasks: int
) -> DataFrame:
    """Rows of equal bins as one, with the number of draws of each tree and their mean label.

    Every row is drawn for every tree by a Poisson number of mean one, as in Spark's bootstrap,
    and the draws are added up where rows of one combination lie side by side. A combination
    that lies in several batches has a row for each of them, which is the same to a tree.
    """
    rows = numbers.transform(vectors).select(
        vector_to_array(F.col(BINNED)).alias("bins"), F.col(label).alias("y")
    )
    sided = rows.repartitionByRange(tasks, "bins", "y").sortWithinPartitions("bins", "y")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = np.random.default_rng([seed, TaskContext.get().partitionId()])
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = batch.column("bins").flatten().to_numpy().reshape(batch.num_rows, -1)
            y = batch.column("y").to_numpy()
            first = np.flatnonzero(np.append(True, (bins[1:] != bins[:-1]).any(axis=1)))
            draws = source.poisson(1.0, (len(y), trees)).astype(float)
            times = np.add.reduceat(draws, first)
            sums = np.add.reduceat(draws * y[:, None], first)
            means = np.divide(sums, times, out=np.zeros_like(sums), where=times > 0)
            ends = [pa.array(np.arange(len(first) + 1) * k, pa.int32()) for k in (bins.shape[1], trees)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(ends[0], bins[first].ravel()),
                    pa.ListArray.from_arrays(ends[1], times.ravel()),
                    pa.ListArray.from_arrays(ends[1], means.ravel()),
                ],
                ["bins", DRAWS, MEANS],
            )

    schema = f"bins array<double>, {DRAWS} array<double>, {MEANS} array<double>"
    made = sided.mapInArrow(draw, schema)
    return made.select(array_to_vector("bins").alias(BINNED), DRAWS, MEANS)


Forest = RandomForestClassifier | RandomForestRegressor


def joined_trees(spark: SparkSession, made: Forest, models: list[Model]) -> Model:
    """Forests of one tree each as one forest with the settings of ``made``."""
    context, first = spark.sparkContext, models[0]
    package = context._jvm.org.apache.spark.ml
    if isinstance(made, RandomForestClassifier):
        kind, shape = package.classification.DecisionTreeClassificationModel, (first.numFeatures, first.numClasses)
        joined, wrapper = package.classification.RandomForestClassificationModel, RandomForestClassificationModel
    else:
        kind, shape = package.regression.DecisionTreeRegressionModel, (first.numFeatures,)
        joined, wrapper = package.regression.RandomForestRegressionModel, RandomForestRegressionModel
    trees = context._gateway.new_array(kind, len(models))
    for i, model in enumerate(models):
        trees[i] = model._java_obj.trees()[0]
    forest = wrapper(joined(made.uid, trees, *shape))
    made._copyValues(forest).setFeaturesCol(BINNED)
    forest._transfer_params_to_java()
    return forest


def _grown(made: Forest, drawn: DataFrame) -> Model:
    """A forest whose trees are fits of their own on the rows that they draw."""
    classes = isinstance(made, RandomForestClassifier)
    label, seed, strategy = made.getLabelCol(), made.getSeed(), made.getFeatureSubsetStrategy()
    single = made.copy().setFeaturesCol(BINNED).setWeightCol(WEIGHT).setNumTrees(1)
    single.setBootstrap(False).setCacheNodeIds(False)
    if strategy == "auto":  # what it means for more than one tree
        single.setFeatureSubsetStrategy("sqrt" if classes else "onethird")

    def grow(tree: int) -> Model:
        own = drawn.withColumn(WEIGHT, F.col(DRAWS)[tree].cast("double")).filter(F.col(WEIGHT) > 0)
        if not classes:
            own = own.withColumn(label, F.col(MEANS)[tree])
        return single.copy().setSeed(seed + tree).fit(own.select(BINNED, label, WEIGHT))

    spark = drawn.sparkSession
    with ThreadPoolExecutor(TREES_AT_ONCE) as pool:
        models = list(pool.map(inheritable_thread_target(spark)(grow), range(made.getNumTrees())))
    return joined_trees(spark, made, models)


def fit_forest(made: Forest, vectors: DataFrame, rows: int) -> list[Transformer | Model] | None:
    """A forest on weighted rows, or nothing where they would not save passes."""
    if rows < WORTH * ROWS_OF_A_FIT:
        return None
    label, seed, trees = made.getLabelCol(), made.getSeed(), made.getNumTrees()
    numbers = bin_numbers(vectors, made.getFeaturesCol(), rows, made.getMaxBins(), seed)
    classes = isinstance(made, RandomForestClassifier)
    table = gathered(weighted_rows(vectors, numbers, label, by_label=classes))
    try:
        size = table.agg(F.count(F.lit(1)).alias("rows"), F.max(label).alias("last")).first()
        if rows < WORTH * (size["rows"] + ROWS_OF_A_FIT):
            return None
        if classes:  # a tree that draws no row of a class still counts it
            names = {"ml_attr": {"type": "nominal", "vals": [str(i) for i in range(int(size["last"]) + 1)]}}
            drawn = with_draws(table, label, trees, seed).withColumn(
                label, F.col(label).alias(label, metadata=names)
            ).persist()
        else:
            drawn = gathered(
                with_drawn_labels(vectors, numbers, label, trees, seed, tasks_worth(rows))
            )
        try:
            return [numbers, _grown(made, drawn)]
        finally:
            drawn.unpersist()
    finally:
        table.unpersist()
