"""Fitting, cross-validation, tuning, importance and the saved form of a model."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from itertools import product
from typing import Any

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import IndexToString, PolynomialExpansion, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabassay.functions.families import require_column
from tabassay.functions.missing import quoted
from tabassay.functions.scalars import confidence, probability_map
from tabassay.operators import algorithms as alg
from tabassay.operators import metrics
from tabassay.operators.binning import BINNED, Binned, binned_rows, fit_binned, fit_forest
from tabassay.operators.cleaning import MAX_LEVELS
from tabassay.operators.correlation import class_target_strengths, target_correlations
from tabassay.operators.features import (
    FOLD, KERNEL_VECTOR, LABEL, VECTOR, FeaturePlan, fill_absent_inputs, fit_features, kernel_stages,
)
from tabassay.operators.frames import to_frame

IMPORTANCE_SCHEMA = "rank int, feature string, importance double"
#: Parts whose margins come from a machine fitted on the others.
CALIBRATION_PARTS = 3
PART = "__part"


@dataclass
class FittedModel:
    """A pipeline from raw columns to predictions, with what scoring needs to know."""

    pipeline: PipelineModel
    algorithm: str
    problem_type: str
    target: str
    features: list[str]
    inputs: dict[str, str]
    classes: list[str] = field(default_factory=list)

    def _meta(self) -> dict[str, Any]:
        return {k: v for k, v in self.__dict__.items() if k != "pipeline"}

    def save(self, path: str) -> None:
        """Write the pipeline and its description below ``path``."""
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.active()
        meta = spark.createDataFrame([(json.dumps(self._meta()),)], "value string")
        meta.coalesce(1).write.mode("overwrite").text(f"{path}/description")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FittedModel:
        meta = json.loads(spark.read.text(f"{path}/description").first()["value"])
        return FittedModel(pipeline=PipelineModel.load(f"{path}/pipeline"), **meta)


def class_names(df: DataFrame, target: str, limit: int | None = None) -> list[str]:
    """The sorted classes of a label; with ``limit``, more of them raise."""
    found = df.select(quoted(target).alias("value"), quoted(target).cast("string").alias("name"))
    classes = found.filter(F.col("value").isNotNull()).distinct()
    rows = classes.collect() if limit is None else classes.limit(limit + 1).collect()
    if limit is not None and len(rows) > limit:
        raise ValueError(f"target '{target}' has more than {limit} classes")
    return [r["name"] for r in sorted(rows, key=lambda r: r["value"])]


def label_column(target: str, problem_type: str, classes: Sequence[str]) -> Column:
    if problem_type == "regression":
        return quoted(target).cast("double")
    known = F.array(*[F.lit(c) for c in classes])
    return (F.array_position(known, quoted(target).cast("string")) - 1).cast("double")


def train_shape(
    train: DataFrame, problem_type: str, classes: Sequence[str], features: int = 1
) -> alg.TrainShape:
    row = train.agg(F.count(LABEL).alias("n"), F.stddev_pop(LABEL).alias("s")).first()
    spread = row["s"] if problem_type == "regression" and row["s"] else 1.0
    return alg.TrainShape(row["n"], max(len(classes), 2), spread, features)


def _needs_kernel(algorithm: str) -> bool:
    return algorithm in alg.KERNEL_ALGORITHMS


def fit_stages(
    vectors: DataFrame,
    algorithm: str,
    problem_type: str,
    shape: alg.TrainShape,
    effort: alg.Effort,
    params: dict[str, Any] | None = None,
    chances: bool = True,
    binned: Binned | None = None,
) -> list[Transformer]:
    """Fit one algorithm on assembled rows.

    Trees that use every row once take rows of equal bins as one; so do forests on tables
    of many rows. With ``chances`` a binary kernel machine also gets probabilities.
    """
    made = alg.estimator(algorithm, problem_type, shape, effort, **(params or {}))
    if alg.splits_all_rows(algorithm, problem_type, shape.classes):
        return fit_binned(made, vectors, shape.rows, problem_type == "classification", binned)
    if isinstance(made, RandomForestClassifier | RandomForestRegressor):
        forest = fit_forest(made, vectors, shape.rows)
        if forest is not None:
            return forest
    model = made.fit(vectors)
    if not chances or alg.resolve(algorithm, problem_type) != "svm" or shape.classes > 2:
        return [model]
    return [model, calibrated(made, vectors)]


def calibrated(made: Estimator, vectors: DataFrame, parts: int = CALIBRATION_PARTS) -> Model:
    """Chances from margins, learned on margins of rows that the machine has not seen.

    A row's part follows from its vector, so that copies are never on both sides. Parts
    without one of the classes on the other side give no margins.
    """
    part = F.pmod(F.xxhash64(vector_to_array(F.col(made.getFeaturesCol()))), F.lit(parts))
    dealt = vectors.withColumn(PART, part)
    held = []
    for k in range(parts):
        others = dealt.filter(F.col(PART) != k)
        if others.select(LABEL).distinct().count() < 2:
            continue
        margins = made.fit(others).transform(dealt.filter(F.col(PART) == k))
        held.append(margins.select(LABEL, "rawPrediction"))
    if not held:
        held = [made.fit(vectors).transform(vectors).select(LABEL, "rawPrediction")]
    table = reduce(DataFrame.unionByName, held).persist()
    try:
        return LogisticRegression(
            featuresCol="rawPrediction", predictionCol="calibrated",
            rawPredictionCol="calibratedRaw", probabilityCol="probability", labelCol=LABEL,
        ).fit(table)
    finally:
        table.unpersist()


@dataclass
class Matrix:
    """Training rows as vectors, and the stages that made them."""

    plan: FeaturePlan
    stages: list[Transformer]
    vectors: DataFrame
    names: list[str]


def top_features(data: DataFrame, vector: str, problem_type: str, n: int) -> list[int]:
    """Places of the features with the largest F values, earlier ones first on ties.

    At the same rows and classes F grows with the correlation, or with the correlation
    ratio of the classes. P values would not do: on many rows they are all zero.
    """
    size = data.select(F.size(vector_to_array(F.col(vector)))).first()[0]
    values = vector_to_array(F.col(vector))
    names = [f"f{i}" for i in range(size)]
    table = data.select(LABEL, *[values[i].alias(f) for i, f in enumerate(names)])
    measure = class_target_strengths if problem_type == "classification" else target_correlations
    found = {r["feature"]: r["correlation"] for r in measure(table, LABEL, names).collect()}
    ranked = sorted(range(size), key=lambda i: (-abs(found[names[i]] or 0.0), i))
    return sorted(ranked[:n])


def build_matrix(
    train: DataFrame,
    plan: FeaturePlan,
    problem_type: str,
    kernel: bool,
    effort: alg.Effort,
    n_features: int | None = None,
    degree: int | None = None,
) -> Matrix:
    """Assemble labels and feature vectors; optionally expand and select features."""
    stages = plan.stages()
    names = list(plan.names)
    if kernel:
        stages += kernel_stages(plan, plan.encode(train), effort.kernel_width)
    data = train
    for stage in stages:
        data = stage.transform(data)
    if degree is not None and degree > 1:
        stages[1].setOutputCol("__base_features")
        expand = PolynomialExpansion(degree=degree, inputCol="__base_features", outputCol=VECTOR)
        data = expand.transform(data.withColumnRenamed(VECTOR, "__base_features"))
        stages.append(expand)
        names = [f"feature_{i}" for i in range(math.comb(len(names) + degree, degree) - 1)]
    if n_features is not None and n_features < len(names):
        last = stages[-1] if degree is not None and degree > 1 else stages[1]
        last.setOutputCol("__all_features")
        data = data.withColumnRenamed(VECTOR, "__all_features")
        chosen = top_features(data, "__all_features", problem_type, n_features)
        slicer = VectorSlicer(inputCol="__all_features", outputCol=VECTOR, indices=chosen)
        data = slicer.transform(data)
        stages.append(slicer)
        names = [names[i] for i in chosen]
    keep = [VECTOR, LABEL, *([KERNEL_VECTOR] if kernel else [])]
    keep += [c for c in (FOLD,) if c in data.columns]
    return Matrix(plan, stages, data.select(*keep), names)


def assemble(
    matrix: Matrix,
    fitted: Sequence[Model],
    algorithm: str,
    problem_type: str,
    target: str,
    classes: Sequence[str],
) -> FittedModel:
    stages: list[Transformer] = [*matrix.stages, *fitted]
    if problem_type == "classification":
        stages.append(
            IndexToString(inputCol="prediction", outputCol="predicted_class", labels=list(classes))
        )
    return FittedModel(
        PipelineModel(stages=stages), algorithm, problem_type, target,
        matrix.names, dict(matrix.plan.inputs), list(classes),
    )


def score_of(predicted: DataFrame, problem_type: str) -> float | None:
    """Accuracy or R2 from one aggregate of the label and the prediction."""
    if problem_type == "classification":
        hit = (F.col(LABEL) == F.col("prediction")).cast("double")
        return predicted.agg(F.avg(hit)).first()[0]
    return metrics.regression_metrics(predicted, LABEL).first()["r2"]


@dataclass
class Trial:
    """Cross-validation outcome of one algorithm."""

    algorithm: str
    scores: list[float] = field(default_factory=list)
    seconds: float = 0.0
    error: str | None = None

    @property
    def mean(self) -> float | None:
        return sum(self.scores) / len(self.scores) if self.scores and not self.error else None

    @property
    def std(self) -> float | None:
        if self.mean is None:
            return None
        return math.sqrt(sum((s - self.mean) ** 2 for s in self.scores) / len(self.scores))


def _run_trials(spark: SparkSession, tasks: Sequence[Any], parallelism: int) -> None:
    """Run independent fits side by side; each is itself a distributed job."""
    if parallelism <= 1:
        for task in tasks:
            task()
        return
    with ThreadPoolExecutor(parallelism) as pool:
        list(pool.map(lambda t: inheritable_thread_target(spark)(t)(), tasks))


@dataclass
class FoldRecipe:
    """How training rows become vectors: refitted inside every fold."""

    columns: Sequence[str]
    problem_type: str
    classes: Sequence[str]
    scaling: str | None = None
    effort: alg.Effort = field(default_factory=alg.Effort)
    n_features: int | None = None
    degree: int | None = None
    max_levels: int = MAX_LEVELS

    def matrix(self, train: DataFrame, kernel: bool) -> Matrix:
        plan = fit_features(train, self.columns, self.scaling, self.max_levels)
        return build_matrix(
            train, plan, self.problem_type, kernel, self.effort, self.n_features, self.degree
        )


Fold = tuple[DataFrame, DataFrame, alg.TrainShape]


def fold_of(train: DataFrame, recipe: FoldRecipe, kernel: bool, k: int) -> Fold:
    """Persisted vectors of the other folds and of the held-out fold, and the shape.

    Imputation, encoding, scaling, expansion and feature choice are fitted on the other
    folds alone, as a model is trained.
    """
    matrix = recipe.matrix(train.filter(F.col(FOLD) != k), kernel)
    vectors = matrix.vectors.persist()
    held = train.filter(F.col(FOLD) == k)
    for stage in matrix.stages:
        held = stage.transform(held)
    held = held.select(*vectors.columns).persist()
    shape = train_shape(vectors, recipe.problem_type, recipe.classes, len(matrix.names))
    return vectors, held, shape


def each_fold(
    train: DataFrame, recipe: FoldRecipe, kernel: bool, folds: int
) -> Iterator[Fold]:
    """The folds one after the other, each kept while it is in use."""
    for k in range(folds):
        fold = fold_of(train, recipe, kernel, k)
        yield fold
        _let_go([fold])


def _let_go(folds: Iterable[Fold]) -> None:
    for vectors, held, _ in folds:
        vectors.unpersist()
        held.unpersist()


def fit_together(
    folds: Sequence[Fold],
    algorithm: str,
    recipe: FoldRecipe,
    params: dict[str, Any] | None = None,
    others: Sequence[DataFrame] = (),
) -> tuple[list[float], list[Model]]:
    """Scores of all folds, and models of other tables, all grown side by side."""
    made = alg.estimator(
        algorithm, recipe.problem_type, folds[0][2], recipe.effort, **(params or {})
    )
    models = made.fit_together([vectors for vectors, _, _ in folds] + list(others))
    scores = [
        score_of(model.transform(held), recipe.problem_type)
        for model, (_, held, _) in zip(models, folds, strict=False)
    ]
    if any(s is None or not math.isfinite(s) for s in scores):
        raise ValueError("a fold gave no score")
    return scores, models[len(folds) :]


def _fold_score(
    algorithm: str, recipe: FoldRecipe, vectors: DataFrame, held: DataFrame,
    shape: alg.TrainShape, params: dict[str, Any] | None, binned: Binned | None = None,
) -> float:
    fitted = fit_stages(
        vectors, algorithm, recipe.problem_type, shape, recipe.effort, params, chances=False,
        binned=binned,
    )
    value = score_of(PipelineModel(fitted).transform(held), recipe.problem_type)
    if value is None or not math.isfinite(value):
        raise ValueError("the fold gave no score")
    return value


def cross_validate(
    train: DataFrame,
    names: Sequence[str],
    recipe: FoldRecipe,
    folds: int,
    params: dict[str, Any] | None = None,
    parallelism: int = 4,
) -> list[Trial]:
    """Score every named algorithm on each fold; a failing algorithm keeps its error.

    ``train`` holds the label and the fold. A fold's vectors serve all algorithms; those
    that grow several models together take all folds at once.
    """
    trials = {n: Trial(n) for n in names}
    classes = max(len(recipe.classes), 2)
    joint = [n for n in names if alg.grows_together(n, recipe.problem_type, classes)]
    single = [n for n in names if n not in joint]
    kernel = any(_needs_kernel(alg.resolve(n, recipe.problem_type)) for n in names)

    found: dict[str, dict[int, float]] = {n: {} for n in single}

    def run(trial: Trial, k: int, fold: Fold) -> None:
        start = time.time()
        try:
            found[trial.algorithm][k] = _fold_score(trial.algorithm, recipe, *fold, params)
        except Exception as problem:
            trial.error = str(problem).splitlines()[0][:500]
        trial.seconds += time.time() - start

    def run_joint(trial: Trial, kept: Sequence[Fold]) -> None:
        start = time.time()
        try:
            trial.scores += fit_together(kept, trial.algorithm, recipe, params)[0]
        except Exception as problem:
            trial.error = str(problem).splitlines()[0][:500]
        trial.seconds += time.time() - start

    try:
        # As many folds side by side as the algorithms leave room for.
        at_once = max(1, parallelism // max(len(single), 1))
        for first in range(0, folds if single else 0, at_once):
            numbers = range(first, min(first + at_once, folds))
            kept = {k: fold_of(train, recipe, kernel, k) for k in numbers}
            open_trials = [trials[n] for n in single if trials[n].error is None]
            tasks = [lambda t=t, k=k: run(t, k, kept[k]) for k in kept for t in open_trials]
            _run_trials(train.sparkSession, tasks, parallelism)
            _let_go(kept.values())
        for name in single:
            trials[name].scores = [found[name][k] for k in sorted(found[name])]
        if joint:
            every = [fold_of(train, recipe, False, k) for k in range(folds)]
            tasks = [lambda n=n: run_joint(trials[n], every) for n in joint]
            _run_trials(train.sparkSession, tasks, parallelism)
            _let_go(every)
    except Exception as problem:  # a fold nobody can use fails every algorithm
        for t in trials.values():
            t.error = t.error or str(problem).splitlines()[0]
    return list(trials.values())


@dataclass
class Tuned:
    """The best settings, their mean score, and every setting tried with its fold scores."""

    params: dict[str, Any] = field(default_factory=dict)
    score: float | None = None
    tried: list[tuple[dict[str, Any], list[float]]] = field(default_factory=list)


def tune(
    train: DataFrame,
    algorithm: str,
    recipe: FoldRecipe,
    folds: int,
    search: str = "grid",
    iterations: int = 50,
    parallelism: int = 4,
    halving: bool = True,
) -> Tuned:
    """The best settings of the algorithm by cross-validated score.

    ``grid`` tries every combination of a grid on all folds. ``random`` draws
    ``iterations`` settings from distributions with a seed; with ``halving`` it lets the
    better half go on after each fold, without it every setting sees all folds. The best of
    those that saw every fold wins, earlier draws first on ties. Everything that is fitted
    is fitted inside each fold; weighted rows of a fold serve all settings.
    """
    if folds < 2:
        raise ValueError("tuning needs at least two folds")
    if search not in ("grid", "random"):
        raise ValueError(f"unknown search '{search}'")
    name = alg.resolve(algorithm, recipe.problem_type)
    if search == "random":
        tries = alg.drawn_settings(name, iterations)
    else:
        grid = alg.GRIDS.get(name, {})
        tries = [dict(zip(grid, values)) for values in product(*grid.values())] if grid else []
    if not tries:
        return Tuned()
    scores: dict[int, list[float]] = {i: [] for i in range(len(tries))}

    def mean(i: int) -> float:
        return sum(scores[i]) / len(scores[i])

    def run(i: int, fold: Fold, binned: Binned | None) -> None:
        scores[i].append(_fold_score(algorithm, recipe, *fold, tries[i], binned))

    going = list(scores)
    for fold in each_fold(train, recipe, _needs_kernel(name), folds):
        vectors, _, shape = fold
        binned = None
        if alg.splits_all_rows(name, recipe.problem_type, shape.classes):
            made = alg.estimator(name, recipe.problem_type, shape, recipe.effort)
            binned = binned_rows(made, vectors, shape.rows, recipe.problem_type == "classification")
        tasks = [lambda i=i, fold=fold, binned=binned: run(i, fold, binned) for i in going]
        _run_trials(train.sparkSession, tasks, parallelism)
        if binned is not None:
            binned[1].unpersist()
        if search == "random" and halving:
            going = sorted(sorted(going, key=lambda i: (-mean(i), i))[: -(-len(going) // 2)])
    whole = [i for i in scores if len(scores[i]) == folds]
    best = max(whole, key=lambda i: (mean(i), -i))
    return Tuned(tries[best], mean(best), [(tries[i], scores[i]) for i in scores])


def raw_importance(model: Model) -> list[float] | None:
    """Tree importances or absolute coefficients; none for kernel and one-vs-rest models."""
    if "featuresCol" in [p.name for p in model.params] and model.getFeaturesCol() not in (VECTOR, BINNED):
        return None
    if hasattr(model, "featureImportances"):
        return [float(x) for x in model.featureImportances.toArray()]
    if getattr(model, "numClasses", 2) > 2 and hasattr(model, "coefficientMatrix"):
        return [float(x) for x in abs(model.coefficientMatrix.toArray()).mean(axis=0)]
    if hasattr(model, "coefficients"):
        return [abs(float(x)) for x in model.coefficients]
    return None


def predictor(model: FittedModel) -> Model:
    """The stage that predicts."""
    return next(
        s for s in model.pipeline.stages if s.hasParam("predictionCol") and isinstance(s, Model)
    )


def feature_importance(model: FittedModel, limit: int = 20) -> DataFrame:
    """Importances that sum to one before rounding, ranked, the first ``limit``."""
    spark = SparkSession.active()
    raw = raw_importance(predictor(model))
    if raw is None:
        return to_frame(spark, [], IMPORTANCE_SCHEMA)
    names = model.features
    if len(names) != len(raw):
        names = [f"feature_{i}" for i in range(len(raw))]
    total = sum(raw)
    shares = [x / total if total > 0 else x for x in raw]
    ranked = sorted(zip(names, shares), key=lambda x: -x[1])[:limit]
    rows = [(i + 1, n, round(x, 4)) for i, (n, x) in enumerate(ranked)]
    return to_frame(spark, rows, IMPORTANCE_SCHEMA)


def one_vs_rest_chances(raw: Column) -> Column:
    """Margins of one-vs-rest machines as logistic chances that sum to one."""
    single = F.transform(vector_to_array(raw), lambda m: 1.0 / (1.0 + F.exp(-2.0 * m)))
    total = F.aggregate(single, F.lit(0.0), lambda a, x: a + x)
    return F.transform(single, lambda p: F.try_divide(p, total))


def predict(model: FittedModel, df: DataFrame) -> DataFrame:
    """All columns of ``df`` with prediction, probability per class and confidence.

    Works on batch and streaming tables alike. Models without probabilities give nulls.
    """
    scored = model.pipeline.transform(fill_absent_inputs(df, model.inputs))
    kept = [quoted(c) for c in df.columns if c not in ("prediction", "probability", "confidence")]
    if model.problem_type == "regression":
        return scored.select(*kept, F.col("prediction"))
    if "probability" not in scored.columns and "rawPrediction" in scored.columns:
        chance = one_vs_rest_chances(F.col("rawPrediction"))
        names = F.array(*[F.lit(c) for c in model.classes])
        chances = F.map_from_arrays(names, F.transform(chance, lambda p: F.round(p, 4)))
        sure = F.round(F.array_max(chance), 4)
    elif "probability" in scored.columns:
        chances = probability_map(model.classes, F.col("probability"))
        sure = confidence(F.col("probability"))
    else:
        chances = F.lit(None).cast("map<string,double>")
        sure = F.lit(None).cast("double")
    return scored.select(
        *kept,
        F.col("predicted_class").alias("prediction"),
        chances.alias("probability"),
        sure.alias("confidence"),
    )


def labelled_predictions(model: FittedModel, df: DataFrame) -> DataFrame:
    """Numeric ``label`` and ``prediction`` of labelled rows, for the metrics."""
    require_column(df, model.target)
    label = label_column(model.target, model.problem_type, model.classes)
    scored = model.pipeline.transform(
        fill_absent_inputs(df.withColumn(LABEL, label), model.inputs)
    )
    return scored.select(F.col(LABEL).alias("label"), "prediction")
