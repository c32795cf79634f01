"""Training one model, or comparing all candidates and keeping the best."""

from __future__ import annotations

import json
import math
import time
import uuid
import warnings
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabassay.functions.families import require_column
from tabassay.functions.missing import normalize_missing, quoted
from tabassay.operators import algorithms as alg
from tabassay.operators import metrics
from tabassay.operators import modeling as mod
from tabassay.operators.cleaning import MAX_LEVELS, Cleaned, clean
from tabassay.operators.features import FOLD, LABEL, RESERVED
from tabassay.operators.folds import hash_folds, rank_folds
from tabassay.operators.frames import TASK, aggregate, settle, spread, to_frame
from tabassay.operators.registry import append_event, save_importance
from tabassay.operators.runlog import RunLog
from tabassay.session import enable_checkpoints
from tabassay.sources.sampling import split

LEADERBOARD_SCHEMA = (
    "rank int, algorithm string, score double, std double, training_time_seconds double, "
    "accuracy double, r2 double, status string, error string"
)


class NoAlgorithmSucceeded(RuntimeError):
    """Every candidate failed; carries the partial leaderboard and what was found."""

    def __init__(self, leaderboard: DataFrame, tested: int, causes: Sequence[str] = ()):
        found = "; ".join(causes) or "no cause was found in the data"
        super().__init__(f"none of {tested} algorithms succeeded: {found}")
        self.leaderboard, self.tested, self.causes = leaderboard, tested, list(causes)


def failure_causes(
    train: DataFrame, columns: Sequence[str], folds: int, problem_type: str,
    trials: Sequence[mod.Trial],
) -> list[str]:
    """What the training rows and the failed trials say about why nothing could be fitted."""
    seen = [F.approx_count_distinct(quoted(c)).alias(f"n_{i}") for i, c in enumerate(columns)]
    row = aggregate(
        train,
        [F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(LABEL).alias("labels"), *seen],
    )
    causes = []
    if row["rows"] < max(folds, 2):
        causes.append(f"{row['rows']} training rows for {folds} folds")
    if row["labels"] < 2:
        kind = "class" if problem_type == "classification" else "value"
        causes.append(f"the target has a single {kind} in the training rows")
    flat = [c for i, c in enumerate(columns) if row[f"n_{i}"] < 2]
    if flat:
        causes.append(f"empty or constant features: {', '.join(flat)}")
    messages = dict.fromkeys(t.error for t in trials if t.error)
    return causes + [f"error: {m}" for m in messages]


@dataclass
class TrainingConfig:
    """Options of a training run; the defaults are the documented ones."""

    use_feature_engineering: bool = False
    scaling_method: str = "standard"
    n_features: int | None = None
    polynomial_degree: int | None = None
    cv_folds: int = 5
    tune_hyperparameters: bool = False
    tuning_search_type: str = "grid"
    tuning_iterations: int = 50
    tuning_halving: bool = True
    exact_split: bool = False
    exact_folds: bool = False
    effort: alg.Effort = field(default_factory=alg.Effort)
    parallelism: int = 4
    max_classes: int | None = None
    max_levels: int = MAX_LEVELS
    run_log: RunLog | None = None
    model_id: str | None = None
    model_dir: str | None = None
    registry_path: str | None = None
    importance_path: str | None = None

    @property
    def folds(self) -> int:
        """Folds that are numbered: tuning needs two even without cross-validation."""
        return max(self.cv_folds, 2 if self.tune_hyperparameters else 1)

    def note(self, status: str, **info: Any) -> None:
        if self.run_log is not None:
            self.run_log.add(status, **info)


@contextmanager
def recorded(config: TrainingConfig) -> Iterator[None]:
    """Ends the job's history with ``failed`` and the reason when anything raises."""
    try:
        yield
    except Exception as problem:
        reason = (str(problem).splitlines() or [type(problem).__name__])[0]
        config.note("failed", level="ERROR", message=reason)
        raise


def publish(
    model: mod.FittedModel, importance: DataFrame, score: float | None, config: TrainingConfig
) -> str | None:
    """Save the pipeline, append its registration and store its importances, where asked."""
    if not (config.model_dir or config.registry_path or config.importance_path):
        return None
    spark = importance.sparkSession
    model_id = config.model_id or uuid.uuid4().hex
    path = None
    if config.model_dir:
        path = f"{config.model_dir.rstrip('/')}/{model_id}"
        model.save(path)
    if config.registry_path:
        append_event(
            spark, config.registry_path, model_id, "register", name=model.algorithm,
            algorithm=model.algorithm, problem_type=model.problem_type, score=score,
            metric="accuracy" if model.problem_type == "classification" else "r2", model_path=path,
        )
    if config.importance_path:
        save_importance(importance, model_id, config.importance_path)
    return model_id


@dataclass
class Prepared:
    """Cleaned, labelled and split rows."""

    cleaned: Cleaned
    columns: list[str]
    classes: list[str]
    train: DataFrame
    test: DataFrame
    rows_without_label: int
    train_size: int
    test_size: int
    kept: DataFrame | None = None

    def let_go(self) -> None:
        """Free the rows that were dealt out, where they were."""
        if self.kept is not None:
            self.kept.unpersist()


def prepare(
    df: DataFrame, target: str, problem_type: str, key: str, config: TrainingConfig
) -> Prepared:
    """Clean the table, drop rows without label, split by key and number the folds."""
    require_column(df, target)
    require_column(df, key)
    taken = [c for c in df.columns if c in RESERVED]
    if taken:
        raise ValueError(f"rename columns {taken}: scoring makes columns of that name")
    if problem_type not in alg.ALIASES:
        raise ValueError(f"unknown problem type '{problem_type}'")
    enable_checkpoints(df.sparkSession)
    cleaned = clean(normalize_missing(df), target, keep=[key], limit=config.max_levels)
    columns = [c for c in cleaned.data.columns if c not in (target, key)]
    classes: list[str] = []
    if problem_type == "classification":
        classes = mod.class_names(cleaned.data, target, config.max_classes)
    label = mod.label_column(target, problem_type, classes)
    labelled = cleaned.data.withColumn(LABEL, F.nanvl(label, F.lit(None).cast("double")))
    sizes = labelled.withColumn(TASK, F.spark_partition_id()).agg(
        F.count(F.lit(1)).alias("rows"), F.count(LABEL).alias("labelled"),
        (F.max(TASK) + 1).alias("tasks"),
    ).first()
    if sizes["labelled"] == 0:
        raise ValueError(f"no row has a value for the target '{target}'")
    kept = spread(labelled, sizes["rows"], sizes["tasks"])
    labelled = labelled if kept is None else kept
    usable = labelled.filter(F.col(LABEL).isNotNull())
    train, test = split(usable, key, 0.2, exact=config.exact_split)
    folds = config.folds
    if config.exact_folds:
        stratify = LABEL if problem_type == "classification" else None
        train = rank_folds(train, key, folds, stratify, FOLD)
    else:
        train = hash_folds(train, key, folds, name=FOLD)
    in_test = test.count()
    return Prepared(
        cleaned, columns, classes, train, test,
        sizes["rows"] - sizes["labelled"], sizes["labelled"] - in_test, in_test, kept,
    )


@contextmanager
def prepared(
    df: DataFrame, target: str, problem_type: str, key: str, config: TrainingConfig
) -> Iterator[Prepared]:
    """Prepared rows, freed in the end."""
    ready = prepare(df, target, problem_type, key, config)
    try:
        yield ready
    finally:
        ready.let_go()


def part_metrics(model: mod.FittedModel, train: DataFrame, test: DataFrame) -> DataFrame:
    """Weighted class metrics or regression errors of the train and the test part."""
    parts = [
        mod.labelled_predictions(model, rows).withColumn("part", F.lit(name))
        for name, rows in (("train", train), ("test", test))
    ]
    predicted = parts[0].unionByName(parts[1])
    if model.problem_type == "classification":
        return settle(metrics.classification_metrics(predicted, by=["part"]))
    return settle(metrics.regression_metrics(predicted, by=["part"]).drop("mape"))


def final_metrics(parts: DataFrame) -> DataFrame:
    """Rounded metrics of the test part."""
    test = parts.filter(F.col("part") == "test").drop("part")
    return test.select(*[F.round(c, 4).alias(c) for c in test.columns])


def leaderboard_frame(
    spark, trials: Sequence[mod.Trial], problem_type: str
) -> DataFrame:
    """Succeeded trials by rounded score, earlier ones first on ties, then the failed."""
    done = sorted((t for t in trials if t.mean is not None), key=lambda t: -round(t.mean, 4))
    rows: list[tuple[Any, ...]] = []
    for i, t in enumerate(done):
        score = round(t.mean, 4)
        as_accuracy = score if problem_type == "classification" else None
        as_r2 = score if problem_type == "regression" else None
        rows.append(
            (i + 1, t.algorithm, score, round(t.std, 4), round(t.seconds, 2),
             as_accuracy, as_r2, "completed", None)
        )
    for t in trials:
        if t.mean is None:
            rows.append(
                (None, t.algorithm, None, None, round(t.seconds, 2), None, None, "failed", t.error)
            )
    return to_frame(spark, rows, LEADERBOARD_SCHEMA)


@dataclass
class AutoMLResult:
    leaderboard: DataFrame
    best_algorithm: str
    best_score: float
    model: mod.FittedModel
    metrics: DataFrame
    feature_importance: DataFrame
    issues: DataFrame
    train_size: int
    test_size: int
    total_training_time_seconds: float
    model_id: str | None = None


def automl(
    df: DataFrame,
    target: str,
    problem_type: str,
    key: str,
    cv_folds: int = 5,
    use_feature_engineering: bool = True,
    scaling_method: str = "standard",
    algorithms: Sequence[str] | None = None,
    config: TrainingConfig | None = None,
) -> AutoMLResult:
    """Cross-validate every candidate, refit the best on all training rows, judge it on test.

    With the folders of ``config`` set, the model is saved and registered and its
    importances are stored.
    """
    config = replace(config or TrainingConfig(), cv_folds=cv_folds)
    scaling = scaling_method if use_feature_engineering else None
    with recorded(config):
        config.note("running", phase="data_validation", progress=5.0)
        with prepared(df, target, problem_type, key, config) as ready:
            return _automl(ready, target, problem_type, scaling, algorithms, config)


def _automl(
    ready: Prepared,
    target: str,
    problem_type: str,
    scaling: str | None,
    algorithms: Sequence[str] | None,
    config: TrainingConfig,
) -> AutoMLResult:
    spark = ready.train.sparkSession
    config.note("running", phase="algorithm_selection", progress=30.0)
    names = list(algorithms or alg.candidates(problem_type))
    for n in names:
        alg.resolve(n, problem_type)
    recipe = _recipe(ready, problem_type, scaling, config)
    trials = mod.cross_validate(
        ready.train, names, recipe, config.cv_folds, parallelism=config.parallelism
    )
    board = leaderboard_frame(spark, trials, problem_type)
    for t in trials:
        config.note(
            "running", phase="algorithm_selection", algorithm=t.algorithm, score=t.mean,
            level="ERROR" if t.error else "INFO", message=t.error,
        )
    best = None
    for t in trials:
        if t.mean is not None and (best is None or t.mean > best.mean):
            best = t
    if best is None:
        causes = failure_causes(ready.train, ready.columns, config.cv_folds, problem_type, trials)
        raise NoAlgorithmSucceeded(board, len(names), causes)
    config.note("running", phase="model_training", progress=85.0, algorithm=best.algorithm)
    model = _refit(ready, best.algorithm, target, recipe, config)[0]
    importance = mod.feature_importance(model)
    model_id = publish(model, importance, best.mean, config)
    config.note("completed", phase="evaluation", progress=100.0, algorithm=best.algorithm)
    return AutoMLResult(
        leaderboard=board,
        best_algorithm=best.algorithm,
        best_score=best.mean,
        model=model,
        metrics=final_metrics(part_metrics(model, ready.train, ready.test)),
        feature_importance=importance,
        issues=ready.cleaned.issues,
        train_size=ready.train_size,
        test_size=ready.test_size,
        total_training_time_seconds=sum(t.seconds for t in trials),
        model_id=model_id,
    )


def _recipe(
    ready: Prepared, problem_type: str, scaling: str | None, config: TrainingConfig
) -> mod.FoldRecipe:
    return mod.FoldRecipe(
        ready.columns, problem_type, ready.classes, scaling, config.effort,
        config.n_features, config.polynomial_degree, config.max_levels,
    )


def _refit(
    ready: Prepared,
    algorithm: str,
    target: str,
    recipe: mod.FoldRecipe,
    config: TrainingConfig,
    tuned: bool = False,
) -> tuple[mod.FittedModel, mod.Tuned]:
    """The model fitted on all training rows, with tuned settings where asked."""
    problem_type = recipe.problem_type
    found = mod.Tuned()
    if tuned:
        try:
            found = mod.tune(
                ready.train, algorithm, recipe, config.folds, config.tuning_search_type,
                config.tuning_iterations, config.parallelism, config.tuning_halving,
            )
        except Exception as problem:
            warnings.warn(f"tuning failed, default settings kept: {problem}", stacklevel=2)
    matrix = recipe.matrix(ready.train, alg.resolve(algorithm, problem_type) in alg.KERNEL_ALGORITHMS)
    matrix.vectors.persist()
    try:
        shape = mod.train_shape(matrix.vectors, problem_type, ready.classes, len(matrix.names))
        fitted = mod.fit_stages(
            matrix.vectors, algorithm, problem_type, shape, recipe.effort, found.params
        )
    finally:
        matrix.vectors.unpersist()
    model = mod.assemble(matrix, fitted, algorithm, problem_type, target, ready.classes)
    return model, found


def _fit_with_folds(
    ready: Prepared, algorithm: str, target: str, recipe: mod.FoldRecipe, config: TrainingConfig
) -> tuple[mod.FittedModel, mod.Trial]:
    """The model of all training rows and the folds' scores from one run of all of them."""
    trial, start = mod.Trial(algorithm), time.time()
    folds = [mod.fold_of(ready.train, recipe, False, k) for k in range(config.cv_folds)]
    matrix = recipe.matrix(ready.train, False)
    whole = matrix.vectors.persist()
    try:
        trial.scores, fitted = mod.fit_together(folds, algorithm, recipe, others=[whole])
    finally:
        for rows in [whole, *(rows for fold in folds for rows in fold[:2])]:
            rows.unpersist()
    trial.seconds = time.time() - start
    model = mod.assemble(matrix, fitted, algorithm, recipe.problem_type, target, ready.classes)
    return model, trial


TUNING_SCHEMA = (
    "settings string, folds int, mean_score double, std_score double, chosen boolean"
)


def tuning_frame(spark, found: mod.Tuned) -> DataFrame:
    """Every setting that was tried, with the folds it saw and its scores."""
    rows = []
    for settings, scores in found.tried:
        mean = sum(scores) / len(scores) if scores else None
        std = math.sqrt(sum((s - mean) ** 2 for s in scores) / len(scores)) if scores else None
        text = json.dumps(settings, sort_keys=True)
        rows.append((text, len(scores), _round(mean), _round(std), settings == found.params))
    return to_frame(spark, rows, TUNING_SCHEMA)


@dataclass
class TrainingResult:
    model: mod.FittedModel
    scores: DataFrame
    metrics: DataFrame
    feature_importance: DataFrame
    issues: DataFrame
    best_params: dict[str, Any]
    model_id: str | None = None
    tuning: DataFrame | None = None


SCORES_SCHEMA = (
    "algorithm string, problem_type string, train_score double, test_score double, "
    "cv_score double, cv_std double, train_size bigint, test_size bigint, n_features int, "
    "rows_without_label bigint, training_time_seconds double"
)


def _round(value: float | None) -> float | None:
    return None if value is None or not math.isfinite(value) else round(value, 4)


def train(
    df: DataFrame,
    target: str,
    algorithm: str,
    problem_type: str,
    key: str,
    config: TrainingConfig | None = None,
) -> TrainingResult:
    """Fit one algorithm and score it on train, test and cross-validation folds.

    With the folders of ``config`` set, the model is saved and registered and its
    importances are stored.
    """
    config = config or TrainingConfig()
    alg.resolve(algorithm, problem_type)
    with recorded(config), prepared(df, target, problem_type, key, config) as ready:
        return _train(ready, target, algorithm, problem_type, config)


def _train(
    ready: Prepared, target: str, algorithm: str, problem_type: str, config: TrainingConfig
) -> TrainingResult:
    scaling = config.scaling_method if config.use_feature_engineering else None
    config.note("running", phase="training", progress=50.0, algorithm=algorithm)
    start = time.time()
    recipe = _recipe(ready, problem_type, scaling, config)
    classes = max(len(ready.classes), 2)
    together = alg.grows_together(algorithm, problem_type, classes) and config.cv_folds > 1
    if together and not config.tune_hyperparameters:
        model, trial = _fit_with_folds(ready, algorithm, target, recipe, config)
        found = mod.Tuned()
    else:
        model, found = _refit(
            ready, algorithm, target, recipe, config, config.tune_hyperparameters
        )
        trial = mod.Trial(algorithm)
    params = found.params
    seconds = time.time() - start
    parts = part_metrics(model, ready.train, ready.test)
    score = "accuracy" if problem_type == "classification" else "r2"
    scores = {r["part"]: r[score] for r in parts.collect()}
    on_train, on_test = scores.get("train"), scores.get("test")
    if config.cv_folds > 1 and not trial.scores:
        trial = mod.cross_validate(
            ready.train, [algorithm], recipe, config.cv_folds, params, config.parallelism
        )[0]
    importance = mod.feature_importance(model)
    model_id = publish(model, importance, on_test, config)
    config.note(
        "completed", phase="evaluation", progress=100.0, algorithm=algorithm, score=on_test
    )
    row = (
        algorithm, problem_type, _round(on_train), _round(on_test), _round(trial.mean),
        _round(trial.std), ready.train_size, ready.test_size, len(model.features),
        ready.rows_without_label, round(seconds, 2),
    )
    return TrainingResult(
        model=model,
        scores=to_frame(ready.train.sparkSession, [row], SCORES_SCHEMA),
        metrics=final_metrics(parts),
        feature_importance=importance,
        issues=ready.cleaned.issues,
        best_params=params,
        model_id=model_id,
        tuning=tuning_frame(ready.train.sparkSession, found),
    )


