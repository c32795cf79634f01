"""The algorithms by name, as ``pyspark.ml`` estimators with the documented settings.

The two ``xgboost`` names, and ``gradient_boosting`` with more than two classes, are boosted
by both derivatives of the loss. Approximations: trees grow to a depth of 30 and split on
bins; the RBF machines are linear machines on random Fourier features.

Forests keep the node of every row, checkpointed, so that their trees do not travel with
every task.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass
from typing import Any

from pyspark.ml import Estimator
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.regression import (
    DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor,
)
from pyspark.sql import DataFrame, SparkSession

from tabassay.operators.boosting import SecondOrderBoosting
from tabassay.operators.features import KERNEL_VECTOR, LABEL, VECTOR
from tabassay.operators.frames import to_frame
from tabassay.operators.tube import TubeRegression

# The catalogue users choose from, as type, id, name and description.
CATALOGUE = (
    ("classification", "logistic", "Logistic Regression", "Simple and interpretable"),
    ("classification", "random_forest", "Random Forest", "Ensemble of decision trees"),
    ("classification", "xgboost", "XGBoost", "Gradient boosting, often best performer"),
    ("classification", "svm", "SVM", "Support Vector Machine"),
    ("classification", "gradient_boosting", "Gradient Boosting", "Sequential ensemble"),
    ("regression", "linear", "Linear Regression", "Simple linear model"),
    ("regression", "ridge", "Ridge Regression", "L2 regularization"),
    ("regression", "lasso", "Lasso Regression", "L1 regularization"),
    ("regression", "random_forest", "Random Forest", "Ensemble of decision trees"),
    ("regression", "xgboost", "XGBoost", "Gradient boosting"),
    ("regression", "gradient_boosting", "Gradient Boosting", "Sequential ensemble"),
    ("regression", "svr", "SVR", "Support Vector Regression"),
)

# Every accepted name and the algorithm it means, per problem type.
ALIASES = {
    "classification": {
        "logistic": "logistic",
        "logistic_regression": "logistic",
        "random_forest": "random_forest",
        "xgboost": "xgboost",
        "svm": "svm",
        "gradient_boosting": "gradient_boosting",
        "decision_tree": "decision_tree",
    },
    "regression": {
        "linear": "linear",
        "linear_regression": "linear",
        "ridge": "ridge",
        "lasso": "lasso",
        "random_forest": "random_forest",
        "random_forest_regressor": "random_forest",
        "xgboost": "xgboost",
        "xgboost_regressor": "xgboost",
        "gradient_boosting": "gradient_boosting",
        "gradient_boosting_regressor": "gradient_boosting",
        "svr": "svr",
        "decision_tree": "decision_tree",
    },
}

KERNEL_ALGORITHMS = {"svm", "svr"}
SEED = 42
MAX_DIRECT_FEATURES = 4096  # the normal equations take no more
#: Deep trees: node ids are kept and cut from their lineage, and a task sums the bins of
#: many nodes at once, in this much memory.
DEEP = {"cacheNodeIds": True, "checkpointInterval": 10, "maxMemoryInMB": 512}


@dataclass(frozen=True)
class Effort:
    """How much work a fit may do; the defaults are the documented settings."""

    trees: int = 100
    rounds: int = 100
    tree_depth: int = 30  # the most that Spark grows
    iterations: int = 1000
    kernel_width: int = 64


@dataclass(frozen=True)
class TrainShape:
    """What the penalties depend on: training rows, classes and label deviation."""

    rows: int
    classes: int = 2
    label_std: float = 1.0
    features: int = 1


def catalogue(spark: SparkSession) -> DataFrame:
    schema = "problem_type string, id string, name string, description string"
    return to_frame(spark, CATALOGUE, schema)


def resolve(algorithm: str, problem_type: str) -> str:
    """The algorithm an accepted name stands for; an unknown name raises."""
    known = ALIASES.get(problem_type)
    if known is None:
        raise ValueError(f"unknown problem type '{problem_type}'")
    name = algorithm.lower().strip()
    if name not in known:
        raise ValueError(f"unknown algorithm '{algorithm}' for {problem_type}")
    return known[name]


def candidates(problem_type: str) -> list[str]:
    return [i for kind, i, _, _ in CATALOGUE if kind == problem_type]


def estimator(
    algorithm: str, problem_type: str, shape: TrainShape, effort: Effort = Effort(), **params: Any
) -> Estimator:
    """An unfitted estimator on the feature and label columns; ``params`` override settings."""
    name = resolve(algorithm, problem_type)
    made = (_classifier if problem_type == "classification" else _regressor)(name, shape, effort)
    if params:
        inner = made.getClassifier() if isinstance(made, OneVsRest) else made
        inner.setParams(**params)
    return made


def grows_together(algorithm: str, problem_type: str, classes: int) -> bool:
    """Whether one estimator fits several training tables side by side."""
    name = resolve(algorithm, problem_type)
    many = problem_type == "classification" and classes > 2
    return name == "xgboost" or (name == "gradient_boosting" and many)


def splits_all_rows(algorithm: str, problem_type: str, classes: int) -> bool:
    """Whether Spark's trees of this algorithm use all rows, each once: no bootstrap."""
    name = resolve(algorithm, problem_type)
    if name == "gradient_boosting":
        return not grows_together(name, problem_type, classes)
    return name == "decision_tree"


def _second_order(name: str, objective: str, classes: int, effort: Effort) -> Estimator:
    depth = {"xgboost": {"maxDepth": 6}, "gradient_boosting": {"maxDepth": 3, "penalty": 0.0, "leastWeight": 0.0}}
    return SecondOrderBoosting(
        featuresCol=VECTOR, labelCol=LABEL, objective=objective, classes=classes,
        maxIter=effort.rounds, stepSize=0.1, **depth[name],
    )


def _classifier(name: str, shape: TrainShape, effort: Effort) -> Estimator:
    penalty = 1.0 / max(shape.rows, 1)
    common = {"featuresCol": VECTOR, "labelCol": LABEL}
    if name == "logistic":
        return LogisticRegression(
            maxIter=effort.iterations, regParam=penalty, elasticNetParam=0.0,
            standardization=False, family="auto", **common,
        )
    if name == "random_forest":
        return RandomForestClassifier(
            numTrees=effort.trees, maxDepth=effort.tree_depth, seed=SEED, **DEEP, **common
        )
    if name == "decision_tree":
        return DecisionTreeClassifier(maxDepth=effort.tree_depth, seed=SEED, **DEEP, **common)
    if grows_together(name, "classification", shape.classes):
        objective = "softmax" if shape.classes > 2 else "logistic"
        return _second_order(name, objective, shape.classes, effort)
    if name == "svm":
        common["featuresCol"] = KERNEL_VECTOR
        made: Estimator = LinearSVC(
            maxIter=effort.iterations, regParam=penalty,
            standardization=False, **common,
        )
    else:
        made = GBTClassifier(
            maxIter=effort.rounds, stepSize=0.1, maxDepth=3, seed=SEED, **common
        )
    if shape.classes > 2:
        return OneVsRest(classifier=made, **common)
    return made


def _regressor(name: str, shape: TrainShape, effort: Effort) -> Estimator:
    common = {"featuresCol": VECTOR, "labelCol": LABEL}
    if name in ("linear", "ridge"):
        # Spark divides the label by its deviation, so the ridge penalty carries it too:
        # the population one when it solves directly, the sample one when it iterates.
        direct = shape.features <= MAX_DIRECT_FEATURES
        spread = shape.label_std
        if not direct and shape.rows > 1:
            spread *= (shape.rows / (shape.rows - 1)) ** 0.5
        penalty = spread / max(shape.rows, 1) if name == "ridge" else 0.0
        return LinearRegression(
            solver="normal" if direct else "l-bfgs", maxIter=effort.iterations, elasticNetParam=0.0, regParam=penalty, standardization=False, **common
        )
    if name == "lasso":
        return LinearRegression(
            elasticNetParam=1.0, regParam=1.0, standardization=False,
            maxIter=effort.iterations, **common,
        )
    if name == "random_forest":
        return RandomForestRegressor(
            numTrees=effort.trees, maxDepth=effort.tree_depth, seed=SEED, **DEEP, **common
        )
    if name == "decision_tree":
        return DecisionTreeRegressor(maxDepth=effort.tree_depth, seed=SEED, **DEEP, **common)
    if name == "svr":
        common["featuresCol"] = KERNEL_VECTOR
        return TubeRegression(maxIter=effort.iterations, **common)
    if name == "xgboost":
        return _second_order(name, "squared", 2, effort)
    return GBTRegressor(maxIter=effort.rounds, stepSize=0.1, maxDepth=3, seed=SEED, **common)


# The settings a tuning search tries, per algorithm.
GRIDS: dict[str, dict[str, list[Any]]] = {
    "logistic": {"regParam": [0.0, 0.001, 0.01, 0.1]},
    "random_forest": {"numTrees": [10, 50, 100], "maxDepth": [5, 10]},
    "xgboost": {"stepSize": [0.05, 0.1, 0.3], "maxDepth": [4, 6]},
    "gradient_boosting": {"stepSize": [0.05, 0.1, 0.3], "maxDepth": [2, 3]},
    "decision_tree": {"maxDepth": [3, 5, 10], "minInstancesPerNode": [1, 10]},
    "svm": {"regParam": [0.0001, 0.001, 0.01]},
    "ridge": {"regParam": [0.0001, 0.001, 0.01, 0.1]},
    "lasso": {"regParam": [0.001, 0.01, 0.1, 1.0]},
    "svr": {"cost": [0.1, 1.0, 10.0], "epsilon": [0.01, 0.1, 1.0]},
}




# What a random search draws from, per algorithm: evenly on a logarithmic
# scale between two numbers, or a whole number from a range.
SPACES: dict[str, dict[str, tuple[str, float, float]]] = {
    "logistic": {"regParam": ("log", 1e-5, 1.0), "elasticNetParam": ("even", 0.0, 1.0)},
    "random_forest": {"numTrees": ("whole", 10, 100), "maxDepth": ("whole", 3, 12)},
    "xgboost": {
        "stepSize": ("log", 0.02, 0.5), "maxDepth": ("whole", 2, 8), "penalty": ("log", 0.1, 10.0),
    },
    "gradient_boosting": {"stepSize": ("log", 0.02, 0.5), "maxDepth": ("whole", 2, 5)},
    "decision_tree": {"maxDepth": ("whole", 2, 15), "minInstancesPerNode": ("whole", 1, 20)},
    "svm": {"regParam": ("log", 1e-5, 0.1)},
    "ridge": {"regParam": ("log", 1e-5, 1.0)},
    "lasso": {"regParam": ("log", 1e-4, 10.0)},
    "svr": {"cost": ("log", 0.01, 100.0), "epsilon": ("log", 0.01, 1.0)},
}


def drawn_settings(algorithm: str, count: int, seed: int = SEED) -> list[dict[str, Any]]:
    """Settings drawn from the algorithm's distributions, each one once."""
    source = random.Random(seed)

    def draw(kind: str, low: float, high: float) -> Any:
        if kind == "whole":
            return source.randint(int(low), int(high))
        if kind == "log":
            return math.exp(source.uniform(math.log(low), math.log(high)))
        return source.uniform(low, high)

    space = SPACES.get(algorithm, {})
    drawn = [{n: draw(*space[n]) for n in space} for _ in range(count)] if space else []
    return [s for k, s in enumerate(drawn) if s not in drawn[:k]]
