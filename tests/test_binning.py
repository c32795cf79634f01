import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor
from pyspark.sql import functions as F

from tabassay.operators.algorithms import TrainShape, Effort, estimator
from tabassay.operators.binning import (
    BINNED, DRAWS, MEANS, WEIGHT, bin_numbers, fit_binned, thresholds, weighted_rows, with_draws,
    with_drawn_labels,
)
from tabassay.operators.features import LABEL, VECTOR
from tabassay.operators.modeling import fit_stages


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(
        {"a": rng.normal(size=2000), "b": rng.integers(0, 5, 2000) / 2.0, "c": 1.0}
    )
    pdf["number"] = np.sin(2 * pdf.a) * 3 + pdf.b + rng.normal(0, 0.5, 2000)
    pdf["two"] = (pdf.number > 1).astype(float)
    made = VectorAssembler(inputCols=["a", "b", "c"], outputCol=VECTOR)
    return made.transform(spark.createDataFrame(pdf).repartition(3)).persist()


def answers(model, rows):
    found = model.transform(rows).select("a", "b", "prediction").orderBy("a", "b").toPandas()
    return found["prediction"].to_numpy()


@pytest.mark.parametrize(
    "kind,options,label",
    [
        (DecisionTreeRegressor, {"maxDepth": 4}, "number"),
        (DecisionTreeRegressor, {"maxDepth": 12, "minInstancesPerNode": 15}, "number"),
        (DecisionTreeClassifier, {"maxDepth": 5, "minInstancesPerNode": 7}, "two"),
        (DecisionTreeClassifier, {"maxDepth": 5, "minInstancesPerNode": 1900}, "two"),
        (GBTRegressor, {"maxIter": 4, "maxDepth": 3}, "number"),
        (GBTClassifier, {"maxIter": 4, "maxDepth": 3}, "two"),
    ],
)
def test_equals_the_tree_of_all_rows(rows, kind, options, label):
    made = kind(featuresCol=VECTOR, labelCol=label, seed=1, **options)
    found = PipelineModel(fit_binned(made, rows, 2000, label == "two"))
    whole = made.fit(rows)
    assert np.allclose(answers(found, rows), answers(whole, rows))
    importance = found.stages[1].featureImportances.toArray()
    assert np.allclose(importance, whole.featureImportances.toArray())


def test_more_rows_are_no_more_weighted_rows(rows):
    many = rows.union(rows).union(rows)
    numbers = bin_numbers(rows, VECTOR, 2000, 32, 1)
    one, three = (weighted_rows(t, numbers, "number", False).toPandas() for t in (rows, many))
    assert len(one) == len(three) <= 32 * 5
    assert one[WEIGHT].sum() * 3 == three[WEIGHT].sum() == 6000


def test_thresholds():
    assert thresholds(np.array([3.0, 1.0, 1.0, 2.0]), 31) == [1.5, 2.5]
    assert thresholds(np.array([5.0, 5.0]), 31) == []
    assert thresholds(np.arange(8.0), 3) == [1.5, 3.5, 5.5]


def test_a_fit_works_on_weighted_rows(rows, tmp_path):
    table = rows.withColumn(LABEL, F.col("number"))
    fitted = fit_stages(
        table, "decision_tree", "regression", TrainShape(2000), Effort(tree_depth=4)
    )
    assert len(fitted) == 2
    PipelineModel(fitted).write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert np.array_equal(answers(again, rows), answers(PipelineModel(fitted), rows))


def test_a_forest_of_many_rows_grows_on_weighted_rows(spark, tmp_path):
    rows = spark.range(1_200_000, numPartitions=8).select(
        (F.col("id") % 8).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
        F.when(F.rand(3) < 0.9, (F.col("id") % 8 >= 3)).otherwise(F.rand(4) < 0.5)
        .cast("double").alias(LABEL),
    )
    vectors = VectorAssembler(inputCols=["a", "b"], outputCol=VECTOR).transform(rows).persist()
    shape = TrainShape(1_200_000)
    effort = Effort(trees=6, tree_depth=4)
    stages = fit_stages(vectors, "random_forest", "classification", shape, effort)
    assert len(stages) == 2
    forest = stages[1]
    assert forest.getNumTrees == 6 and forest.numClasses == 2
    plain = estimator("random_forest", "classification", shape, effort).fit(vectors)
    points = vectors.select(VECTOR).distinct()
    got = {tuple(r[VECTOR]): r["probability"][1] for r in PipelineModel(stages).transform(points).collect()}
    want = {tuple(r[VECTOR]): r["probability"][1] for r in plain.transform(points).collect()}
    assert got.keys() == want.keys()
    assert all((got[k] > 0.5) == (want[k] > 0.5) and 0.0 < got[k] < 1.0 for k in want)
    # Each tree has a bootstrap of its own, of about as many rows.
    PipelineModel(stages).save(str(tmp_path / "forest"))
    again = PipelineModel.load(str(tmp_path / "forest"))
    assert {tuple(r[VECTOR]): r["probability"][1] for r in again.transform(points).collect()} == got
    vectors.unpersist()


def test_draws_are_poisson_numbers_of_the_weight(spark):
    flat = spark.range(50).select(
        F.col("id").cast("double").alias("x"), F.lit(1.0).alias(LABEL), F.lit(400.0).alias(WEIGHT)
    )
    table = VectorAssembler(inputCols=["x"], outputCol=BINNED).transform(flat)
    drawn = np.array([r[DRAWS] for r in with_draws(table, LABEL, 40, 7).collect()])
    assert abs(drawn.mean() - 400) < 3 and abs(drawn.std() - 20) < 2
    assert len({tuple(r) for r in drawn.tolist()}) == 50


def test_a_forest_of_numbers_grows_on_drawn_rows(spark, tmp_path):
    rows = spark.range(1_200_000, numPartitions=8).select(
        (F.col("id") % 8).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"),
        (F.col("id") % 8 + F.pow(F.col("id") % 5, 2) + 4 * F.rand(3)).alias(LABEL),
    )
    vectors = VectorAssembler(inputCols=["a", "b"], outputCol=VECTOR).transform(rows).persist()
    shape, effort = TrainShape(1_200_000), Effort(trees=6, tree_depth=12)
    every = {"featureSubsetStrategy": "all"}  # else trees differ by the features they see
    stages = fit_stages(vectors, "random_forest", "regression", shape, effort, every)
    assert len(stages) == 2 and stages[1].getNumTrees == 6
    plain = estimator("random_forest", "regression", shape, effort, **every).fit(vectors)
    points = vectors.select(VECTOR).distinct()
    got = {tuple(r[VECTOR]): r["prediction"] for r in PipelineModel(stages).transform(points).collect()}
    want = {tuple(r[VECTOR]): r["prediction"] for r in plain.transform(points).collect()}
    assert got.keys() == want.keys() and len(got) == 40
    assert all(abs(got[k] - want[k]) < 0.1 for k in want)
    PipelineModel(stages).save(str(tmp_path / "forest"))
    again = PipelineModel.load(str(tmp_path / "forest"))
    assert {tuple(r[VECTOR]): r["prediction"] for r in again.transform(points).collect()} == got
    # The draws of a combination are those of its rows: their number and their mean label vary.
    numbers = bin_numbers(vectors, VECTOR, 1_200_000, 32, 1)
    drawn = with_drawn_labels(vectors, numbers, LABEL, 5, 7, 6).collect()
    times = np.array([r[DRAWS] for r in drawn])
    sums = np.array([r[MEANS] for r in drawn]) * times
    whole = vectors.agg(F.sum(LABEL)).first()[0]
    assert (np.abs(times.sum(axis=0) - 1_200_000) < 6 * 1_200_000**0.5).all()
    assert (np.abs(sums.sum(axis=0) / whole - 1) < 0.01).all() and len(set(sums.sum(axis=0))) == 5
    vectors.unpersist()
