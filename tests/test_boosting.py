import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabassay.operators.boosting import (
    BoostedTrees, SecondOrderBoosting, Settings, _Growth, derivatives, slopes,
)


def derived(objective, margins, y):
    if objective == "squared":
        return margins - y[:, None], np.ones_like(margins)
    if objective == "logistic":
        p = 1 / (1 + np.exp(-margins))
        return p - y[:, None], p * (1 - p)
    powers = np.exp(margins - margins.max(axis=1, keepdims=True))
    p = powers / powers.sum(axis=1, keepdims=True)
    return p - np.eye(margins.shape[1])[y.astype(int)], 2 * p * (1 - p)


def plain_tree(x, g, h, rows, depth, penalty, least):
    """Weights of the rows by exact greedy splits on the distinct values."""
    out = np.zeros(len(x))
    g_all, h_all = g[rows].sum(), h[rows].sum()
    best = (1e-12, None)
    for f in range(x.shape[1]) if depth else ():
        for edge in np.unique(x[:, f]):
            left = rows & (x[:, f] < edge)
            right = rows & ~left
            if h[left].sum() < least or h[right].sum() < least:
                continue
            gain = sum(g[s].sum() ** 2 / (h[s].sum() + penalty) for s in (left, right))
            gain = 0.5 * (gain - g_all**2 / (h_all + penalty))
            if gain > best[0] + 1e-9:
                best = (gain, (left, right))
    if best[1] is None:
        out[rows] = -g_all / (h_all + penalty)
        return out
    return sum(plain_tree(x, g, h, s, depth - 1, penalty, least) for s in best[1])


def plain_boosting(x, y, objective, classes, rounds, step, depth, penalty=1.0, least=1.0):
    shares = np.array([np.mean(y == k) for k in range(classes)])
    if objective == "squared":
        start = [y.mean()]
    else:
        start = np.log(shares) if objective == "softmax" else [np.log(shares[1] / shares[0])]
    margins = np.tile(np.asarray(start, dtype=float), (len(y), 1))
    every = np.ones(len(y), dtype=bool)
    for _ in range(rounds):
        g, h = derived(objective, margins, y)
        for k in range(margins.shape[1]):
            margins[:, k] += step * plain_tree(x, g[:, k], h[:, k], every, depth, penalty, least)
    return margins


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.integers(0, 25, 500), rng.integers(0, 30, 500) / 3, np.full(500, 2.0)])
    z = np.sin(x[:, 0] / 4) * 3 + x[:, 1] / 2 + rng.normal(0, 0.4, 500)
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf["number"], pdf["two"] = z, (z > 2).astype(float)
    pdf["three"] = np.digitize(z, [1, 4]).astype(float)
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(
        spark.createDataFrame(pdf)
    )
    return x, pdf, df.repartition(4).persist()


OBJECTIVES = [("squared", "number", 2), ("logistic", "two", 2), ("softmax", "three", 3)]


def scored_margins(model, df, pdf, objective):
    scored = model.transform(df).toPandas()
    merged = pdf.reset_index().merge(
        scored.drop_duplicates(["a", "b", "number"]), on=["a", "b", "number"]
    ).sort_values("index")
    return merged


@pytest.mark.parametrize("objective,label,classes", OBJECTIVES)
def test_equals_plain_boosting(table, objective, label, classes):
    x, pdf, df = table
    y = pdf[label].to_numpy()
    made = SecondOrderBoosting(
        featuresCol="features", labelCol=label, objective=objective, classes=classes, maxIter=6,
        stepSize=0.3, maxDepth=3,
    )
    found = scored_margins(made.fit(df), df, pdf, objective)
    wanted = plain_boosting(x, y, objective, classes, 6, 0.3, 3)
    if objective == "squared":
        assert np.allclose(found["prediction"], wanted[:, 0], atol=1e-8)
        return
    raw = np.stack([v.toArray() for v in found["rawPrediction"]])
    assert np.allclose(raw if objective == "softmax" else raw[:, 1:], wanted, atol=1e-8)
    chances = np.stack([v.toArray() for v in found["probability"]])
    assert np.allclose(chances.sum(axis=1), 1)
    assert (chances.argmax(axis=1) == found["prediction"]).all()


def test_models_grown_together_equal_models_grown_alone(table):
    _, _, df = table
    made = SecondOrderBoosting(featuresCol="features", labelCol="three", objective="softmax", classes=3, maxIter=12, maxDepth=2)
    parts = [df.filter("a < 15"), df, df.filter("b > 4")]
    for together, part in zip(made.fit_together(parts), parts, strict=True):
        alone = made.fit(part)
        ours, theirs = together.content, alone.content
        assert np.allclose(ours["start"], theirs["start"])
        for one, other in zip(ours["rounds"], theirs["rounds"], strict=True):
            for a, b in zip(one, other, strict=True):
                depth = len(b["features"])  # beside other models a tree may be padded
                assert a["features"][:depth] == b["features"]
                assert np.allclose(a["leaves"][:: len(a["leaves"]) // len(b["leaves"])], b["leaves"])


def test_saved_model_and_importances(table, tmp_path):
    _, _, df = table
    made = SecondOrderBoosting(featuresCol="features", labelCol="number", maxIter=3, maxDepth=2)
    model = made.fit(df)
    shares = model.featureImportances.toArray()
    assert shares.sum() == pytest.approx(1) and shares[2] == 0 and shares[0] > 0
    PipelineModel(stages=[model]).write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert isinstance(again.stages[0], BoostedTrees)
    key = ["a", "b", "prediction"]
    assert again.transform(df).select(key).exceptAll(model.transform(df).select(key)).isEmpty()
    with pytest.raises(ValueError):
        made.fit(df.filter("a < 0"))


@pytest.mark.parametrize("objective,label,classes", OBJECTIVES)
def test_derivatives(spark, objective, label, classes):
    margins = [[0.3, -1.0, 2.0][:1 if objective != "softmax" else 3], [-40.0, 0.0, 50.0][:1 if objective != "softmax" else 3]]
    df = spark.createDataFrame([(m, 1.0) for m in margins], "m array<double>, y double")
    found = df.select(derivatives(objective, F.col("m"), F.col("y")).alias("d")).collect()
    g, h = derived(objective, np.array(margins), np.ones(2))
    assert np.allclose([[x["g"] for x in r["d"]] for r in found], g)
    assert np.allclose([[x["h"] for x in r["d"]] for r in found], np.maximum(h, 1e-16))


@pytest.mark.parametrize("objective,label,classes", OBJECTIVES)
def test_rows_of_equal_bins_are_one(table, objective, label, classes):
    _, _, df = table
    rows = df.select(F.col(label).alias("y"), F.array("a", "b", "c").alias("x"))
    many = rows.union(rows).union(rows)
    patterns = rows.select("x", "y") if objective == "softmax" else rows.select("x")
    for frame, times in ((rows, 1), (many, 3)):
        state = _Growth([frame], objective, classes, Settings()).state
        assert state.count() <= patterns.distinct().count()
        assert state.agg(F.sum("n")).first()[0] == 500 * times


@pytest.mark.parametrize("objective,label,classes", OBJECTIVES)
def test_slopes_equal_the_derivatives_in_sql(spark, objective, label, classes):
    rng = np.random.default_rng(9)
    margins = rng.normal(0, 30, (20, 3 if objective == "softmax" else 1))
    y = rng.integers(0, classes, 20).astype(float)
    df = spark.createDataFrame(list(zip(margins.tolist(), y.tolist())), "m array<double>, y double")
    found = df.select(derivatives(objective, F.col("m"), F.col("y")).alias("d")).collect()
    for name, ours in zip("gh", slopes(objective, margins, y), strict=True):
        assert np.allclose([[x[name] for x in r["d"]] for r in found], ours, rtol=1e-9, atol=1e-18)


def test_plans_of_later_rounds_stay_small(table):
    """The driver keeps plans: none may carry trees, nor grow with the models beside it."""
    _, _, df = table
    rows = df.select(F.col("number").alias("y"), F.array("a", "b", "c").alias("x"))
    texts = []
    for frames in ([rows], [rows] * 6):
        growth = _Growth(frames, "squared", 2, Settings(rounds=3, depth=5))
        growth.fit()
        texts.append(len(growth.moved._jdf.queryExecution().toString()))
    assert max(texts) < 20_000
