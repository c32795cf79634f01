import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler

from tabassay.operators.tube import TubeModel, TubeRegression, newton, packed, quasi_newton
from tabassay.operators import tube


def dual_descent(x, y, cost, epsilon):
    """Coefficients by coordinate descent on the dual, one row's multiplier at a time."""
    beta, w = np.zeros(len(y)), np.zeros(x.shape[1])
    square = (x**2).sum(axis=1)
    for _ in range(3000):
        for i in range(len(y)):
            slope = x[i] @ w - y[i]
            free = beta[i] - slope / square[i]
            shrunk = np.sign(free) * max(abs(free) - epsilon / square[i], 0.0)
            moved = np.clip(shrunk, -cost, cost) - beta[i]
            beta[i] += moved
            w += moved * x[i]
    return w


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(80, 3))
    y = x @ [2.0, -1.0, 0.0] + rng.normal(0, 0.4, 80)
    y[:5] += 20  # far points pull with a bounded force
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=y)
    assembler = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features")
    return x, y, assembler.transform(spark.createDataFrame(pdf).repartition(3))


@pytest.mark.parametrize("cost,epsilon", [(1.0, 0.1), (0.05, 0.5)])
def test_equals_dual_coordinate_descent(rows, cost, epsilon):
    x, y, df = rows
    made = TubeRegression(
        featuresCol="features", labelCol="y", cost=cost, epsilon=epsilon, fitIntercept=False
    )
    found = made.fit(df)
    assert np.allclose(found.coefficients.toArray(), dual_descent(x, y, cost, epsilon), atol=1e-3)
    assert found.intercept == 0.0


def test_intercept_is_free(rows):
    """The same rows further up: equal coefficients, another intercept."""
    _, _, df = rows
    made = TubeRegression(featuresCol="features", labelCol="y")
    one, two = made.fit(df), made.fit(df.withColumn("y", df.y + 1000))
    assert np.allclose(one.coefficients.toArray(), two.coefficients.toArray(), atol=2e-2)
    assert two.intercept - one.intercept == pytest.approx(1000, abs=2e-2)


def test_saved_model(rows, tmp_path):
    x, _, df = rows
    model = TubeRegression(featuresCol="features", labelCol="y", maxIter=20).fit(df)
    PipelineModel(stages=[model]).write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).stages[0]
    assert isinstance(again, TubeModel)
    got = again.transform(df).toPandas()
    wanted = got[["a", "b", "c"]] @ model.coefficients.toArray() + model.intercept
    assert np.allclose(got["prediction"], wanted)


def test_quasi_newton_finds_the_minimum():
    matrix = np.array([[5.0, 1.0], [1.0, 0.1 + 0.2]])
    target = np.array([3.0, -4.0])
    found = quasi_newton(
        lambda p: (0.5 * (p - target) @ matrix @ (p - target), matrix @ (p - target)),
        np.zeros(2), 100,
    )
    assert np.allclose(found, target, atol=1e-3)


def test_no_rows(rows):
    with pytest.raises(ValueError):
        TubeRegression(featuresCol="features", labelCol="y").fit(rows[2].filter("a > 1000"))


def test_blocks_hold_every_row(rows):
    x, y, df = rows
    plain = df.selectExpr("y", "array(a, b, c) AS x")
    blocks = packed(plain.union(plain)).collect()
    assert 0 < len(blocks) < len(x)
    found = np.concatenate([np.frombuffer(b["x"]).reshape(-1, 3) for b in blocks])
    labels = np.concatenate([np.frombuffer(b["y"]) for b in blocks])
    assert np.array_equal(np.sort(found, axis=0), np.sort(np.tile(x, (2, 1)), axis=0))
    assert np.array_equal(np.sort(labels), np.sort(np.tile(y, 2)))


def test_newton_needs_few_passes(rows, monkeypatch):
    """The minimum of the quasi-Newton steps in a fraction of the passes."""
    _, _, df = rows
    passes, plain = [], tube._sums
    monkeypatch.setattr(tube, "_sums", lambda *a: passes.append(a[-1] is not None) or plain(*a))
    made = TubeRegression(featuresCol="features", labelCol="y", cost=0.5)
    found = made.fit(df).getOrDefault("weights")
    assert all(passes) and len(passes) < 80
    monkeypatch.setattr(tube, "MOST_SQUARED", 0)
    passes.clear()
    assert np.allclose(found, made.fit(df).getOrDefault("weights"), atol=5e-3)
    assert not any(passes)


def test_newton_finds_the_minimum():
    matrix, target = np.array([[5.0, 1.0], [1.0, 0.3]]), np.array([3.0, -4.0])
    found = newton(
        lambda p, back: (
            0.5 * (p - target) @ matrix @ (p - target), matrix @ (p - target), matrix, np.full(2, np.inf)
        ),
        np.zeros(2), 3,
    )
    assert np.allclose(found, target, atol=1e-6)
