import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabassay.operators.prefix import ordered_position, running
from tabassay.operators.selection import exact_quantiles, kth_smallest


def _frames(spark):
    rng = np.random.default_rng(7)
    n = 4000
    hot = np.where(rng.random(n) < 0.4, 5.0, rng.normal(5, 3, n))
    pdf = pd.DataFrame(
        {
            "hot": hot,
            "heavy": np.exp(rng.normal(0, 3, n)),
            "few": rng.integers(0, 3, n).astype(float),
            "holes": np.where(rng.random(n) < 0.5, np.nan, rng.random(n)),
            "none": np.full(n, np.nan),
        }
    )
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("options", [{}, {"final_rows": 60, "sketch_size": 8, "slack": 0.05}])
def test_quantiles_equal_pandas_on_every_path(spark, options):
    pdf, df = _frames(spark)
    cols = {c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in pdf}
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 1.0]
    got, _ = exact_quantiles(df, cols, probs, **options)
    for c in pdf:
        for p in probs:
            want = pdf[c].quantile(p)
            assert got[c][p] is None if np.isnan(want) else got[c][p] == pytest.approx(want)


def test_kth_smallest(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("x"))
    for k in (0, 1, 2500, 4999):
        assert kth_smallest(df, F.col("x").cast("double"), k, 5000, final_rows=20) == k


@pytest.mark.parametrize("rows_per_chunk", [10_000, 100, 7])
def test_running_equals_plain_window(spark, rows_per_chunk):
    rng = np.random.default_rng(3)
    n = 1000
    pdf = pd.DataFrame(
        {
            "k": range(n),
            "g": np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", None], n)),
            "t": rng.integers(0, 40, n).astype(float),
            "v": rng.integers(0, 1000, n),
        }
    )
    df = spark.createDataFrame(pdf)
    got = running(
        df, ["g"], [F.col("t"), F.col("k")], F.col("t"),
        sums={"s": F.col("v")}, maxima={"m": F.col("v")}, rows_per_chunk=rows_per_chunk,
    ).toPandas().set_index("k").sort_index()
    ordered = pdf.sort_values(["t", "k"]).set_index("k")
    groups = ordered.groupby("g", dropna=False)["v"]
    assert (got["s"] == groups.cumsum().sort_index()).all()
    assert (got["m"] == groups.cummax().sort_index()).all()
    placed = ordered_position(
        df, [], [F.col("t"), F.col("k")], F.col("t"), rows_per_chunk=rows_per_chunk
    )
    assert sorted(r["position"] for r in placed.collect()) == list(range(1, n + 1))
