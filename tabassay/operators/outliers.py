"""Values outside 1.5 interquartile ranges."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabassay.functions.families import columns_of
from tabassay.functions.missing import quoted
from tabassay.functions.stats import percent
from tabassay.operators.frames import one_row_per, to_frame
from tabassay.operators.profile import Facts, doubles
from tabassay.operators.selection import exact_quantiles

Bounds = Mapping[str, tuple[float, float]]

FENCE = 1.5


def outlier_bounds(facts: Facts) -> dict[str, tuple[float, float]]:
    """Lower and upper fence per column; columns without spread are left out."""
    out = {}
    for name, m in facts.numeric.items():
        if m["q25"] is None or m["q75"] - m["q25"] == 0:
            continue
        spread = m["q75"] - m["q25"]
        out[name] = (m["q25"] - FENCE * spread, m["q75"] + FENCE * spread)
    return out


def fitted_bounds(df: DataFrame) -> dict[str, tuple[float, float]]:
    """Fences of every numeric column of ``df`` from its exact quartiles."""
    quantiles, _ = exact_quantiles(df, doubles(df, columns_of(df, "numeric")), (0.25, 0.75))
    return outlier_bounds(
        Facts({n: {"q25": q[0.25], "q75": q[0.75]} for n, q in quantiles.items()})
    )


def _outside(df: DataFrame, bounds: Bounds) -> dict[str, Column]:
    cols = doubles(df, list(bounds))
    return {n: (c < bounds[n][0]) | (c > bounds[n][1]) for n, c in cols.items()}


def outlier_aggregates(df: DataFrame, bounds: Bounds) -> list[Column]:
    """One ``outliers_<i>`` count per bounded column, to share a scan."""
    outside = _outside(df, bounds)
    return [F.count_if(o).alias(f"outliers_{i}") for i, o in enumerate(outside.values())]


OUTLIER_SCHEMA = (
    "column_name string, lower_bound double, upper_bound double, "
    "outlier_count bigint, outlier_percentage double"
)


def outliers_of(df: DataFrame, bounds: Bounds, row: DataFrame) -> DataFrame:
    """Outlier table from a row that holds ``rows`` and :func:`outlier_aggregates`."""
    if not bounds:
        return to_frame(df.sparkSession, [], OUTLIER_SCHEMA)
    return one_row_per(
        row,
        [
            F.struct(
                F.lit(n).alias("column_name"),
                F.lit(low).alias("lower_bound"),
                F.lit(high).alias("upper_bound"),
                F.col(f"outliers_{i}").alias("outlier_count"),
                percent(F.col(f"outliers_{i}"), F.col("rows")).alias("outlier_percentage"),
            )
            for i, (n, (low, high)) in enumerate(bounds.items())
        ],
    )


def outliers(df: DataFrame, bounds: Bounds | None = None) -> DataFrame:
    """Fences, outlier count and share of all rows, per numeric column with spread."""
    if bounds is None:
        bounds = fitted_bounds(df)
    row = df.agg(F.count(F.lit(1)).alias("rows"), *outlier_aggregates(df, bounds))
    return outliers_of(df, bounds, row)


def outlier_ids(
    df: DataFrame, key: str, bounds: Bounds | None = None, limit: int = 100
) -> DataFrame:
    """The first ``limit`` outlying row keys per column, in key order."""
    if bounds is None:
        bounds = fitted_bounds(df.drop(key))
    kind = df.schema[key].dataType.simpleString()
    if not bounds:
        return to_frame(df.sparkSession, [], f"column_name string, row_key {kind}, rnk int")
    hits = F.array(*[F.when(o, F.lit(n)) for n, o in _outside(df, bounds).items()])
    w = Window.partitionBy("column_name").orderBy("row_key")
    return (
        df.select(
            quoted(key).alias("row_key"),
            F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("column_name"),
        )
        .withColumn("rnk", F.row_number().over(w))
        .filter(F.col("rnk") <= limit)
        .select("column_name", "row_key", "rnk")
    )


def outlier_total(df: DataFrame, bounds: Bounds | None = None) -> DataFrame:
    """Outliers over all columns; a row counts once for each column it is outlying in."""
    return outliers(df, bounds).agg(
        F.coalesce(F.sum("outlier_count"), F.lit(0)).alias("outlier_count")
    )
