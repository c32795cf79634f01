"""Why a prediction came out as it did."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabassay.functions.missing import quoted
from tabassay.operators.features import VECTOR, fill_absent_inputs
from tabassay.operators.frames import aggregate
from tabassay.operators.modeling import FittedModel, feature_importance, predict, predictor
from tabassay.operators.profile import doubles


def linear_contributions(
    df: DataFrame, key: str, coefficients: Mapping[str, float], means: Mapping[str, float] | None = None
) -> DataFrame:
    """Coefficient times distance from the mean, per row and feature.

    For a linear model with independent features these are the exact Shapley values.
    """
    cols = doubles(df, list(coefficients))
    if means is None:
        row = aggregate(df, [F.avg(c).alias(str(i)) for i, c in enumerate(cols.values())])
        means = {n: row[str(i)] for i, n in enumerate(cols)}
    return df.select(
        quoted(key).alias("row_key"),
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(n).alias("feature"),
                        (F.lit(coefficients[n]) * (c - F.lit(means[n]))).alias("contribution"),
                    )
                    for n, c in cols.items()
                ]
            )
        ),
    )


def model_contributions(model: FittedModel, df: DataFrame, key: str) -> DataFrame:
    """Contributions under a fitted linear model, in its encoded features."""
    fitted: Model = predictor(model)
    if not hasattr(fitted, "coefficients") or fitted.getFeaturesCol() != VECTOR:
        raise ValueError(f"'{model.algorithm}' is not a linear model on the features")
    data = fill_absent_inputs(df, model.inputs)
    for stage in model.pipeline.stages:
        if stage is fitted:
            break
        data = stage.transform(data)
    mean = data.agg(Summarizer.mean(F.col(VECTOR))).first()[0].toArray()
    parts = F.arrays_zip(
        F.array(*[F.lit(n) for n in model.features]).alias("feature"),
        F.zip_with(
            F.zip_with(
                vector_to_array(F.col(VECTOR)),
                F.array(*[F.lit(float(m)) for m in mean]),
                lambda x, m: x - m,
            ),
            F.array(*[F.lit(float(c)) for c in fitted.coefficients]),
            lambda d, c: d * c,
        ).alias("contribution"),
    )
    return data.select(quoted(key).alias("row_key"), F.inline(parts))


def explain(model: FittedModel, df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Predictions, and the model-wide importance behind them."""
    return predict(model, df), feature_importance(model)
