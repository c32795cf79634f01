"""Aggregate expressions whose edge cases match the usual data-frame tools."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that gives null, not an error, when the denominator is zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def percent(part: Column, whole: Column) -> Column:
    return ratio(part, whole) * 100.0


def sample_shape(
    n: int, constant: bool, s2: float | None, s3: float | None, s4: float | None
) -> tuple[float | None, float | None]:
    """Bias-corrected skewness and excess kurtosis from sums of powers about the mean.

    Skewness needs three values and kurtosis four; both are 0 for a constant.
    """
    if s2 is None or n < 3:
        return None, None
    if constant or s2 == 0:
        return 0.0, 0.0 if n >= 4 else None
    g1 = (s3 / n) / (s2 / n) ** 1.5
    skew = g1 * math.sqrt(n * (n - 1.0)) / (n - 2)
    if n < 4:
        return skew, None
    g2 = (s4 / n) / (s2 / n) ** 2 - 3.0
    return skew, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1) * g2 + 6)


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are present; null for a constant.

    The built-in ``corr`` raises on a constant column under ANSI mode.
    """
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
