"""Small scalar helpers: names, labels, elapsed time, clamping, bands, probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalized_name(c: Column) -> Column:
    return F.lower(F.trim(c))


def label_from_name(c: Column) -> Column:
    """``data_loading`` becomes ``Data Loading``."""
    return F.initcap(F.replace(c, F.lit("_"), F.lit(" ")))


def elapsed_seconds(started: Column, ended: Column) -> Column:
    return F.timestamp_diff("SECOND", started, ended)


def microseconds(c: Column) -> Column:
    """Microseconds since 1970, order preserving, for timestamps with or without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c)


def clamp_percent(c: Column) -> Column:
    return F.least(F.lit(100), F.greatest(F.lit(0), c))


def band(c: Column, steps: Sequence[tuple[float, str]], otherwise: str) -> Column:
    """The label of the first step whose lower limit ``c`` reaches."""
    if not steps:
        return F.lit(otherwise)
    limit, label = steps[0]
    out = F.when(c >= limit, label)
    for limit, label in steps[1:]:
        out = out.when(c >= limit, label)
    return out.otherwise(otherwise)


def as_double(c: Column, dtype: T.DataType | None = None) -> Column:
    """Double with NaN as null, the form every numeric operator works on."""
    d = c.cast("double")
    if dtype is not None and not isinstance(dtype, (T.FloatType, T.DoubleType)):
        return d
    return F.nanvl(d, F.lit(None).cast("double"))


def probability_map(classes: Sequence[str], probability: Column) -> Column:
    """Class name to probability, rounded to four digits."""
    rounded = F.transform(vector_to_array(probability), lambda p: F.round(p, 4))
    return F.map_from_arrays(F.array(*[F.lit(str(c)) for c in classes]), rounded)


def confidence(probability: Column) -> Column:
    return F.round(F.array_max(vector_to_array(probability)), 4)
