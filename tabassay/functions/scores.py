"""What counts as a score and a label, for every evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def usable(df: DataFrame, name: str) -> Column:
    """The column, with NaN as null: such a row is left out, not called positive."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(name), F.col(name))
    return F.col(name)


def settled(scored: DataFrame, label: str = "y", score: str = "p") -> DataFrame:
    """``scored`` with unusable labels and scores as nulls."""
    found = {n: usable(scored, n) for n in (label, score) if n in scored.columns}
    return scored.withColumns(found)


def left_out(label: str = "y", score: str = "p") -> Column:
    """Aggregate: rows without a usable label and score, of settled rows."""
    return F.count_if(F.col(label).isNull() | F.col(score).isNull())
