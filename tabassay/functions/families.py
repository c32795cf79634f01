"""Column families by declared type; no data is read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_FAMILIES = {
    "numeric": (T.NumericType,),
    "string": (T.StringType,),
    "datetime": (T.DateType, T.TimestampType, T.TimestampNTZType),
    "boolean": (T.BooleanType,),
}


def columns_of(df: DataFrame, family: str) -> list[str]:
    """Names of the ``numeric``, ``string``, ``datetime`` or ``boolean`` columns, in order."""
    kinds = _FAMILIES[family]
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def require_column(df: DataFrame, name: str) -> None:
    """Fail before any job runs when ``name`` is absent."""
    if name not in df.columns:
        raise ValueError(f"column '{name}' not found; columns are {df.columns}")
