"""One notion of "missing": null, NaN and the usual not-available tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings of "not available" that tabular readers treat as missing.
NA_TOKENS = ("", "NA", "N/A", "NaN", "nan", "null", "NULL", "None", "n/a", "#N/A", "<NA>")

_FLOATS = (T.FloatType, T.DoubleType)


def quoted(name: str) -> Column:
    """Reference a top-level column whatever characters its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_missing(field: T.StructField) -> Column:
    c = quoted(field.name)
    return (c.isNull() | F.isnan(c)) if isinstance(field.dataType, _FLOATS) else c.isNull()


def normalize_missing(df: DataFrame, tokens: tuple[str, ...] = ()) -> DataFrame:
    """Turn NaN, and strings that equal one of ``tokens``, into null."""
    out = []
    for field in df.schema:
        c = quoted(field.name)
        if isinstance(field.dataType, _FLOATS):
            c = F.nanvl(c, F.lit(None).cast(field.dataType)).alias(field.name)
        elif tokens and isinstance(field.dataType, T.StringType):
            c = F.when(~F.trim(c).isin(*tokens), c).alias(field.name)
        out.append(c)
    return df.select(*out)


def _finite(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, _FLOATS):
        bad = F.isnan(c) | c.isin(float("inf"), float("-inf"))
        return F.when(~bad, c)
    if isinstance(dtype, T.StructType):
        rebuilt = F.struct(
            *[_finite(c.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        )
        return F.when(c.isNotNull(), rebuilt)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _finite(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda _, v: _finite(v, dtype.valueType))
    return c


def nan_to_null(df: DataFrame) -> DataFrame:
    """Null out NaN and both infinities, also inside structs, arrays and maps."""
    return df.select(
        *[_finite(quoted(f.name), f.dataType).alias(f.name) for f in df.schema]
    )
