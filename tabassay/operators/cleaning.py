"""Cleaning decisions, imputation, encoding, alignment and scaling as column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabassay.functions.families import columns_of, require_column
from tabassay.functions.missing import is_missing, quoted
from tabassay.functions.scalars import as_double
from tabassay.operators.frames import aggregate, to_frame
from tabassay.operators.profile import doubles, string_modes, top_values, value_counts
from tabassay.operators.selection import exact_quantiles

MAX_LEVELS = 50
UNKNOWN = "Unknown"

# Estimates this far from the limit cannot be on its other side.
_CLEARLY_FEW, _CLEARLY_MANY = 0.8, 1.25


def require_rows(df: DataFrame) -> None:
    if df.isEmpty():
        raise ValueError("the input holds no rows")


def drop_datetime(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    return df.drop(*[c for c in columns_of(df, "datetime") if c not in keep])


def all_null_columns(df: DataFrame) -> list[str]:
    row = aggregate(
        df,
        [
            F.count(F.when(~is_missing(f), F.lit(1))).alias(str(i))
            for i, f in enumerate(df.schema)
        ],
    )
    return [n for i, n in enumerate(df.columns) if row[str(i)] == 0]


def _distinct_sketch(c: str) -> Column:
    return F.approx_count_distinct(quoted(c), 0.02)


def _settle_close(df: DataFrame, estimates: Mapping[str, int], limit: int) -> list[str]:
    """Columns over the limit; those estimated near it, which are small, counted exactly."""
    close = [
        c for c, n in estimates.items() if _CLEARLY_FEW * limit <= n <= _CLEARLY_MANY * limit
    ]
    exact = {}
    if close:
        row = aggregate(
            df, [F.count_distinct(quoted(c)).alias(str(i)) for i, c in enumerate(close)]
        )
        exact = {c: row[str(i)] for i, c in enumerate(close)}
    return [c for c, n in estimates.items() if exact.get(c, n) > limit]


def high_cardinality_columns(
    df: DataFrame, columns: Sequence[str] | None = None, limit: int = MAX_LEVELS
) -> list[str]:
    """String columns with more than ``limit`` distinct values, from a sketch per column."""
    names = columns_of(df, "string") if columns is None else list(columns)
    row = aggregate(df, [_distinct_sketch(c).alias(str(i)) for i, c in enumerate(names)])
    return _settle_close(df, {c: row[str(i)] for i, c in enumerate(names)}, limit)


@dataclass
class Cleaned:
    """The cleaned table, what was removed, and the column counts before and after."""

    data: DataFrame
    issues: DataFrame
    columns_before: int
    columns_after: int


def clean(
    df: DataFrame, target: str, keep: Sequence[str] = (), limit: int = MAX_LEVELS
) -> Cleaned:
    """Drop datetime, all-null and high-cardinality string columns, never the target.

    One aggregate decides about all columns.
    """
    require_column(df, target)
    kept = {target, *keep}
    steps: list[tuple[str, str]] = []
    dates = [c for c in columns_of(df, "datetime") if c not in kept]
    rest = df.drop(*dates)
    judged = [f for f in rest.schema if f.name not in kept]
    texts = [c for c in columns_of(rest, "string") if c not in kept]
    row = aggregate(
        rest,
        [
            *[F.count(F.when(~is_missing(f), 1)).alias(f"n:{f.name}") for f in judged],
            *[_distinct_sketch(c).alias(f"d:{c}") for c in texts],
        ],
    )
    empty = [f.name for f in judged if row[f"n:{f.name}"] == 0]
    wide = _settle_close(rest, {c: row[f"d:{c}"] for c in texts}, limit)
    steps += [("datetime", c) for c in dates]
    steps += [("all_null", c) for c in empty]
    steps += [("high_cardinality", c) for c in wide]
    rest = rest.drop(*empty, *wide)
    issues = to_frame(df.sparkSession, steps, "step string, column_name string")
    return Cleaned(rest, issues, len(df.columns), len(rest.columns))


def attach_labels(features: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Rows that have a label, joined on the row key; Spark picks the join by size."""
    require_column(features, key)
    require_column(labels, key)
    return features.join(labels, key, "inner")


def split_features_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    require_column(df, target)
    return df.drop(target), df.select(quoted(target))


def replace_columns(df: DataFrame, new: Mapping[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else quoted(c) for c in df.columns])


def numeric_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    cols = doubles(df, columns)
    row = aggregate(df, [F.avg(c).alias(str(i)) for i, c in enumerate(cols.values())])
    return {n: row[str(i)] for i, n in enumerate(columns)}


def impute_mean(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Fill missing numbers with the column mean."""
    names = columns_of(df, "numeric") if columns is None else list(columns)
    means = numeric_means(df, names)
    filled = {
        n: F.coalesce(c, F.lit(means[n]).cast("double")) for n, c in doubles(df, names).items()
    }
    return replace_columns(df, filled)


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value per string column, the smallest on ties."""
    found = {r["column_name"]: r["mode"] for r in string_modes(value_counts(df, columns)).collect()}
    return {c: found.get(c, UNKNOWN) for c in columns}


def impute_mode(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Fill missing strings with the column mode, or ``Unknown`` where there is none."""
    names = columns_of(df, "string") if columns is None else list(columns)
    fill = modes(df, names)
    return replace_columns(df, {c: F.coalesce(quoted(c), F.lit(fill[c])) for c in names})


def drop_null_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop(subset=list(columns) if columns is not None else df.columns)


def levels(
    df: DataFrame, columns: Sequence[str], limit: int = MAX_LEVELS
) -> dict[str, list[str]]:
    """Sorted distinct values of low-cardinality string columns."""
    out: dict[str, list[str]] = {c: [] for c in columns}
    if not columns:
        return out
    for row in top_values(value_counts(df, columns), limit + 1).collect():
        out[row["column_name"]].append(row["value"])
    for c, values in out.items():
        if len(values) > limit:
            raise ValueError(f"column '{c}' has more than {limit} distinct values")
    return {c: sorted(v) for c, v in out.items()}


def one_hot(
    df: DataFrame, known: Mapping[str, Sequence[str]], drop_first: bool = True
) -> DataFrame:
    """Replace string columns by 0/1 columns ``column_level``, first level dropped.

    Other columns come first, in order; a value that is not a known level gives zeros.
    """
    rest = [quoted(c) for c in df.columns if c not in known]
    dummies = [
        F.coalesce((quoted(c) == level).cast("double"), F.lit(0.0)).alias(f"{c}_{level}")
        for c, values in known.items()
        for level in (values[1:] if drop_first else values)
    ]
    return df.select(*rest, *dummies)


def align_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Exactly the given numeric columns in that order; absent ones are 0."""
    present = set(df.columns)
    return df.select(
        *[
            (F.coalesce(quoted(n).cast("double"), F.lit(0.0)) if n in present else F.lit(0.0)).alias(n)
            for n in names
        ]
    )


def sanitize(name: str) -> str:
    """Strip, then turn ``-``, blanks and dots into underscores."""
    return re.sub(r"[- .]", "_", name.strip())


def sanitize_names(df: DataFrame) -> DataFrame:
    names = [sanitize(c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"column names collide after sanitising: {names}")
    return df.toDF(*names)


def cast_scored(df: DataFrame, label: str = "y", score: str = "p") -> DataFrame:
    """Labels as int and scores as double; a value that is neither raises."""
    return replace_columns(
        df, {label: quoted(label).cast("int"), score: quoted(score).cast("double")}
    )


SCALINGS = ("standard", "minmax", "robust")


def scaling_stats(
    df: DataFrame, columns: Sequence[str], method: str
) -> dict[str, tuple[float, float]]:
    """Centre and spread per column; a column without spread is only centred.

    ``standard`` uses mean and population deviation, ``minmax`` minimum and range,
    ``robust`` median and interquartile range.
    """
    if method not in SCALINGS:
        raise ValueError(f"unknown scaling '{method}'; choose from {SCALINGS}")
    cols = doubles(df, columns)
    if method == "robust":
        quantiles, _ = exact_quantiles(df, cols, (0.25, 0.5, 0.75))
        pairs = {
            n: (q[0.5], None if q[0.25] is None else q[0.75] - q[0.25])
            for n, q in quantiles.items()
        }
    else:
        first, second = {"standard": (F.avg, F.stddev_pop), "minmax": (F.min, F.max)}[method]
        exprs = [
            f(c).alias(f"{k}_{i}")
            for i, c in enumerate(cols.values())
            for k, f in (("a", first), ("b", second))
        ]
        row = aggregate(df, exprs)
        pairs = {}
        for i, n in enumerate(columns):
            a, b = row[f"a_{i}"], row[f"b_{i}"]
            pairs[n] = (a, b - a if method == "minmax" and a is not None else b)
    return {n: (a if a is not None else 0.0, b or 1.0) for n, (a, b) in pairs.items()}


def apply_scaling(df: DataFrame, stats: Mapping[str, tuple[float, float]]) -> DataFrame:
    return replace_columns(
        df,
        {
            n: (as_double(quoted(n), df.schema[n].dataType) - F.lit(a)) / F.lit(b)
            for n, (a, b) in stats.items()
        },
    )


def scale(df: DataFrame, columns: Sequence[str], method: str = "standard") -> DataFrame:
    return apply_scaling(df, scaling_stats(df, columns, method))
