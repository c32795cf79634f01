"""Dataset description: counts, moments, quantiles, categories and missing values."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabassay.functions.families import columns_of
from tabassay.functions.hashes import hash_input, two_hashes
from tabassay.functions.missing import is_missing, quoted
from tabassay.functions.scalars import as_double
from tabassay.functions.stats import percent, sample_shape
from tabassay.operators.frames import aggregate, one_row_per, to_frame
from tabassay.operators.selection import exact_quantiles

QUARTILES = (0.25, 0.5, 0.75)

_FIXED_WIDTH = {
    T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4,
    T.DateType: 4, T.LongType: 8, T.DoubleType: 8, T.TimestampType: 8, T.TimestampNTZType: 8,
}

_MOMENTS = {
    "count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max,
}

PROFILE_SCHEMA = (
    "column_name string, mean double, median double, std double, min double, max double, "
    "q25 double, q75 double, skewness double, kurtosis double, count bigint"
)


@dataclass
class Facts:
    """Bounded statistics of one table: a handful of numbers per column."""

    numeric: dict[str, dict[str, Any]] = field(default_factory=dict)
    table: dict[str, Any] = field(default_factory=dict)


def doubles(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    return {c: as_double(quoted(c), df.schema[c].dataType) for c in columns}


def numeric_facts(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    table_aggregates: Sequence[Column] = (),
    shape: bool = True,
) -> Facts:
    """Count, moments, extremes and exact quartiles of every numeric column.

    One scan takes mean, deviation and extremes; the quartiles take three more, the
    second of which also sums the third and fourth powers about the mean.
    """
    names = columns_of(df, "numeric") if columns is None else list(columns)
    cols = doubles(df, names)
    moments = [
        f(c).alias(f"{metric}:{i}")
        for i, c in enumerate(cols.values())
        for metric, f in _MOMENTS.items()
    ]
    table = aggregate(df, list(table_aggregates)) if table_aggregates else {}
    values = aggregate(df, moments, 12 * len(_MOMENTS))
    powers = []
    for i, c in enumerate(cols.values()):
        if not shape or values[f"mean:{i}"] is None:
            continue
        d = c - values[f"mean:{i}"]
        powers += [
            F.sum(d * d).alias(f"power2:{i}"),
            F.sum(d * d * d).alias(f"power3:{i}"),
            F.sum(d * d * d * d).alias(f"power4:{i}"),
        ]
    counts = {n: values[f"count:{i}"] for i, n in enumerate(names)}
    quantiles, ridden = exact_quantiles(df, cols, QUARTILES, counts, powers)
    values.update(ridden)
    facts = Facts(table=table)
    for i, name in enumerate(names):
        m = {k.split(":")[0]: v for k, v in values.items() if k.endswith(f":{i}")}
        sums = [m.pop(f"power{p}", None) for p in (2, 3, 4)]
        m["skewness"], m["kurtosis"] = sample_shape(m["count"], m["min"] == m["max"], *sums)
        m["q25"], m["median"], m["q75"] = (quantiles[name][p] for p in QUARTILES)
        facts.numeric[name] = m
    return facts


def numeric_profile(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    """Moments, quartiles and bias-corrected shape per numeric column that has values."""
    facts = facts or numeric_facts(df)
    keys = [c.split()[0] for c in PROFILE_SCHEMA.split(", ")][1:]
    rows = [(n, *(m[k] for k in keys)) for n, m in facts.numeric.items() if m["count"]]
    return to_frame(df.sparkSession, rows, PROFILE_SCHEMA)


def describe(df: DataFrame, facts: Facts | None = None) -> DataFrame:
    """Count, mean, std, min, quartiles and max per numeric column.

    A table without numbers is described by its strings.
    """
    if facts is None and not columns_of(df, "numeric"):
        return describe_strings(df)
    facts = facts or numeric_facts(df, shape=False)
    keys = ("count", "mean", "std", "min", "q25", "median", "q75", "max")
    rows = [(n, *(m[k] for k in keys)) for n, m in facts.numeric.items()]
    schema = (
        "column_name string, count bigint, mean double, std double, min double, "
        "q25 double, q50 double, q75 double, max double"
    )
    return to_frame(df.sparkSession, rows, schema)


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows ``(column_name, value, cnt)`` for every non-null string value.

    Counts are combined before the shuffle, so a value held by a third of all rows
    travels as one row per task.
    """
    names = columns_of(df, "string") if columns is None else list(columns)
    if not names:
        return to_frame(df.sparkSession, [], "column_name string, value string, cnt bigint")
    long = df.select(*[quoted(c).alias(c) for c in names]).unpivot(
        [], [quoted(c) for c in names], "column_name", "value"
    )
    return (
        long.filter(F.col("value").isNotNull())
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def top_values(counts: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent values per column; ties go to the smaller value.

    The rank limit is applied per task before the shuffle, so a column with very many
    distinct values sends ``n`` rows per task only.
    """
    w = Window.partitionBy("column_name").orderBy(F.col("cnt").desc(), "value")
    return counts.withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= n)


#: Characters of a value that travel with its hash, to order values of one count.
PREFIX = 32
#: Candidates that may be sent to every task; more are joined by a shuffle.
SENT_ROWS = 10_000


def _hashed_strings(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``column_name``, ``value`` and the value's two hashes, for every non-null string."""
    long = df.select(*[quoted(c).alias(c) for c in names]).unpivot(
        [], [quoted(c) for c in names], "column_name", "value"
    )
    long = long.filter(F.col("value").isNotNull())
    return long.select("column_name", "value", *two_hashes([F.col("value")]))


def hashed_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """How often each string value stands in its column, by a 128-bit hash in its place.

    Rows ``(column_name, h1, h2, prefix, cnt)``: no value longer than its first characters
    is shuffled, however wide the texts are.
    """
    names = columns_of(df, "string") if columns is None else list(columns)
    if not names:
        schema = "column_name string, h1 bigint, h2 bigint, prefix string, cnt bigint"
        return to_frame(df.sparkSession, [], schema)
    hashed = _hashed_strings(df, names).withColumn("prefix", F.substring("value", 1, PREFIX))
    return hashed.groupBy("column_name", "h1", "h2", "prefix").agg(F.count(F.lit(1)).alias("cnt"))


def top_texts(df: DataFrame, counts: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most frequent values per column; ties go to the smaller value.

    Candidates are chosen by count and first characters, equal ones together; only their
    whole values are fetched from the table and put in order.
    """
    w = Window.partitionBy("column_name").orderBy(F.col("cnt").desc(), "prefix")
    wanted = counts.withColumn("place", F.rank().over(w)).filter(F.col("place") <= n)
    wanted = wanted.select("column_name", "h1", "h2", "cnt").persist()
    columns = [r[0] for r in counts.select("column_name").distinct().collect()]
    few = wanted.count() <= SENT_ROWS
    chosen = F.broadcast(wanted) if few else wanted
    if not columns:
        empty = "column_name string, value string, cnt bigint, rnk int"
        return to_frame(df.sparkSession, [], empty)
    found = (
        _hashed_strings(df, columns)
        .join(chosen, ["column_name", "h1", "h2"])
        .groupBy("column_name", "h1", "h2")
        .agg(F.first("value").alias("value"), F.first("cnt").alias("cnt"))
    )
    return top_values(found.select("column_name", "value", "cnt"), n)


def _text_modes(counts: DataFrame, tops: DataFrame) -> DataFrame:
    """As :func:`string_modes`, from hashed counts and the top values."""
    totals = counts.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("unique_values"), F.sum("cnt").alias("present")
    )
    first = tops.filter("rnk = 1").select(
        "column_name", F.col("value").alias("mode"), F.col("cnt").alias("mode_frequency")
    )
    return totals.join(first, "column_name")


def string_modes(counts: DataFrame) -> DataFrame:
    """Distinct values, non-null rows and the mode (smallest of the most frequent)."""
    return counts.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("unique_values"),
        F.sum("cnt").alias("present"),
        F.min_by("value", F.struct(-F.col("cnt"), F.col("value"))).alias("mode"),
        F.max("cnt").alias("mode_frequency"),
    )


def _string_columns(df: DataFrame) -> DataFrame:
    names = columns_of(df, "string")
    return to_frame(df.sparkSession, [(n,) for n in names], "column_name string")


def categorical_profile(
    df: DataFrame,
    counts: DataFrame | None = None,
    rows: int | None = None,
    tops: DataFrame | None = None,
) -> DataFrame:
    """Distinct values, mode and missing share per string column.

    ``counts`` and ``tops`` bring what :func:`hashed_counts` and :func:`top_texts` found.
    """
    counts = hashed_counts(df) if counts is None else counts
    tops = top_texts(df, counts, 1) if tops is None else tops
    total = df.agg(F.count(F.lit(1)).alias("rows")) if rows is None else None
    base = _string_columns(df).join(_text_modes(counts, tops), "column_name", "left")
    base = base.crossJoin(total) if total is not None else base.withColumn("rows", F.lit(rows))
    missing = F.col("rows") - F.coalesce("present", F.lit(0))
    return base.select(
        "column_name",
        F.coalesce("unique_values", F.lit(0)).alias("unique_values"),
        "mode",
        F.coalesce("mode_frequency", F.lit(0)).alias("mode_frequency"),
        missing.alias("missing_count"),
        percent(missing, F.col("rows")).alias("missing_percentage"),
    )


def describe_strings(df: DataFrame) -> DataFrame:
    """Count, unique, top and freq per string column, for tables without numbers."""
    counts = hashed_counts(df)
    modes = _text_modes(counts, top_texts(df, counts, 1))
    return (
        _string_columns(df)
        .join(modes, "column_name", "left")
        .select(
            "column_name",
            F.coalesce("present", F.lit(0)).alias("count"),
            F.coalesce("unique_values", F.lit(0)).alias("unique"),
            F.col("mode").alias("top"),
            F.col("mode_frequency").alias("freq"),
        )
    )


def missing_aggregates(df: DataFrame) -> list[Column]:
    """One ``missing_<i>`` count per column, to share a scan with other aggregates."""
    return [F.count_if(is_missing(f)).alias(f"missing_{i}") for i, f in enumerate(df.schema)]


def any_missing(df: DataFrame) -> Column:
    return reduce(lambda a, b: a | b, [is_missing(f) for f in df.schema], F.lit(False))


def missing_counts(df: DataFrame) -> DataFrame:
    """Missing values per column, from one aggregate over the table."""
    return one_row_per(
        df.agg(*missing_aggregates(df)),
        [
            F.struct(F.lit(n).alias("column_name"), F.col(f"missing_{i}").alias("missing"))
            for i, n in enumerate(df.columns)
        ],
    )


def missing_per_column(df: DataFrame) -> DataFrame:
    """Count and share of missing values, for columns that have any."""
    row = df.agg(F.count(F.lit(1)).alias("rows"), *missing_aggregates(df))
    structs = [
        F.struct(
            F.lit(n).alias("column_name"),
            F.col(f"missing_{i}").alias("missing_count"),
            percent(F.col(f"missing_{i}"), F.col("rows")).alias("missing_percentage"),
        )
        for i, n in enumerate(df.columns)
    ]
    return one_row_per(row, structs).filter(F.col("missing_count") > 0)


def summary_aggregates(df: DataFrame) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("rows"),
        F.count_if(any_missing(df)).alias("rows_with_missing"),
        *missing_aggregates(df),
    ]


def missing_summary_of(df: DataFrame, row: DataFrame) -> DataFrame:
    """Table-wide missing totals from a row of :func:`summary_aggregates`."""
    counts = [F.col(f"missing_{i}") for i in range(len(df.columns))]
    total = reduce(lambda a, b: a + b, counts, F.lit(0).cast("bigint"))
    full = F.filter(
        F.array(*[F.when(c == F.col("rows"), F.lit(n)) for n, c in zip(df.columns, counts)]),
        lambda x: x.isNotNull(),
    )
    return row.select(
        F.col("rows").alias("total_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        total.alias("total_missing"),
        percent(total, F.col("rows") * len(df.columns)).alias("total_missing_percentage"),
        "rows_with_missing",
        F.concat_ws(",", full).alias("fully_missing_columns"),
    )


def missing_summary(df: DataFrame) -> DataFrame:
    return missing_summary_of(df, df.agg(*summary_aggregates(df)))


def unique_counts(df: DataFrame, approximate: bool = False) -> DataFrame:
    """Distinct non-missing values per column; ``approximate`` uses HyperLogLog sketches.

    The exact count moves a column number and a 128-bit hash for each distinct value, not
    the values, and drops repeated ones before the shuffle.
    """
    fields = [f for f in df.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    cols = [f.name for f in fields]
    if approximate:
        present = [F.when(~is_missing(f), quoted(f.name)) for f in fields]
        row = df.agg(*[F.approx_count_distinct(c).alias(f"u_{i}") for i, c in enumerate(present)])
    else:
        marks = [
            F.when(~is_missing(f), F.struct(F.lit(i).alias("i"), *two_hashes([hash_input(f)])))
            for i, f in enumerate(fields)
        ]
        seen = df.select(F.inline(F.filter(F.array(*marks), lambda m: m.isNotNull()))).distinct()
        row = seen.agg(*[F.count_if(F.col("i") == i).alias(f"u_{i}") for i in range(len(cols))])
    return one_row_per(
        row,
        [
            F.struct(F.lit(n).alias("column_name"), F.col(f"u_{i}").alias("unique_count"))
            for i, n in enumerate(cols)
        ],
    )


def column_types(df: DataFrame) -> DataFrame:
    """Declared type per column, from the schema alone."""
    return to_frame(df.sparkSession, df.dtypes, "column_name string, data_type string")


def bytes_aggregate(df: DataFrame) -> Column:
    """Estimated bytes: fixed widths plus the length of strings."""
    fixed = sum(_FIXED_WIDTH.get(type(f.dataType), 0) for f in df.schema)
    strings = [
        F.coalesce(F.octet_length(quoted(c)), F.lit(0)).cast("bigint")
        for c in columns_of(df, "string")
    ]
    return F.sum(reduce(lambda a, b: a + b, strings, F.lit(fixed).cast("bigint")))


def dataset_info_of(df: DataFrame, row: DataFrame) -> DataFrame:
    """Shape and size from a row that holds ``rows`` and ``bytes``."""
    return row.select(
        F.col("rows"),
        F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.lit(len(columns_of(df, "numeric"))).cast("bigint").alias("numeric_features"),
        F.lit(len(columns_of(df, "string"))).cast("bigint").alias("categorical_features"),
        (F.coalesce("bytes", F.lit(0)) / F.lit(1024.0 * 1024.0)).alias("memory_usage_mb"),
    )


def dataset_info(df: DataFrame) -> DataFrame:
    row = df.agg(F.count(F.lit(1)).alias("rows"), bytes_aggregate(df).alias("bytes"))
    return dataset_info_of(df, row)


def dataset_statistics(df: DataFrame) -> DataFrame:
    """The whole description of a table as rows ``(column_name, metric, value, text)``.

    Table-wide counts carry an empty column name; declared types are texts.
    """
    facts = numeric_facts(df, shape=False, table_aggregates=summary_aggregates(df))
    rows: list[tuple[str, str, float | None]] = [
        ("", "row_count", float(facts.table["rows"])),
        ("", "column_count", float(len(df.columns))),
    ]
    rows += [
        (n, "missing", float(facts.table[f"missing_{i}"])) for i, n in enumerate(df.columns)
    ]
    for name, m in facts.numeric.items():
        for key in ("count", "mean", "std", "min", "q25", "median", "q75", "max"):
            rows.append((name, key, None if m[key] is None else float(m[key])))
    known = to_frame(df.sparkSession, rows, "column_name string, metric string, value double")
    unique = unique_counts(df).select(
        "column_name",
        F.lit("unique").alias("metric"),
        F.col("unique_count").cast("double").alias("value"),
    )
    types = column_types(df).select(
        "column_name", F.lit("dtype").alias("metric"), F.lit(None).cast("double").alias("value"),
        F.col("data_type").alias("text"),
    )
    return known.unionByName(unique).withColumn("text", F.lit(None).cast("string")).union(types)
