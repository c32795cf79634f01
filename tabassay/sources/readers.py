"""Tabular readers with one missing-value notion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabassay.functions.missing import NA_TOKENS, normalize_missing, quoted
from tabassay.operators.frames import aggregate


# Types tried in order, and the form a text must have: a cast alone also takes codes such as 1D.
_KINDS = {
    "bigint": r"^\s*[+-]?\d+\s*$",
    "double": r"^\s*(?i)[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$",
    "boolean": r"^(?i)(true|false)$",
    "date": r"^\d{4}-\d{2}-\d{2}$",
    "timestamp_ntz": r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?$",
    "timestamp": r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?$",
}


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A CSV file or folder with a header row.

    Types are inferred unless ``schema`` is given; inference costs one more scan, so
    large inputs should bring their schema. Not-available tokens become null before
    numbers are inferred, and a malformed row stops the read.
    """
    if not any(path.rstrip("/").endswith(s) for s in (".csv", ".csv.gz", ".csv.bz2", ".csv.zst")):
        raise ValueError("only .csv inputs are supported here")
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    if schema is not None:
        return normalize_missing(reader.schema(schema).csv(path), NA_TOKENS)
    raw = reader.csv(path)
    cleaned = normalize_missing(raw, NA_TOKENS)
    return _infer(cleaned)


def _infer(strings: DataFrame) -> DataFrame:
    """Give each all-string column the narrowest type every value converts to."""
    exprs = []
    for i, name in enumerate(strings.columns):
        c = quoted(name)
        exprs.append(F.count(c).alias(f"n_{i}"))
        for kind, pattern in _KINDS.items():
            fits = F.when(c.rlike(pattern), c.try_cast(kind))
            exprs.append(F.count(fits).alias(f"{kind}_{i}"))
    row = aggregate(strings, exprs)
    out = []
    for i, name in enumerate(strings.columns):
        total = row[f"n_{i}"]
        kind = next((k for k in _KINDS if total and row[f"{k}_{i}"] == total), "string")
        out.append(quoted(name).cast(kind).alias(name))
    return strings.select(*out)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """Pick the reader by extension; no extension means Parquet."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if ".csv" in name:
        return read_csv(spark, path)
    if name.endswith(".xlsx"):
        raise ValueError("spreadsheets are not supported; export to CSV or Parquet")
    return read_parquet(spark, path)


def find_dataset(spark: SparkSession, folder: str, dataset_id: str) -> DataFrame:
    """Read a dataset by id: the bare name, then as ``.csv``, then as ``.parquet``."""
    for suffix in ("", ".csv", ".parquet"):
        try:
            return read_any(spark, f"{folder.rstrip('/')}/{dataset_id}{suffix}")
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"no dataset '{dataset_id}' in {folder}")


def from_rows(
    spark: SparkSession, rows: Sequence[Mapping[str, Any]], schema: T.StructType | str | None = None
) -> DataFrame:
    """Inline records; columns are the union of keys, absent keys become null."""
    if not rows:
        raise ValueError("no rows given")
    names = list(dict.fromkeys(k for row in rows for k in row))
    if schema is None:
        kinds = {n: _kind([row.get(n) for row in rows]) for n in names}
        schema = T.StructType([T.StructField(n, kinds[n]) for n in names])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    data = []
    for row in rows:
        data.append(tuple(_fit(row.get(f.name), f.dataType) for f in schema))
    return spark.createDataFrame(data, schema)


def _kind(values: list[Any]) -> T.DataType:
    present = [v for v in values if v is not None]
    if present and all(isinstance(v, bool) for v in present):
        return T.BooleanType()
    if present and all(isinstance(v, int) and not isinstance(v, bool) for v in present):
        return T.LongType()
    if present and all(isinstance(v, (int, float)) for v in present):
        return T.DoubleType()
    return T.StringType()


def _fit(value: Any, kind: T.DataType) -> Any:
    if value is None:
        return None
    if isinstance(kind, T.DoubleType):
        return float(value)
    return str(value) if isinstance(kind, T.StringType) else value
