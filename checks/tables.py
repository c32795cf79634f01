"""Inputs of the driver queries, written once for Spark and once as SQL.

The given tables hold no missing values and no learnable label, so both sides derive
them with the same expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(
        *[
            F.round(f.name, digits).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f.name)
            for f in df.schema
        ]
    )


def r(expr: str, digits: int = 4) -> str:
    """SQL rounding that never yields a negative zero."""
    return f"(round({expr}, {digits}) + 0.0)"


def div(a: str, b: str) -> str:
    return f"(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0))"


def union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


LINEITEM_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
    "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
MEASURES = LINEITEM_NUMBERS[4:]

EVENTS_NULLS = """SELECT event_id, user_id, ts, props,
  CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END AS event_type,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value,
  CAST(NULL AS DOUBLE) AS empty
FROM events"""


def events_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "ts",
        "props",
        F.when(key % 11 != 0, F.col("event_type")).alias("event_type"),
        F.when(key % 7 != 0, F.col("value")).alias("value"),
        F.lit(None).cast("double").alias("empty"),
    )


LINEITEM_GROSS = """SELECT l_quantity, l_extendedprice, l_discount, l_tax,
  l_extendedprice * (1 + l_tax) AS gross,
  CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_quantity * 2 + l_tax END AS doubled,
  CAST(7 AS DOUBLE) AS constant
FROM lineitem"""
GROSS_COLUMNS = [
    "l_quantity", "l_extendedprice", "l_discount", "l_tax", "gross", "doubled", "constant",
]


def lineitem_gross(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("gross"),
        F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity") * 2 + F.col("l_tax")).alias(
            "doubled"
        ),
        F.lit(7.0).alias("constant"),
    )


SCORED_EVENTS = """SELECT event_id, event_type,
  CASE WHEN value > 50 THEN 1 ELSE 0 END AS y,
  least(0.999, value / 200 + ((event_id * 37) % 100) / 400.0) AS p,
  CASE WHEN event_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
  value, CAST(user_id AS DOUBLE) AS user_id, CAST((event_id * 37) % 100 AS DOUBLE) AS noise
FROM events"""


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, value = F.col("event_id"), F.col("value")
    noise = (key * 37) % 100
    return table(spark, sf_dir, "events").select(
        "event_id",
        "event_type",
        F.when(value > 50, 1).otherwise(0).alias("y"),
        F.least(F.lit(0.999), value / 200 + noise / F.lit(400.0)).alias("p"),
        F.when(key % 5 == 0, "test").otherwise("train").alias("split"),
        "value",
        F.col("user_id").cast("double").alias("user_id"),
        noise.cast("double").alias("noise"),
    )


SCORED_TIES = """SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y,
  round(l_discount * 5 + l_tax * 5, 2) AS p, l_linestatus AS model_id FROM lineitem"""


def scored_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"),
        F.round(F.col("l_discount") * 5 + F.col("l_tax") * 5, 2).alias("p"),
        F.col("l_linestatus").alias("model_id"),
    )
