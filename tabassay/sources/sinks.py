"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_scored(scored: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Scored rows as Parquet, written by all tasks."""
    scored.write.mode(mode).parquet(path)


def write_leaderboard(leaderboard: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The comparison of a handful of algorithms as one CSV file with a header."""
    leaderboard.orderBy("rank").coalesce(1).write.mode(mode).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", True).csv(path)
