"""Job history as a table of log events, one row per event."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabassay.functions.missing import quoted
from tabassay.functions.scalars import clamp_percent, elapsed_seconds, label_from_name
from tabassay.operators.prefix import order_position, running


def running_best(
    log: DataFrame, job: str, order: Sequence[str], score: str, **options: int
) -> DataFrame:
    """Best score so far after each event of a job.

    A job that wrote most of the log is cut into time chunks, so no task has to hold it.
    """
    return running(
        log,
        [job],
        [quoted(c) for c in order],
        order_position(log, order[0]),
        maxima={"best_so_far": quoted(score)},
        **options,
    )


def last_logs(log: DataFrame, job: str, order: Sequence[str], n: int = 50) -> DataFrame:
    """The newest ``n`` events per job, newest first.

    Each task keeps its own newest ``n`` per job before the shuffle.
    """
    w = Window.partitionBy(quoted(job)).orderBy(*[quoted(c).desc() for c in order])
    return log.withColumn("rnk", F.row_number().over(w)).filter(F.col("rnk") <= n)


def latest_state(
    log: DataFrame, job: str, order: Sequence[str], status: str, progress: str
) -> DataFrame:
    """Last status and clamped progress per job, with whole elapsed seconds."""
    moment = F.struct(*[quoted(c) for c in order])
    first, last = F.min(quoted(order[0])), F.max(quoted(order[0]))
    return log.groupBy(quoted(job)).agg(
        F.max_by(quoted(status), moment).alias("status"),
        clamp_percent(F.max_by(quoted(progress), moment)).cast("double").alias("progress"),
        first.alias("created_at"),
        last.alias("updated_at"),
        elapsed_seconds(first, last).alias("elapsed_seconds"),
        F.count(F.lit(1)).alias("events"),
    )


def phase_state(log: DataFrame) -> DataFrame:
    """Last status and message per job and phase, with a readable label."""
    phases = log.filter(F.col("phase").isNotNull())
    return phases.groupBy("job_id", "phase", label_from_name(F.col("phase")).alias("label")).agg(
        F.max_by("status", "event_ts").alias("status"),
        F.max_by("message", "event_ts").alias("message"),
    )


def job_list(state: DataFrame, job: str, **equals: str) -> DataFrame:
    """Jobs newest first, filtered by equality, say ``status="failed"``."""
    for column, value in equals.items():
        state = state.filter(quoted(column) == value)
    return state.orderBy(F.col("created_at").desc(), quoted(job))


LOG = (
    "job_id string, job_type string, event_ts timestamp, status string, progress double, "
    "phase string, algorithm string, score double, level string, message string"
)


class RunLog:
    """Appends the events of one job to a log table, a few rows per write."""

    def __init__(self, spark: SparkSession, path: str, job_id: str, job_type: str):
        self._spark, self._path, self._job = spark, path, (job_id, job_type)

    def add(self, status: str, **info: Any) -> None:
        """One event: ``progress``, ``phase``, ``algorithm``, ``score``, ``level``, ``message``."""
        schema = T.StructType.fromDDL(LOG)
        known = dict(zip(("job_id", "job_type"), self._job))
        row = {**known, "event_ts": datetime.now(), "status": status, "level": "INFO", **info}
        data = [tuple(row.get(f.name) for f in schema)]
        self._spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(
            self._path
        )
