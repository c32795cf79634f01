"""Models and their deployment as an append-only table of events.

State is never updated in place: registering, deploying and undeploying append a row,
and the current state is an aggregate over the events of each model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = T.StructType(
    [
        T.StructField("model_id", T.StringType()),
        T.StructField("event_ts", T.TimestampType()),
        T.StructField("event", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("algorithm", T.StringType()),
        T.StructField("problem_type", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("metric", T.StringType()),
        T.StructField("model_path", T.StringType()),
    ]
)
# Fixed value: where a deployed model answers.
ENDPOINT = "/api/predictions/realtime/"


def append_event(spark: SparkSession, table_path: str, model_id: str, event: str, **info) -> None:
    """Add a ``register``, ``deploy`` or ``undeploy`` row."""
    names = [f.name for f in EVENTS]
    unknown = set(info) - set(names)
    if unknown:
        raise ValueError(f"unknown registry fields: {sorted(unknown)}")
    row = tuple({"model_id": model_id, "event": event, **info}.get(n) for n in names)
    spark.createDataFrame([row], EVENTS).withColumn(
        "event_ts", F.coalesce("event_ts", F.current_timestamp())
    ).write.mode("append").parquet(table_path)


def current_models(events: DataFrame, tie: str = "event") -> DataFrame:
    """One row per model: what was last registered, and whether it is deployed.

    Only the latest row per model and task is shuffled, so a model with very many events
    costs no more than another.
    """
    moment = F.struct("event_ts", tie)
    is_registration = F.col("event") == "register"
    is_switch = F.col("event").isin("deploy", "undeploy")
    fields = ["name", "algorithm", "problem_type", "score", "metric", "model_path"]
    known = [f for f in fields if f in events.columns]
    return (
        events.groupBy("model_id")
        .agg(
            *[
                F.max_by(f, F.when(is_registration, moment)).alias(f) for f in known
            ],
            F.min(F.when(is_registration, F.col("event_ts"))).alias("created_at"),
            F.coalesce(
                F.max_by(F.col("event") == "deploy", F.when(is_switch, moment)), F.lit(False)
            ).alias("is_deployed"),
        )
        .withColumn(
            "deployment_endpoint",
            F.when(F.col("is_deployed"), F.concat(F.lit(ENDPOINT), F.col("model_id").cast("string"))),
        )
    )


def list_models(events: DataFrame) -> DataFrame:
    """Current models with their number."""
    current = current_models(events)
    return current.crossJoin(current.agg(F.count(F.lit(1)).alias("total")))


def get_model(events: DataFrame, model_id: str) -> DataFrame:
    """The current row of one model; the filter reaches the scan."""
    found = current_models(events.filter(F.col("model_id") == model_id))
    if found.isEmpty():
        raise ValueError(f"model '{model_id}' not found")
    return found


def save_importance(importance: DataFrame, model_id: str, table_path: str) -> None:
    """Append a model's importances to the table they are looked up in."""
    importance.withColumn("model_id", F.lit(model_id)).write.mode("append").parquet(table_path)


def importance_of(table: DataFrame, model_id: str) -> DataFrame:
    return table.filter(F.col("model_id") == model_id).orderBy("rank")
