"""Score rows as they arrive with the pipeline that batch scoring uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from tabassay.operators.modeling import FittedModel, predict


def start_scoring(
    arrivals: DataFrame,
    model: FittedModel,
    output: str,
    checkpoint: str,
    interval: str | None = None,
) -> StreamingQuery:
    """Append predictions for every arriving row to Parquet files.

    Scoring keeps no state between rows, so there is no watermark. The checkpoint folder
    and the file sink's commit log make each row's prediction appear once, also after a
    restart. Without ``interval`` the stream takes what is there and ends.
    """
    writer = (
        predict(model, arrivals)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .option("path", output)
    )
    if interval:
        return writer.trigger(processingTime=interval).start()
    return writer.trigger(availableNow=True).start()


def score_arrivals(
    spark: SparkSession,
    model: FittedModel,
    source: str,
    schema: T.StructType,
    output: str,
    checkpoint: str,
    files_per_batch: int | None = None,
) -> DataFrame:
    """Score all Parquet files now below ``source`` as a stream; gives the scored table."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = start_scoring(reader.parquet(source), model, output, checkpoint)
    query.awaitTermination()
    return spark.read.parquet(output)
