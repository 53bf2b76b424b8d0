"""Micro-batch jobs over append tables: what arrived since the last run is processed once and then the job ends.

Progress lives in the checkpoint folder; sinks are append-only tables keyed so that a replayed batch is harmless.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from clausewise.operators.monitoring import delivery_state


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """The fetch log as a stream; the schema comes from what is there, never from inference on new files."""
    schema = spark.read.parquet(folder).schema
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.select(F.col("event_id").alias("observation_id"), F.col("user_id").alias("source_id"), F.col("ts").cast("timestamp").alias("fetched_at"), F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("outcome"))


def hourly_outcomes(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """Attempts and errors per source and hour; rows later than ``late`` behind the newest are dropped."""
    by = stream.withWatermark("fetched_at", late).groupBy(F.window("fetched_at", "1 hour"), "source_id")
    return by.agg(F.count("*").alias("attempts"), F.count_if(F.col("outcome") == "error").alias("errors")).select(F.col("window.start").alias("hour"), "source_id", "attempts", "errors")


def run_once(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Drain what is there into a parquet table and stop."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()


def deliver(attempts: DataFrame, send: Callable[[DataFrame], None], checkpoint: str) -> StreamingQuery:
    """Hand the deliveries that are to be retried to ``send`` (a channel), batch by batch."""

    def batch(rows: DataFrame, _: int) -> None:
        send(delivery_state(rows).where("state = 'retry'"))

    return attempts.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
