"""Structured Streaming forms of two batch operators; a stream that is read to its end gives the batch's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A stream over Parquet files of the events' shape."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).parquet(folder)


def hourly_totals(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Calls, failures and tokens of every hour and kind; rows later than ``late`` are dropped, and state with them."""
    failed = F.count_if(F.col("event_type") == "error")
    return (
        events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
        .agg(F.count("*").alias("calls"), failed.alias("failed"), F.sum(F.when(F.col("event_type") != "signup", F.col("value"))).alias("tokens"))
        .select(F.col("w.start").alias("hour"), "event_type", "calls", "failed", "tokens")
    )


def first_seen(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first row of each event id, for sources that deliver some twice."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
