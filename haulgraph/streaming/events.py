"""Telemetry as a stream. The reference reads its log in batch; this is an addition of ours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)


def summary(events: DataFrame) -> DataFrame:
    """Counts and the largest value of each type in windows of an hour, up to a day late."""
    hours = events.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour"), F.col("event_type").alias("phase"))
    return hours.agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most")).select(F.col("window.start").alias("begins"), "phase", "n", "most")
