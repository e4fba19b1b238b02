"""Ticks from the events table, and frames from tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.schema import floor_to_millis

BUYS = ("purchase", "view", "signup")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id (the event type), event_id, ts (milliseconds), price, qty, is_buy."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select(
        F.col("event_type").alias("series_id"),
        "event_id",
        floor_to_millis(F.col("ts")).cast("timestamp_ntz").alias("ts"),
        (F.col("value") + 1.0).alias("price"),
        (F.get_json_object("props", "$.k").cast("double") + 1.0).alias("qty"),
        F.col("event_type").isin(*BUYS).alias("is_buy"),
        "user_id",
    )


def save(df: DataFrame, path: str, *partition_by: str) -> None:
    """A sink: Parquet, by partition columns if given."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
