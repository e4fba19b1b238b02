"""Daily trades from order lines: a series for each supplier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series_id (the supplier), event_id, ts, price a unit, qty, is_buy (not returned)."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return lines.select(
        F.col("l_suppkey").cast("string").alias("series_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"),
        F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        F.try_divide(F.col("l_extendedprice"), F.col("l_quantity")).alias("price"),
        F.col("l_quantity").alias("qty"),
        (F.col("l_returnflag") != "R").alias("is_buy"),
    )
