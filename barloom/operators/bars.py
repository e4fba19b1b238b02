"""Bars from ticks: by time, or by ticks, volume or money passed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import totals_before
from barloom.schema import require_columns


def _bars(ticks: DataFrame, *keys: Column) -> DataFrame:
    order, buy = F.struct("ts", "event_id"), F.col("is_buy")
    money = F.col("price") * F.col("qty")
    grouped = ticks.groupBy("series_id", *keys)
    return grouped.agg(
        F.max("ts").alias("ts"),
        F.min(F.unix_millis(F.col("ts").cast("timestamp"))).alias("first_timestamp"),
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("qty").alias("base_asset_volume"),
        F.sum(F.when(buy, F.col("qty")).otherwise(0.0)).alias("base_asset_buy_volume"), F.sum(F.when(~buy, F.col("qty")).otherwise(0.0)).alias("base_asset_sell_volume"),
        F.sum(money).alias("quote_asset_volume"),
        F.sum(F.when(buy, money).otherwise(0.0)).alias("quote_asset_buy_volume"), F.sum(F.when(~buy, money).otherwise(0.0)).alias("quote_asset_sell_volume"),
        F.count(F.lit(1)).alias("num_ticks"), F.sum(buy.cast("long")).alias("num_buy_ticks"),
    )


def time_bars(ticks: DataFrame, unit: str = "hour") -> DataFrame:
    """A bar per calendar unit with ticks; ts is the last tick's time. Partial sums meet in one shuffle."""
    require_columns(ticks, "series_id", "ts", "event_id", "price", "qty", "is_buy")
    return _bars(ticks, F.date_trunc(unit, "ts").alias("__unit")).drop("__unit")


def dynamic_bars(ticks: DataFrame, kind: str, threshold: float) -> DataFrame:
    """A bar whenever ``threshold`` more ticks ("tick"), units ("volume") or money ("dollar") have passed.

    The running total before a tick decides its bar.  Ticks are counted by day first, so that only a day's ticks are
    ordered in one task however long a series is.  Totals are added in the order that SQL's windows take
    (``totals_before``): one that meets a bar's limit to the cent may else lie on either side of it.
    """
    amount = {"tick": F.lit(1.0), "volume": F.col("qty"), "dollar": F.col("price") * F.col("qty")}
    if kind not in amount:
        raise ValueError(f"kind must be one of {sorted(amount)}")
    days = ticks.withColumn("__day", F.to_date("ts")).withColumn("__amount", amount[kind].cast("double"))
    counts = days.groupBy("series_id", "__day").agg(F.count(F.lit(1)).alias("__count"))
    before = F.coalesce(F.sum("__count").over(Window.partitionBy("series_id").orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("series_id", "__day", before.alias("__before"))
    at = F.col("__before") + F.row_number().over(Window.partitionBy("series_id", "__day").orderBy("ts", "event_id")) - 1
    placed = days.join(counts, ["series_id", "__day"]).withColumn("__at", at)
    placed = placed.withColumn("__passed", F.col("__at").cast("double")) if kind == "tick" else totals_before(placed, "__passed", "__amount", "__at")
    return _bars(placed.withColumn("__bar", F.floor(F.col("__passed") / threshold)), F.col("__bar")).withColumnRenamed("__bar", "bar_id")
