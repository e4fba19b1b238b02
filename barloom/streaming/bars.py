"""Streaming forms: time bars with late data, and filters and averages whose state is a few numbers a series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def streaming_time_bars(ticks: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Time bars of a tick stream; ticks later than ``lateness`` are dropped and state is kept no longer."""
    order, money = F.struct("ts", "event_id"), F.col("price") * F.col("qty")
    timed = ticks.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    bars = timed.groupBy("series_id", F.window("ts", width).alias("w")).agg(
        F.max("ts").alias("ts"), F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
        F.max_by("price", order).alias("close"), F.sum("qty").alias("base_asset_volume"), F.sum(money).alias("quote_asset_volume"), F.count(F.lit(1)).alias("num_ticks"),
    )
    return bars.select("series_id", F.col("w.start").alias("bar_start"), *[c for c in bars.columns if c not in ("series_id", "w")])


def streaming_cusum(rows: DataFrame, threshold: float, column: str = "close") -> DataFrame:
    """(series_id, ts) of filter events; rows of a series must arrive in order from batch to batch."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        up, down, last = state.get if state.exists else (0.0, 0.0, float("nan"))
        found = []
        for ts, y in pd.concat(list(frames)).sort_values("ts")[["ts", column]].itertuples(index=False):
            if last == last:
                up, down = max(0.0, up + y - last), min(0.0, down + y - last)
                if down < -threshold:
                    down = 0.0
                    found.append(ts)
                elif up > threshold:
                    up = 0.0
                    found.append(ts)
            last = y
        state.update((up, down, last))
        yield pd.DataFrame({"series_id": [key[0]] * len(found), "ts": found})

    rows = rows.select("series_id", F.col("ts").cast("timestamp").alias("ts"), F.col(column).cast("double").alias(column))
    return rows.groupBy("series_id").applyInPandasWithState(run, "series_id string, ts timestamp", "up double, down double, last double", "append", GroupStateTimeout.NoTimeout)


def streaming_ema(rows: DataFrame, n: int, column: str = "close") -> DataFrame:
    """(series_id, ts, ema): a moving average seeded with the mean of the first n values."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, total, value = state.get if state.exists else (0, 0.0, float("nan"))
        out = []
        for ts, y in pd.concat(list(frames)).sort_values("ts")[["ts", column]].itertuples(index=False):
            seen += 1
            if seen <= n:
                total += y
                value = total / n if seen == n else value
            else:
                value += (y - value) * 2 / (n + 1)
            out.append((key[0], ts, value if seen >= n else None))
        state.update((seen, total, value))
        yield pd.DataFrame(out, columns=["series_id", "ts", "ema"])

    rows = rows.select("series_id", F.col("ts").cast("timestamp").alias("ts"), F.col(column).cast("double").alias(column))
    return rows.groupBy("series_id").applyInPandasWithState(run, "series_id string, ts timestamp, ema double", "seen long, total double, value double", "append", GroupStateTimeout.NoTimeout)
