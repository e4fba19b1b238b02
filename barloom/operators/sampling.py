"""Event sampling, concurrency of intervals, uniqueness and sample weights.

Intervals are never matched with bars one by one: counts come from running sums over starts and ends, and means over an
interval are differences of running sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import by_series
from barloom.schema import require_columns


def cusum_filter(df: DataFrame, threshold: float, column: str = "close") -> DataFrame:
    """(series_id, ts) of the events of a symmetric filter: both sums move on, only the one that fires starts anew."""
    require_columns(df, column)
    step = df.select("series_id", "ts", (F.col(column) - F.lag(column).over(by_series())).alias("d")).where("d is not null")
    rows = step.groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("ts", "d"))).alias("rows"))
    kind = "struct<p:double,n:double,e:array<timestamp_ntz>>"
    start = F.struct(F.lit(0.0).alias("p"), F.lit(0.0).alias("n"), F.array().cast("array<timestamp_ntz>").alias("e")).cast(kind)

    def moved(a, x):
        p, n = F.greatest(F.lit(0.0), a["p"] + x["d"]), F.least(F.lit(0.0), a["n"] + x["d"])
        down, up = n < -threshold, (n >= -threshold) & (p > threshold)
        events = F.when(down | up, F.array_append(a["e"], x["ts"])).otherwise(a["e"])
        return F.struct(F.when(up, 0.0).otherwise(p).alias("p"), F.when(down, 0.0).otherwise(n).alias("n"), events.alias("e")).cast(kind)

    return rows.select("series_id", F.explode(F.aggregate("rows", start, moved)["e"]).alias("ts"))


def closed(events: DataFrame) -> DataFrame:
    """The events; the job fails where one has no start or no end, or ends before it starts."""
    require_columns(events, "series_id", "start_ts", "end_ts")
    start, end = F.col("start_ts"), F.col("end_ts")
    bad = F.raise_error(F.lit("an event needs a start and an end that isn't before it"))
    fine = F.coalesce(start <= end, F.lit(False))
    return events.withColumns({"start_ts": F.when(fine, start).otherwise(bad.cast(dict(events.dtypes)["start_ts"])), "end_ts": F.when(fine, end).otherwise(bad.cast(dict(events.dtypes)["end_ts"]))})


def bar_index(events: DataFrame, bars: DataFrame) -> DataFrame:
    """(series_id, ts, starts, ends): all starts and ends, and the bars between the first start and the last end.

    An event without a start or an end is an error.
    """
    events = closed(events)
    marks = events.select("series_id", F.explode(F.array(F.struct(F.col("start_ts").alias("ts"), F.lit(1).alias("s"), F.lit(0).alias("e")), F.struct(F.col("end_ts").alias("ts"), F.lit(0).alias("s"), F.lit(1).alias("e")))).alias("m"))
    marks = marks.select("series_id", "m.ts", "m.s", "m.e")
    both = marks.unionByName(bars.select("series_id", "ts", F.lit(0).alias("s"), F.lit(0).alias("e")))
    grouped = both.groupBy("series_id", "ts").agg(F.sum("s").alias("starts"), F.sum("e").alias("ends"))
    whole = Window.partitionBy("series_id")
    first, last = F.min(F.when(F.col("starts") > 0, F.col("ts"))).over(whole), F.max(F.when(F.col("ends") > 0, F.col("ts"))).over(whole)
    return grouped.withColumn("__a", first).withColumn("__b", last).where("ts >= __a and ts <= __b").drop("__a", "__b")


def concurrency(events: DataFrame, bars: DataFrame) -> DataFrame:
    """(series_id, ts, pos, concurrency): events whose closed interval holds the bar."""
    w = by_series()
    up = F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0))
    down = F.coalesce(F.sum("ends").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return bar_index(events, bars).select("series_id", "ts", F.row_number().over(w).alias("pos"), (up - down).alias("concurrency"))


def _mean_between(events: DataFrame, sums: DataFrame, total: bool = False) -> DataFrame:
    """Events with ``value``: mean (or sum) of column x of ``sums`` (series_id, ts, pos, x) over the closed interval."""
    w = by_series()
    run = sums.withColumn("run", F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    a = run.select(F.col("series_id").alias("sa"), F.col("ts").alias("ta"), (F.col("run") - F.col("x")).alias("ra"), F.col("pos").alias("pa"))
    b = run.select(F.col("series_id").alias("sb"), F.col("ts").alias("tb"), F.col("run").alias("rb"), F.col("pos").alias("pb"))
    both = closed(events).join(a, (F.col("series_id") == F.col("sa")) & (F.col("start_ts") == F.col("ta"))).join(b, (F.col("series_id") == F.col("sb")) & (F.col("end_ts") == F.col("tb")))
    value = F.col("rb") - F.col("ra")
    return both.withColumn("value", value if total else value / (F.col("pb") - F.col("pa") + 1)).drop("sa", "ta", "ra", "pa", "sb", "tb", "rb", "pb")


def average_uniqueness(events: DataFrame, bars: DataFrame, out: str = "uniqueness") -> DataFrame:
    """Events with the mean over their bars of 1 / concurrency."""
    require_columns(events, "series_id", "start_ts", "end_ts")
    sums = concurrency(events, bars).withColumn("x", 1 / F.col("concurrency"))
    return _mean_between(events, sums).withColumnRenamed("value", out)


def conditional_uniqueness(events: DataFrame, drawn: DataFrame, bars: DataFrame, out: str = "uniqueness") -> DataFrame:
    """Each candidate's mean over its bars of 1 / (1 + drawn events there); ``drawn`` may repeat events."""
    w = by_series()
    index = bar_index(events, bars).select("series_id", "ts")
    marks = drawn.select("series_id", F.col("start_ts").alias("ts"), F.lit(1).alias("s"), F.lit(0).alias("e")).unionByName(drawn.select("series_id", F.col("end_ts").alias("ts"), F.lit(0).alias("s"), F.lit(1).alias("e")))
    marks = marks.unionByName(index.withColumn("s", F.lit(0)).withColumn("e", F.lit(0))).groupBy("series_id", "ts").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    k = F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.coalesce(F.sum("e").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = marks.select("series_id", "ts", F.row_number().over(w).alias("pos"), (1 / (1 + k)).alias("x"))
    return _mean_between(events, sums).withColumnRenamed("value", out)


def weights_by_returns(events: DataFrame, bars: DataFrame, close: str = "close", out: str = "weight") -> DataFrame:
    """Absolute sum over an event's bars of the log return over the concurrency."""
    require_columns(bars, "series_id", "ts", close)
    moves = bars.select("series_id", "ts", (F.ln(close) - F.lag(F.ln(close)).over(by_series())).alias("d"))
    sums = concurrency(events, bars).join(moves, ["series_id", "ts"], "left").withColumn("x", F.coalesce(F.col("d"), F.lit(0.0)) / F.col("concurrency"))
    return _mean_between(events, sums.drop("d"), total=True).withColumn(out, F.abs("value")).drop("value")


def weights_by_time_decay(events: DataFrame, bars: DataFrame, minimum_decay_weight: float, out: str = "weight") -> DataFrame:
    """Weights that fall linearly with accumulated uniqueness: the newest has 1, the oldest ``minimum``; below 0, the oldest
    share of events has 0."""
    c = minimum_decay_weight
    if c > 1:
        raise AssertionError("minimum_decay_weight must not exceed 1")
    w = Window.partitionBy("series_id").orderBy("start_ts")
    run = F.sum("__u").over(w.rowsBetween(Window.unboundedPreceding, 0))
    work = average_uniqueness(events, bars, "__u").withColumn("__c", run)
    last = F.sum("__u").over(Window.partitionBy("series_id"))
    slope = F.try_divide(F.lit(1.0 - c), last) if c >= 0 else F.try_divide(F.lit(1.0), (c + 1) * last)
    work = work.withColumn("__l", last).withColumn("__s", slope)
    value = 1 - F.col("__s") * F.col("__l") + F.col("__s") * F.col("__c")
    return work.withColumn(out, F.when(value < 0, 0.0).otherwise(value)).drop("__u", "__c", "__l", "__s")
