"""Event labels: volatility, barriers, trend scanning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import by_series, ewm
from barloom.schema import require_columns

DAY_MICROS = 86_400_000_000


def asof_before(value: str, micros: int, series: str = "series_id") -> Column:
    """The latest value strictly before ``micros`` ago; needs the column __us (epoch microseconds)."""
    w = Window.partitionBy(series).orderBy("__us").rangeBetween(Window.unboundedPreceding, -micros - 1)
    return F.max_by(value, "__us").over(w)


def daily_volatility(df: DataFrame, span: int = 100, close: str = "close", out: str = "daily_vol") -> DataFrame:
    """Exponentially weighted deviation of returns against the close of a day before."""
    require_columns(df, close)
    work = df.withColumn("__us", F.unix_micros(F.col("ts").cast("timestamp")))
    work = work.withColumn("__r", F.try_divide(F.col(close), asof_before(close, DAY_MICROS)) - 1)
    return ewm(work, out, "__r", span, std=True).drop("__us", "__r")


def barrier_hits(df: DataFrame, bars: int, profit_taking: float, stop_loss: float, close: str = "close", side: str = "__side", vol: str = "__vol") -> DataFrame:
    """Adds expiry, __stop and __profit: structs (ts, close) of the first bars beyond a horizontal barrier before the expiry.

    A factor of 0 or less disables its barrier; both negative raise.  Rows without an expiry are searched up to the last bar,
    which is left out.
    """
    if profit_taking < 0 and stop_loss < 0:
        raise ValueError("both factors are negative")
    w = by_series()
    ahead = F.collect_list(F.struct(F.col("ts"), F.col(close).alias("close"))).over(w.rowsBetween(0, bars - 1))
    work = df.withColumn("expiry", F.lead("ts", bars).over(w)).withColumn("__expiry_close", F.lead(close, bars).over(w)).withColumn("__ahead", ahead)
    path = F.when(F.col("expiry").isNotNull(), F.col("__ahead")).otherwise(F.slice("__ahead", F.lit(1), F.greatest(F.size("__ahead") - 1, F.lit(0))))
    work = work.withColumn("__path", path)
    gain = lambda u: (u["close"] / F.col(close) - 1) * F.col(side)
    none = F.lit(None).cast("struct<ts:timestamp_ntz,close:double>")
    stop = F.get(F.filter("__path", lambda u: gain(u) < -stop_loss * F.col(vol)), F.lit(0)) if stop_loss > 0 else none
    profit = F.get(F.filter("__path", lambda u: gain(u) > profit_taking * F.col(vol)), F.lit(0)) if profit_taking > 0 else none
    return work.withColumn("__stop", stop).withColumn("__profit", profit).drop("__ahead", "__path")


def triple_barrier(
    df: DataFrame, num_expiration_bars: int, profit_taking_factor: float, stop_loss_factor: float, metalabeling: bool = False, close: str = "close", side: str = "side",
    volatility_window: int = 100, volatility_adjusted: bool = True, expiration_label: bool = False,
) -> DataFrame:
    """Adds event_end_time, daily_vol, return and label: which of stop, profit and expiry comes first, and its sign.

    With metalabels the return is taken by side: 1 right, 0 wrong, NULL for none.  ``expiration_label``: 0 where neither
    horizontal barrier was reached.
    """
    require_columns(df, close, *([side] if metalabeling else []))
    work = daily_volatility(df, volatility_window, close)
    if not volatility_adjusted:
        work = work.withColumn("daily_vol", F.lit(1.0))
    work = work.withColumn("__side", F.col(side).cast("double") if side in df.columns else F.lit(1.0)).withColumn("__vol", F.col("daily_vol"))
    work = barrier_hits(work, num_expiration_bars, profit_taking_factor, stop_loss_factor, close)
    expiry = F.when(F.col("expiry").isNotNull(), F.struct(F.col("expiry").alias("ts"), F.col("__expiry_close").alias("close")))
    work = work.withColumn("__end", F.least(expiry, "__stop", "__profit"))
    known = F.col("daily_vol").isNotNull()
    ret = F.try_divide(F.col("__end.close"), F.col(close)) - 1
    ret = F.when(known, ret * F.col("__side") if metalabeling else ret)
    label = F.when(F.col("return") > 0, 1.0).when(F.col("return") < 0, 0.0) if metalabeling else F.signum("return")
    if expiration_label:
        label = F.when(F.col("return").isNotNull() & F.col("__stop").isNull() & F.col("__profit").isNull(), 0.0).otherwise(label)
    work = work.withColumn("event_end_time", F.when(known, F.col("__end.ts"))).withColumn("return", ret).withColumn("label", label)
    return work.drop("__side", "__vol", "__stop", "__profit", "__end", "__expiry_close", "expiry")


def trend_scanning(df: DataFrame, look_forward_window: int = 20, min_sample_length: int = 5, step: int = 1, close: str = "close", events: DataFrame | None = None) -> DataFrame:
    """Adds t_value, event_end_time, return and label of the look-forward length whose linear trend is the most significant.

    t comes from the correlation with time; a perfect line has no t, and its label is the trend's sign.  NULL where the
    longest window isn't full.  ``events``: only these (series_id, ts) rows are returned.
    """
    require_columns(df, close)
    w = by_series()
    work = df.withColumn("__n", F.row_number().over(w).cast("double"))
    tries = []
    for length in range(min_sample_length, look_forward_window, step):
        r = F.corr(F.col(close), F.col("__n")).over(w.rowsBetween(0, length - 1))
        tries.append(F.struct(F.nanvl(r, F.lit(None).cast("double")).alias("r"), F.lit(length).alias("n"), F.lead("ts", length - 1).over(w).alias("ts"), F.lead(close, length - 1).over(w).alias("close")))
    enough = F.count(F.lit(1)).over(w.rowsBetween(0, look_forward_window - 1)) == look_forward_window
    work = work.withColumn("__tries", F.array(*tries)).withColumn("__enough", enough)

    def judged(x: Column) -> Column:
        rest = 1 - x["r"] * x["r"]
        t = F.when(rest > 1e-12, x["r"] * F.sqrt(F.try_divide((x["n"] - 2).cast("double"), rest)))
        return F.struct(F.coalesce(F.abs(t), F.lit(-1.0)).alias("a"), (-x["n"]).alias("m"), t.alias("t"), x["ts"].alias("ts"), x["close"].alias("close"), x["r"].alias("r"))

    work = work.withColumn("__best", F.when(F.col("__enough"), F.array_max(F.transform("__tries", judged))))
    t = F.col("__best.t")
    out = work.withColumns({
        "t_value": t, "event_end_time": F.col("__best.ts"), "return": F.try_divide(F.col("__best.close"), F.col(close)) - 1,
        "label": F.signum(F.coalesce(t, F.col("__best.r"))),
    }).drop("__n", "__tries", "__enough", "__best")
    return out if events is None else out.join(events.select("series_id", "ts").distinct(), ["series_id", "ts"], "left_semi")
