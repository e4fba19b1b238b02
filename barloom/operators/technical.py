"""Crossovers, imbalance and rule strategies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import indicators
from barloom.functions.windows import by_series, diff, ewm, full, last_rows
from barloom.schema import require_columns


def moving_average_crossover(df: DataFrame, fast: int, slow: int, column: str = "close", fill_between_crossovers: bool = False, out: str = "crossover") -> DataFrame:
    """1 where the fast mean crosses above the slow one, -1 below, else 0; filled: the last crossing."""
    if fast > slow:
        raise ValueError("fast must not exceed slow")
    require_columns(df, column)
    w = by_series()
    work = df.withColumn("__f", full(F.col(column), F.avg, fast, w)).withColumn("__s", full(F.col(column), F.avg, slow, w))
    return crossover(work, "__f", "__s", fill_between_crossovers, out).drop("__f", "__s")


def crossover(df: DataFrame, fast: str, slow: str, fill: bool = False, out: str = "crossover") -> DataFrame:
    """The same for two columns that are there already."""
    w = by_series()
    f, s, f1, s1 = F.col(fast), F.col(slow), F.lag(fast).over(w), F.lag(slow).over(w)
    value = F.when((f1 <= s1) & (f > s), 1).when((f1 >= s1) & (f < s), -1).otherwise(0)
    if not fill:
        return df.withColumn(out, value)
    work = df.withColumn("__x", F.nullif(value, F.lit(0)))
    return work.withColumn(out, F.coalesce(F.last("__x", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))).drop("__x")


def predict_proba(df: DataFrame, prediction: str, classes: tuple[int, ...] = (-1, 0, 1), out: str = "proba") -> DataFrame:
    """One column per class: 1.0 for the predicted one. Names: {out}_0, {out}_1, ..."""
    return df.withColumns({f"{out}_{k}": (F.col(prediction) == c).cast("double") for k, c in enumerate(classes)})


def ewm_difference(df: DataFrame, fast: int, slow: int, column: str = "close", normalised: bool = True, out: str = "ewm_difference") -> DataFrame:
    """(F - S) / (F + 1), or F - S."""
    if fast > slow:
        raise ValueError("fast must not exceed slow")
    require_columns(df, column)
    work = ewm(ewm(df, "__f", column, fast), "__s", column, slow)
    d = F.col("__f") - F.col("__s")
    return work.withColumn(out, F.try_divide(d, F.col("__f") + 1) if normalised else d).drop("__f", "__s")


def macd_histogram_crossover(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, column: str = "close", out: str = "macd_crossover") -> DataFrame:
    """Half the change of the histogram's sign: -1, -0.5, 0, 0.5, 1."""
    if fast > slow:
        raise ValueError("fast must not exceed slow")
    work = indicators.macd(df, column, fast, slow, signal, "__m").withColumn("__g", F.signum("__m_hist"))
    return work.withColumn(out, diff(F.col("__g"), by_series()) / 2).drop("__m", "__m_signal", "__m_hist", "__g")


def buy_sell_imbalance(df: DataFrame, fast: int, slow: int, volume_type: str = "quote", out: str = "imbalance") -> DataFrame:
    if volume_type not in ("quote", "base"):
        raise ValueError("volume_type must be quote or base")
    buy, sell, volume = (f"{volume_type}_asset_{x}volume" for x in ("buy_", "sell_", ""))
    require_columns(df, buy, sell, volume)
    # weighted means are linear: the difference of two means is the mean of the difference
    work = df.withColumn("__i", F.col(buy) - F.col(sell))
    work = ewm(ewm(work, "__f", "__i", fast), "__s", "__i", slow)
    return work.withColumn(out, F.try_divide(F.col("__f") - F.col("__s"), F.col(volume) + 1)).drop("__i", "__f", "__s")


def mean_reversion(df: DataFrame, threshold: float, short_time_period: int, column: str = "close", out: str = "side") -> DataFrame:
    """Sell far above the moving average, buy far below it, else nothing."""
    work = indicators.ema(df, column, short_time_period, "__e")
    z = F.try_divide(F.col(column) - F.col("__e"), F.col("__e"))
    return work.withColumn(out, F.when(z > threshold, -1).when(z < -threshold, 1).otherwise(0)).drop("__e")


def _nanos() -> Column:
    return (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).cast("double")


def bar_arrival_rsi(
    df: DataFrame, rsi_timeperiod: int, rsi_low: float, rsi_high: float, arrival_fast: int, arrival_slow: int, max_diff: float, low_boundary: float, high_boundary: float,
    column: str = "close", out: str = "side",
) -> DataFrame:
    """Long where the strength index and the scaled change of the bars' pace (nanoseconds) lie within their bounds."""
    w = by_series()
    work = indicators.rsi(df, column, rsi_timeperiod, "__r").withColumn("__t", diff(_nanos(), w))
    pace = (full(F.col("__t"), F.avg, arrival_fast, w) - full(F.col("__t"), F.avg, arrival_slow, w)) / max_diff
    work = work.withColumn("__p", pace)
    long = (F.col("__r") > rsi_low) & (F.col("__r") < rsi_high) & (F.col("__p") > low_boundary) & (F.col("__p") < high_boundary)
    return work.withColumn(out, F.when(long, 1).otherwise(0)).drop("__r", "__t", "__p")


def rsi_confirmation(df: DataFrame, rsi_timeperiod: int, rsi_threshold: float, rsi_confirmation_period: int, rsi_moving_average_window: int, column: str = "close", out: str = "side") -> DataFrame:
    """Long where the strength index stayed below the threshold for k bars and its moving average rises."""
    w = by_series()
    work = indicators.rsi(df, column, rsi_timeperiod, "__r").withColumn("__b", F.when(F.col("__r") < rsi_threshold, 1).otherwise(0))
    work = work.withColumn("__m", full(F.col("__r"), F.avg, rsi_moving_average_window, w)).withColumn("__d", diff(F.col("__m"), w))
    frame = last_rows(w, rsi_confirmation_period)
    below = (F.min("__b").over(frame) == 1) & (F.count(F.lit(1)).over(frame) == rsi_confirmation_period)
    return work.withColumn(out, F.when(below & (F.col("__d") > 0), 1).otherwise(0)).drop("__r", "__b", "__m", "__d")
