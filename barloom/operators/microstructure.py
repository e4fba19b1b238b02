"""Microstructure estimators of the first, second and third generation.

All frames of an operator share one sort.  A division by zero is NULL (not infinity).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.windows import by_series, full, last_rows
from barloom.schema import require_columns

_DEN, _K2 = 3 - 2 * math.sqrt(2), math.sqrt(8 / math.pi)


def _log_ratio(a: str, b: str) -> Column:
    return F.ln(F.try_divide(F.col(a), F.col(b)))


def roll_measure(df: DataFrame, window: int = 20, close: str = "close", out: str = "roll_measure") -> DataFrame:
    """2 sqrt |cov(dP_t, dP_(t-1))| over the window; first value at row window + 1."""
    require_columns(df, close)
    w = by_series()
    d, e = F.col("__d"), F.col("__e")
    frame = last_rows(w, window)
    value = F.when(F.count(F.when(e.isNotNull(), d)).over(frame) == window, 2 * F.sqrt(F.abs(F.covar_samp(d, e).over(frame))))
    work = df.withColumn("__d", F.col(close) - F.lag(close).over(w)).withColumn("__e", F.lag("__d").over(w))
    return work.withColumn(out, value).drop("__d", "__e")


def roll_impact(df: DataFrame, window: int = 20, close: str = "close", volume: str = "quote_asset_volume", out: str = "roll_impact") -> DataFrame:
    work = roll_measure(df, window, close, "__roll")
    return work.withColumn(out, F.try_divide(F.col("__roll"), F.col(volume))).drop("__roll")


def parkinson_volatility(df: DataFrame, window: int = 20, high: str = "high", low: str = "low", out: str = "parkinson") -> DataFrame:
    """Mean of ln(H / L)**2 / (4 ln 2): a variance, without root."""
    require_columns(df, high, low)
    r = _log_ratio(high, low)
    return df.withColumn(out, full(r * r / (4 * math.log(2)), F.avg, window, by_series()))


def beta(w: WindowSpec, window: int, high: str = "high", low: str = "low") -> tuple[Column, Column]:
    """Squared log range of two bars (needs a column of its own), and its mean as a function of that column."""
    r = _log_ratio(high, low)
    return r * r + F.lag(r * r).over(w), full(F.col("__two"), F.avg, window, w)


def gamma(w: WindowSpec, high: str = "high", low: str = "low") -> Column:
    top, bottom = F.lag(high).over(w), F.lag(low).over(w)
    r = F.ln(F.try_divide(F.greatest(F.col(high), top), F.least(F.col(low), bottom)))
    return F.when(top.isNotNull() & bottom.isNotNull(), r * r)


def alpha(b: Column, g: Column) -> Column:
    a = (math.sqrt(2) - 1) * F.sqrt(b) / _DEN - F.sqrt(g / _DEN)
    return F.when(a < 0, 0.0).otherwise(a)


def _range_columns(df: DataFrame, window: int, high: str, low: str) -> DataFrame:
    require_columns(df, high, low)
    w = by_series()
    two, mean = beta(w, window, high, low)
    return df.withColumn("__two", two).withColumn("__beta", mean).withColumn("__gamma", gamma(w, high, low))


def corwin_schultz_spread(df: DataFrame, window: int = 20, high: str = "high", low: str = "low", out: str = "corwin_schultz") -> DataFrame:
    """2 (e**a - 1) / (1 + e**a) from the ranges of one and of two bars."""
    work = _range_columns(df, window, high, low).withColumn("__alpha", alpha(F.col("__beta"), F.col("__gamma")))
    e = F.exp("__alpha")
    return work.withColumn(out, 2 * (e - 1) / (1 + e)).drop("__two", "__beta", "__gamma", "__alpha")


def beckers_parkinson_volatility(df: DataFrame, window: int = 20, high: str = "high", low: str = "low", out: str = "beckers_parkinson") -> DataFrame:
    work = _range_columns(df, window, high, low)
    s = (2**-0.5 - 1) * F.sqrt("__beta") / (_K2 * _DEN) + F.sqrt(F.col("__gamma") / (_K2 * _K2 * _DEN))
    return work.withColumn(out, F.when(s < 0, 0.0).otherwise(s)).drop("__two", "__beta", "__gamma")


def _lambda(df: DataFrame, move: Column, over: Column, window: int, out: str) -> DataFrame:
    work = df.withColumn("__step", F.try_divide(F.abs(move), over))
    return work.withColumn(out, full(F.col("__step"), F.avg, window, by_series())).drop("__step")


def kyle_lambda(df: DataFrame, window: int = 20, close: str = "close", volume: str = "base_asset_volume", out: str = "kyle_lambda") -> DataFrame:
    require_columns(df, close, volume)
    return _lambda(df, F.col(close) - F.lag(close).over(by_series()), F.col(volume), window, out)


def amihud_lambda(df: DataFrame, window: int = 20, close: str = "close", volume: str = "quote_asset_volume", out: str = "amihud_lambda") -> DataFrame:
    require_columns(df, close, volume)
    return _lambda(df, F.ln(close) - F.lag(F.ln(close)).over(by_series()), F.col(volume), window, out)


def hasbrouck_lambda(df: DataFrame, window: int = 20, close: str = "close", volume: str = "quote_asset_volume", out: str = "hasbrouck_lambda") -> DataFrame:
    require_columns(df, close, volume)
    return _lambda(df, F.ln(close) - F.lag(F.ln(close)).over(by_series()), F.sqrt(volume), window, out)


def vpin(df: DataFrame, window: int = 20, volume: str = "base_asset_volume", buy: str = "base_asset_buy_volume", sell: str = "base_asset_sell_volume", out: str = "vpin") -> DataFrame:
    """Imbalance over volume of the window; NULL becomes 0 from row ``window`` on (the first row is 0)."""
    require_columns(df, volume, buy, sell)
    w = by_series()
    value = F.try_divide(full(F.abs(F.col(buy) - F.col(sell)), F.sum, window, w), full(F.col(volume), F.sum, window, w))
    return df.withColumn(out, F.when(F.row_number().over(w) > window, F.coalesce(value, F.lit(0.0))).otherwise(value))
