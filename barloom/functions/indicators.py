"""The indicator registry: names, groups, argument shapes, and transformers made from them.

Formulas are the published definitions; averages with a recurrence start from the plain mean of their first values.
Every indicator is ``f(df, *columns, **parameters) -> df`` and adds the columns that it names.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import by_series, full, last_rows, seeded_ema
from barloom.schema import fresh

Indicator = Callable[..., DataFrame]
_REGISTRY: dict[str, tuple[str, Indicator]] = {}


def indicator(group: str) -> Callable[[Indicator], Indicator]:
    def add(f: Indicator) -> Indicator:
        _REGISTRY[f.__name__.upper()] = (group, f)
        return f

    return add


def _w():
    return by_series()


# Overlap studies


@indicator("Overlap Studies")
def sma(df: DataFrame, real: str, timeperiod: int = 30, out: str = "sma") -> DataFrame:
    return df.withColumn(out, full(F.col(real), F.avg, timeperiod, _w()))


@indicator("Overlap Studies")
def ema(df: DataFrame, real: str, timeperiod: int = 30, out: str = "ema") -> DataFrame:
    return seeded_ema(df, out, F.col(real), timeperiod)


@indicator("Overlap Studies")
def dema(df: DataFrame, real: str, timeperiod: int = 30, out: str = "dema") -> DataFrame:
    work = seeded_ema(seeded_ema(df, "__e1", F.col(real), timeperiod), "__e2", F.col("__e1"), timeperiod)
    return work.withColumn(out, 2 * F.col("__e1") - F.col("__e2")).drop("__e1", "__e2")


@indicator("Overlap Studies")
def t3(df: DataFrame, real: str, timeperiod: int = 5, vfactor: float = 0.7, out: str = "t3") -> DataFrame:
    """The generalised double average, three times over, as a weighted sum of the third to sixth nested averages."""
    v, names = vfactor, fresh(df, *(f"__t{k}" for k in range(1, 7)))
    work, source = df, real
    for name in names:
        work, source = seeded_ema(work, name, F.col(source), timeperiod), name
    e3, e4, e5, e6 = (F.col(n) for n in names[2:])
    value = (1 + v) ** 3 * e3 - 3 * v * (1 + v) ** 2 * e4 + 3 * v**2 * (1 + v) * e5 - v**3 * e6
    return work.withColumn(out, value).drop(*names)


@indicator("Overlap Studies")
def tema(df: DataFrame, real: str, timeperiod: int = 30, out: str = "tema") -> DataFrame:
    work = df
    for k, source in ((1, real), (2, "__e1"), (3, "__e2")):
        work = seeded_ema(work, f"__e{k}", F.col(source), timeperiod)
    return work.withColumn(out, 3 * F.col("__e1") - 3 * F.col("__e2") + F.col("__e3")).drop("__e1", "__e2", "__e3")


@indicator("Overlap Studies")
def wma(df: DataFrame, real: str, timeperiod: int = 30, out: str = "wma") -> DataFrame:
    """Weights 1 .. n, the last value's the largest."""
    w = _w()
    total = sum((F.lag(real, k).over(w) * (timeperiod - k) for k in range(timeperiod)), F.lit(0.0))
    return df.withColumn(out, F.when(F.count(real).over(last_rows(w, timeperiod)) == timeperiod, total / (timeperiod * (timeperiod + 1) / 2)))


@indicator("Overlap Studies")
def trima(df: DataFrame, real: str, timeperiod: int = 30, out: str = "trima") -> DataFrame:
    a, b = (timeperiod + 2) // 2, (timeperiod + 1) // 2
    work = df.withColumn("__t", full(F.col(real), F.avg, a, _w()))
    return work.withColumn(out, full(F.col("__t"), F.avg, b, _w())).drop("__t")


@indicator("Overlap Studies")
def bbands(df: DataFrame, real: str, timeperiod: int = 5, nbdevup: float = 2.0, nbdevdn: float = 2.0, out: str = "bbands") -> DataFrame:
    mid, dev = full(F.col(real), F.avg, timeperiod, _w()), full(F.col(real), F.stddev_pop, timeperiod, _w())
    return df.withColumns({f"{out}_upper": mid + nbdevup * dev, f"{out}_middle": mid, f"{out}_lower": mid - nbdevdn * dev})


@indicator("Overlap Studies")
def midpoint(df: DataFrame, real: str, timeperiod: int = 14, out: str = "midpoint") -> DataFrame:
    return df.withColumn(out, (full(F.col(real), F.max, timeperiod, _w()) + full(F.col(real), F.min, timeperiod, _w())) / 2)


@indicator("Overlap Studies")
def midprice(df: DataFrame, high: str = "high", low: str = "low", timeperiod: int = 14, out: str = "midprice") -> DataFrame:
    return df.withColumn(out, (full(F.col(high), F.max, timeperiod, _w()) + full(F.col(low), F.min, timeperiod, _w())) / 2)


@indicator("Overlap Studies")
def mavp(df: DataFrame, real: str, periods: str, minperiod: int = 2, maxperiod: int = 30, out: str = "mavp") -> DataFrame:
    """A plain mean whose window is each row's own ``periods``, kept within the bounds; first value at row maxperiod."""
    w = _w()
    n = F.least(F.greatest(F.col(periods), F.lit(minperiod)), F.lit(maxperiod)).cast("int")
    arr = F.collect_list(F.col(real)).over(last_rows(w, maxperiod))
    tail = F.slice(F.col("__arr"), F.size("__arr") - n + 1, n)
    value = F.aggregate(tail, F.lit(0.0), lambda a, x: a + x) / n
    work = df.withColumn("__arr", arr)
    return work.withColumn(out, F.when(F.size("__arr") == maxperiod, value)).drop("__arr")


# Momentum


@indicator("Momentum Indicators")
def mom(df: DataFrame, real: str, timeperiod: int = 10, out: str = "mom") -> DataFrame:
    return df.withColumn(out, F.col(real) - F.lag(real, timeperiod).over(_w()))


@indicator("Momentum Indicators")
def roc(df: DataFrame, real: str, timeperiod: int = 10, out: str = "roc") -> DataFrame:
    return df.withColumn(out, 100 * (F.try_divide(F.col(real), F.lag(real, timeperiod).over(_w())) - 1))


@indicator("Momentum Indicators")
def rocp(df: DataFrame, real: str, timeperiod: int = 10, out: str = "rocp") -> DataFrame:
    return df.withColumn(out, F.try_divide(F.col(real), F.lag(real, timeperiod).over(_w())) - 1)


@indicator("Momentum Indicators")
def rsi(df: DataFrame, real: str, timeperiod: int = 14, out: str = "rsi") -> DataFrame:
    """100 gain / (gain + loss), both smoothed with 1 / n from the mean of their first n; 0 where nothing moved."""
    d = F.col("__d")
    work = df.withColumn("__d", F.col(real) - F.lag(real).over(_w()))
    work = seeded_ema(work, "__g", F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), timeperiod, 1 / timeperiod)
    work = seeded_ema(work, "__l", F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))), timeperiod, 1 / timeperiod)
    total = F.col("__g") + F.col("__l")
    return work.withColumn(out, F.when(total.isNotNull(), F.coalesce(F.try_divide(100 * F.col("__g"), total), F.lit(0.0)))).drop("__d", "__g", "__l")


@indicator("Momentum Indicators")
def cmo(df: DataFrame, real: str, timeperiod: int = 14, out: str = "cmo") -> DataFrame:
    work = rsi(df, real, timeperiod, "__r")
    return work.withColumn(out, 2 * F.col("__r") - 100).drop("__r")


@indicator("Momentum Indicators")
def macd(df: DataFrame, real: str, fastperiod: int = 12, slowperiod: int = 26, signalperiod: int = 9, out: str = "macd") -> DataFrame:
    """macd, macd_signal, macd_hist; all NULL until the signal has a value."""
    work = seeded_ema(seeded_ema(df, "__f", F.col(real), fastperiod), "__s", F.col(real), slowperiod).withColumn("__m", F.col("__f") - F.col("__s"))
    work = seeded_ema(work, f"{out}_signal", F.col("__m"), signalperiod)
    there = F.col(f"{out}_signal").isNotNull()
    work = work.withColumn(out, F.when(there, F.col("__m"))).withColumn(f"{out}_hist", F.col("__m") - F.col(f"{out}_signal"))
    return work.drop("__f", "__s", "__m")


@indicator("Momentum Indicators")
def apo(df: DataFrame, real: str, fastperiod: int = 12, slowperiod: int = 26, out: str = "apo") -> DataFrame:
    return df.withColumn(out, full(F.col(real), F.avg, fastperiod, _w()) - full(F.col(real), F.avg, slowperiod, _w()))


@indicator("Momentum Indicators")
def ppo(df: DataFrame, real: str, fastperiod: int = 12, slowperiod: int = 26, out: str = "ppo") -> DataFrame:
    slow = full(F.col(real), F.avg, slowperiod, _w())
    return df.withColumn(out, 100 * F.try_divide(full(F.col(real), F.avg, fastperiod, _w()) - slow, slow))


@indicator("Momentum Indicators")
def trix(df: DataFrame, real: str, timeperiod: int = 30, out: str = "trix") -> DataFrame:
    work = df
    for k, source in ((1, real), (2, "__e1"), (3, "__e2")):
        work = seeded_ema(work, f"__e{k}", F.col(source), timeperiod)
    before = F.lag("__e3").over(_w())
    return work.withColumn(out, 100 * F.try_divide(F.col("__e3") - before, before)).drop("__e1", "__e2", "__e3")


@indicator("Momentum Indicators")
def willr(df: DataFrame, high: str = "high", low: str = "low", close: str = "close", timeperiod: int = 14, out: str = "willr") -> DataFrame:
    top, bottom = full(F.col(high), F.max, timeperiod, _w()), full(F.col(low), F.min, timeperiod, _w())
    return df.withColumn(out, -100 * F.try_divide(top - F.col(close), top - bottom))


@indicator("Momentum Indicators")
def stochf(df: DataFrame, high: str = "high", low: str = "low", close: str = "close", fastk_period: int = 5, fastd_period: int = 3, out: str = "stochf") -> DataFrame:
    top, bottom = full(F.col(high), F.max, fastk_period, _w()), full(F.col(low), F.min, fastk_period, _w())
    work = df.withColumn(f"{out}_k", 100 * F.try_divide(F.col(close) - bottom, top - bottom))
    return work.withColumn(f"{out}_d", full(F.col(f"{out}_k"), F.avg, fastd_period, _w()))


@indicator("Momentum Indicators")
def cci(df: DataFrame, high: str = "high", low: str = "low", close: str = "close", timeperiod: int = 14, out: str = "cci") -> DataFrame:
    price = (F.col(high) + F.col(low) + F.col(close)) / 3
    work = df.withColumn("__p", price).withColumn("__a", F.collect_list("__p").over(last_rows(_w(), timeperiod))).withColumn("__m", full(F.col("__p"), F.avg, timeperiod, _w()))
    dev = F.aggregate(F.transform("__a", lambda x: F.abs(x - F.col("__m"))), F.lit(0.0), lambda a, x: a + x) / timeperiod
    return work.withColumn(out, F.try_divide(F.col("__p") - F.col("__m"), 0.015 * dev)).drop("__p", "__a", "__m")


@indicator("Momentum Indicators")
def aroon(df: DataFrame, high: str = "high", low: str = "low", timeperiod: int = 14, out: str = "aroon") -> DataFrame:
    """How recent the extremes of the last n + 1 bars are, in percent; the latest of equal ones counts."""
    w, frame = _w(), last_rows(_w(), timeperiod + 1)
    work = df.withColumn("__n", F.row_number().over(w))
    age = lambda c, sign: F.col("__n") - F.max_by("__n", F.struct(sign * F.col(c), F.col("__n"))).over(frame)
    ready = F.col("__n") > timeperiod
    up, down = (F.when(ready, 100 * (timeperiod - age(c, s)) / timeperiod) for c, s in ((high, 1), (low, -1)))
    return work.withColumns({f"{out}_up": up, f"{out}_down": down}).drop("__n")


@indicator("Momentum Indicators")
def mfi(df: DataFrame, high: str = "high", low: str = "low", close: str = "close", volume: str = "base_asset_volume", timeperiod: int = 14, out: str = "mfi") -> DataFrame:
    w = _w()
    work = df.withColumn("__p", (F.col(high) + F.col(low) + F.col(close)) / 3).withColumn("__q", F.lag("__p").over(w))
    flow = F.col("__p") * F.col(volume)
    there = F.col("__q").isNotNull()
    work = work.withColumn("__u", F.when(there, F.when(F.col("__p") > F.col("__q"), flow).otherwise(0.0))).withColumn("__v", F.when(there, F.when(F.col("__p") < F.col("__q"), flow).otherwise(0.0)))
    up, down = full(F.col("__u"), F.sum, timeperiod, w), full(F.col("__v"), F.sum, timeperiod, w)
    return work.withColumn(out, 100 * F.try_divide(up, up + down)).drop("__p", "__q", "__u", "__v")


@indicator("Momentum Indicators")
def bop(df: DataFrame, open: str = "open", high: str = "high", low: str = "low", close: str = "close", out: str = "bop") -> DataFrame:
    return df.withColumn(out, F.coalesce(F.try_divide(F.col(close) - F.col(open), F.col(high) - F.col(low)), F.lit(0.0)))


def _true_range(high: str, low: str, close: str) -> Column:
    before = F.lag(close).over(_w())
    return F.when(before.isNotNull(), F.greatest(F.col(high), before) - F.least(F.col(low), before))


def _moves(df: DataFrame, high: str, low: str) -> DataFrame:
    up, down = F.col(high) - F.lag(high).over(_w()), F.lag(low).over(_w()) - F.col(low)
    work = df.withColumn("__up", up).withColumn("__down", down)
    plus = F.when((F.col("__up") > F.col("__down")) & (F.col("__up") > 0), F.col("__up")).when(F.col("__up").isNotNull(), 0.0)
    minus = F.when((F.col("__down") > F.col("__up")) & (F.col("__down") > 0), F.col("__down")).when(F.col("__up").isNotNull(), 0.0)
    return work.withColumn("__plus", plus).withColumn("__minus", minus).drop("__up", "__down")


@indicator("Momentum Indicators")
def dx(df: DataFrame, high: str = "high", low: str = "low", close: str = "close", timeperiod: int = 14, out: str = "dx") -> DataFrame:
    """Directional indicators (smoothed with 1 / n) and their index: {out}_plus, {out}_minus, {out}."""
    work = _moves(df, high, low).withColumn("__tr", _true_range(high, low, close))
    for name in ("__plus", "__minus", "__tr"):
        work = seeded_ema(work, f"{name}s", F.col(name), timeperiod, 1 / timeperiod)
    p, m = (100 * F.try_divide(F.col(f"{n}s"), F.col("__trs")) for n in ("__plus", "__minus"))
    work = work.withColumn(f"{out}_plus", p).withColumn(f"{out}_minus", m)
    p, m = F.col(f"{out}_plus"), F.col(f"{out}_minus")
    return work.withColumn(out, F.when(p.isNotNull(), F.coalesce(100 * F.try_divide(F.abs(p - m), p + m), F.lit(0.0)))).drop("__plus", "__minus", "__tr", "__pluss", "__minuss", "__trs")


@indicator("Momentum Indicators")
def adx(df: DataFrame, high: str = "high", low: str = "low", close: str = "close", timeperiod: int = 14, out: str = "adx") -> DataFrame:
    work = dx(df, high, low, close, timeperiod, "__dx")
    return seeded_ema(work, out, F.col("__dx"), timeperiod, 1 / timeperiod).drop("__dx", "__dx_plus", "__dx_minus")


@indicator("Momentum Indicators")
def adxr(df: DataFrame, high: str = "high", low: str = "low", close: str = "close", timeperiod: int = 14, out: str = "adxr") -> DataFrame:
    """The mean of the index of now and of n - 1 bars ago."""
    (a,) = fresh(df, "__adx")
    work = adx(df, high, low, close, timeperiod, a)
    return work.withColumn(out, (F.col(a) + F.lag(a, timeperiod - 1).over(_w())) / 2).drop(a)


@indicator("Momentum Indicators")
def plus_di(df: DataFrame, high: str = "high", low: str = "low", close: str = "close", timeperiod: int = 14, out: str = "plus_di") -> DataFrame:
    (d,) = fresh(df, "__di")
    return dx(df, high, low, close, timeperiod, d).withColumn(out, F.col(f"{d}_plus")).drop(d, f"{d}_plus", f"{d}_minus")


@indicator("Momentum Indicators")
def minus_di(df: DataFrame, high: str = "high", low: str = "low", close: str = "close", timeperiod: int = 14, out: str = "minus_di") -> DataFrame:
    (d,) = fresh(df, "__di")
    return dx(df, high, low, close, timeperiod, d).withColumn(out, F.col(f"{d}_minus")).drop(d, f"{d}_plus", f"{d}_minus")


def _directed(df: DataFrame, high: str, low: str, n: int, move: str, out: str) -> DataFrame:
    """n times the smoothed mean of the moves in one direction."""
    work = seeded_ema(_moves(df, high, low), out, F.col(move), n, 1 / n)
    return work.withColumn(out, n * F.col(out)).drop("__plus", "__minus")


@indicator("Momentum Indicators")
def plus_dm(df: DataFrame, high: str = "high", low: str = "low", timeperiod: int = 14, out: str = "plus_dm") -> DataFrame:
    return _directed(df, high, low, timeperiod, "__plus", out)


@indicator("Momentum Indicators")
def minus_dm(df: DataFrame, high: str = "high", low: str = "low", timeperiod: int = 14, out: str = "minus_dm") -> DataFrame:
    return _directed(df, high, low, timeperiod, "__minus", out)


@indicator("Momentum Indicators")
def rocr(df: DataFrame, real: str, timeperiod: int = 10, out: str = "rocr") -> DataFrame:
    return df.withColumn(out, F.try_divide(F.col(real), F.lag(real, timeperiod).over(_w())))


@indicator("Momentum Indicators")
def rocr100(df: DataFrame, real: str, timeperiod: int = 10, out: str = "rocr100") -> DataFrame:
    return df.withColumn(out, 100 * F.try_divide(F.col(real), F.lag(real, timeperiod).over(_w())))


@indicator("Momentum Indicators")
def aroonosc(df: DataFrame, high: str = "high", low: str = "low", timeperiod: int = 14, out: str = "aroonosc") -> DataFrame:
    (a,) = fresh(df, "__aroon")
    return aroon(df, high, low, timeperiod, a).withColumn(out, F.col(f"{a}_up") - F.col(f"{a}_down")).drop(f"{a}_up", f"{a}_down")


@indicator("Momentum Indicators")
def ultosc(df: DataFrame, high: str = "high", low: str = "low", close: str = "close", timeperiod1: int = 7, timeperiod2: int = 14, timeperiod3: int = 28, out: str = "ultosc") -> DataFrame:
    """Buying pressure over true range, summed over three periods, weighted 4, 2, 1 from the shortest to the longest."""
    w, (p, t) = _w(), fresh(df, "__pressure", "__range")
    before = F.lag(close).over(w)
    pressure = F.when(before.isNotNull(), F.col(close) - F.least(F.col(low), before))
    work = df.withColumn(t, _true_range(high, low, close)).withColumn(p, pressure)
    a, b, c = (F.try_divide(full(F.col(p), F.sum, n, w), full(F.col(t), F.sum, n, w)) for n in sorted((timeperiod1, timeperiod2, timeperiod3)))
    return work.withColumn(out, 100 * (4 * a + 2 * b + c) / 7).drop(p, t)


@indicator("Momentum Indicators")
def stoch(df: DataFrame, high: str = "high", low: str = "low", close: str = "close", fastk_period: int = 5, slowk_period: int = 3, slowd_period: int = 3, out: str = "stoch") -> DataFrame:
    """{out}_k: the fast value's plain mean; {out}_d: the mean of that."""
    w, (f,) = _w(), fresh(df, "__fast")
    work = stochf(df, high, low, close, fastk_period, slowk_period, f).withColumn(f"{out}_k", F.col(f"{f}_d"))
    return work.withColumn(f"{out}_d", full(F.col(f"{out}_k"), F.avg, slowd_period, w)).drop(f"{f}_k", f"{f}_d")


@indicator("Momentum Indicators")
def stochrsi(df: DataFrame, real: str, timeperiod: int = 14, fastk_period: int = 5, fastd_period: int = 3, out: str = "stochrsi") -> DataFrame:
    """Where the relative strength lies between its extremes of the last bars; {out}_k, {out}_d."""
    (x,) = fresh(df, "__rsi")
    return stochf(rsi(df, real, timeperiod, x), x, x, x, fastk_period, fastd_period, out).drop(x)


@indicator("Momentum Indicators")
def macdfix(df: DataFrame, real: str, signalperiod: int = 9, out: str = "macdfix") -> DataFrame:
    """macd with the fixed smoothing factors 0.15 and 0.075."""
    f, s, m = fresh(df, "__fast", "__slow", "__macd")
    work = seeded_ema(seeded_ema(df, f, F.col(real), 12, 0.15), s, F.col(real), 26, 0.075).withColumn(m, F.col(f) - F.col(s))
    work = seeded_ema(work, f"{out}_signal", F.col(m), signalperiod)
    there = F.col(f"{out}_signal").isNotNull()
    return work.withColumn(out, F.when(there, F.col(m))).withColumn(f"{out}_hist", F.col(m) - F.col(f"{out}_signal")).drop(f, s, m)


# Volume


@indicator("Volume Indicators")
def obv(df: DataFrame, real: str = "close", volume: str = "base_asset_volume", out: str = "obv") -> DataFrame:
    w = _w()
    step = F.coalesce(F.signum(F.col(real) - F.lag(real).over(w)) * F.col(volume), F.col(volume))
    work = df.withColumn("__s", step)
    return work.withColumn(out, F.sum("__s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


@indicator("Volume Indicators")
def ad(df: DataFrame, high: str = "high", low: str = "low", close: str = "close", volume: str = "base_asset_volume", out: str = "ad") -> DataFrame:
    part = F.coalesce(F.try_divide(2 * F.col(close) - F.col(high) - F.col(low), F.col(high) - F.col(low)), F.lit(0.0))
    work = df.withColumn("__s", part * F.col(volume))
    return work.withColumn(out, F.sum("__s").over(_w().rowsBetween(Window.unboundedPreceding, 0))).drop("__s")


@indicator("Volume Indicators")
def adosc(
    df: DataFrame, high: str = "high", low: str = "low", close: str = "close", volume: str = "base_asset_volume", fastperiod: int = 3, slowperiod: int = 10, out: str = "adosc"
) -> DataFrame:
    """Fast less slow average of the accumulation line; both start from its first value."""
    a, f, s = fresh(df, "__ad", "__fast", "__slow")
    work = ad(df, high, low, close, volume, a)
    for name, n in ((f, fastperiod), (s, slowperiod)):
        work = seeded_ema(work, name, F.col(a), 1, 2 / (n + 1))
    ready = F.row_number().over(_w()) >= max(fastperiod, slowperiod)
    return work.withColumn(out, F.when(ready, F.col(f) - F.col(s))).drop(a, f, s)


# Volatility


@indicator("Volatility Indicators")
def trange(df: DataFrame, high: str = "high", low: str = "low", close: str = "close", out: str = "trange") -> DataFrame:
    return df.withColumn(out, _true_range(high, low, close))


@indicator("Volatility Indicators")
def atr(df: DataFrame, high: str = "high", low: str = "low", close: str = "close", timeperiod: int = 14, out: str = "atr") -> DataFrame:
    return seeded_ema(df.withColumn("__tr", _true_range(high, low, close)), out, F.col("__tr"), timeperiod, 1 / timeperiod).drop("__tr")


@indicator("Volatility Indicators")
def natr(df: DataFrame, high: str = "high", low: str = "low", close: str = "close", timeperiod: int = 14, out: str = "natr") -> DataFrame:
    return atr(df, high, low, close, timeperiod, "__a").withColumn(out, 100 * F.try_divide(F.col("__a"), F.col(close))).drop("__a")


# Prices


@indicator("Price Transform")
def avgprice(df: DataFrame, open: str = "open", high: str = "high", low: str = "low", close: str = "close", out: str = "avgprice") -> DataFrame:
    return df.withColumn(out, (F.col(open) + F.col(high) + F.col(low) + F.col(close)) / 4)


@indicator("Price Transform")
def medprice(df: DataFrame, high: str = "high", low: str = "low", out: str = "medprice") -> DataFrame:
    return df.withColumn(out, (F.col(high) + F.col(low)) / 2)


@indicator("Price Transform")
def typprice(df: DataFrame, high: str = "high", low: str = "low", close: str = "close", out: str = "typprice") -> DataFrame:
    return df.withColumn(out, (F.col(high) + F.col(low) + F.col(close)) / 3)


@indicator("Price Transform")
def wclprice(df: DataFrame, high: str = "high", low: str = "low", close: str = "close", out: str = "wclprice") -> DataFrame:
    return df.withColumn(out, (F.col(high) + F.col(low) + 2 * F.col(close)) / 4)


# Statistics


@indicator("Statistic Functions")
def stddev(df: DataFrame, real: str, timeperiod: int = 5, nbdev: float = 1.0, out: str = "stddev") -> DataFrame:
    return df.withColumn(out, nbdev * full(F.col(real), F.stddev_pop, timeperiod, _w()))


@indicator("Statistic Functions")
def var(df: DataFrame, real: str, timeperiod: int = 5, out: str = "var") -> DataFrame:
    return df.withColumn(out, full(F.col(real), F.var_pop, timeperiod, _w()))


def _over_time(df: DataFrame, real: str, n: int, out: str, value: Callable[[Column, Column, Column], Column]) -> DataFrame:
    """``value`` of slope and mean of the last n values over 0 .. n - 1."""
    w = _w()
    work = df.withColumn("__n", F.row_number().over(w).cast("double"))
    slope = full(F.col(real), lambda c: F.regr_slope(c, F.col("__n")), n, w)
    mean = full(F.col(real), F.avg, n, w)
    return work.withColumn("__b", slope).withColumn("__y", mean).withColumn(out, value(F.col("__b"), F.col("__y"), F.lit((n - 1) / 2))).drop("__n", "__b", "__y")


@indicator("Statistic Functions")
def linearreg(df: DataFrame, real: str, timeperiod: int = 14, out: str = "linearreg") -> DataFrame:
    return _over_time(df, real, timeperiod, out, lambda b, y, h: y + b * h)


@indicator("Statistic Functions")
def linearreg_slope(df: DataFrame, real: str, timeperiod: int = 14, out: str = "linearreg_slope") -> DataFrame:
    return _over_time(df, real, timeperiod, out, lambda b, y, h: b)


@indicator("Statistic Functions")
def linearreg_intercept(df: DataFrame, real: str, timeperiod: int = 14, out: str = "linearreg_intercept") -> DataFrame:
    return _over_time(df, real, timeperiod, out, lambda b, y, h: y - b * h)


@indicator("Statistic Functions")
def tsf(df: DataFrame, real: str, timeperiod: int = 14, out: str = "tsf") -> DataFrame:
    return _over_time(df, real, timeperiod, out, lambda b, y, h: y + b * (h + 1))


@indicator("Statistic Functions")
def correl(df: DataFrame, real0: str, real1: str, timeperiod: int = 30, out: str = "correl") -> DataFrame:
    return df.withColumn(out, F.nanvl(full(F.col(real0), lambda c: F.corr(c, F.col(real1)), timeperiod, _w()), F.lit(None).cast("double")))


@indicator("Statistic Functions")
def linearreg_angle(df: DataFrame, real: str, timeperiod: int = 14, out: str = "linearreg_angle") -> DataFrame:
    return _over_time(df, real, timeperiod, out, lambda b, y, h: F.degrees(F.atan(b)))


@indicator("Statistic Functions")
def beta(df: DataFrame, real0: str, real1: str, timeperiod: int = 5, out: str = "beta") -> DataFrame:
    """The slope of the second column's returns over the first's; 0 where the first's returns are all equal."""
    w, (x, y) = _w(), fresh(df, "__x", "__y")
    work = df
    for name, c in ((x, real0), (y, real1)):
        before = F.lag(c).over(w)
        work = work.withColumn(name, F.try_divide(F.col(c) - before, before))
    slope = full(F.col(y), lambda c: F.regr_slope(c, F.col(x)), timeperiod, w)
    seen = F.count(F.col(x) + F.col(y)).over(last_rows(w, timeperiod))
    return work.withColumn(out, F.when(seen == timeperiod, F.coalesce(F.nanvl(slope, F.lit(0.0)), F.lit(0.0)))).drop(x, y)


# Math


def _extreme_at(df: DataFrame, real: str, n: int, sign: int) -> tuple[DataFrame, str, Column]:
    """Rows with a number column, its name, and the number (from 0) of the extreme of the last n values; the latest of equal ones."""
    w = _w()
    at = F.row_number().over(w) - 1
    names = fresh(df, "__row")
    work = df.withColumn(names[0], at)
    best = F.max_by(names[0], F.struct(sign * F.col(real), F.col(names[0]))).over(last_rows(w, n))
    return work, names[0], F.when(F.count(real).over(last_rows(w, n)) == n, best)


@indicator("Math Operators")
def maxindex(df: DataFrame, real: str, timeperiod: int = 30, out: str = "maxindex") -> DataFrame:
    work, row, best = _extreme_at(df, real, timeperiod, 1)
    return work.withColumn(out, best).drop(row)


@indicator("Math Operators")
def minindex(df: DataFrame, real: str, timeperiod: int = 30, out: str = "minindex") -> DataFrame:
    work, row, best = _extreme_at(df, real, timeperiod, -1)
    return work.withColumn(out, best).drop(row)


@indicator("Math Operators")
def minmax(df: DataFrame, real: str, timeperiod: int = 30, out: str = "minmax") -> DataFrame:
    return max_(min_(df, real, timeperiod, f"{out}_min"), real, timeperiod, f"{out}_max")


@indicator("Math Operators")
def minmaxindex(df: DataFrame, real: str, timeperiod: int = 30, out: str = "minmaxindex") -> DataFrame:
    return maxindex(minindex(df, real, timeperiod, f"{out}_min"), real, timeperiod, f"{out}_max")


@indicator("Math Operators")
def max_(df: DataFrame, real: str, timeperiod: int = 30, out: str = "max") -> DataFrame:
    return df.withColumn(out, full(F.col(real), F.max, timeperiod, _w()))


@indicator("Math Operators")
def min_(df: DataFrame, real: str, timeperiod: int = 30, out: str = "min") -> DataFrame:
    return df.withColumn(out, full(F.col(real), F.min, timeperiod, _w()))


@indicator("Math Operators")
def sum_(df: DataFrame, real: str, timeperiod: int = 30, out: str = "sum") -> DataFrame:
    return df.withColumn(out, full(F.col(real), F.sum, timeperiod, _w()))


def _two(name: str, f: Callable[[Column, Column], Column]) -> None:
    def op(df: DataFrame, real0: str, real1: str, out: str = name) -> DataFrame:
        return df.withColumn(out, f(F.col(real0), F.col(real1)))

    op.__name__ = name
    indicator("Math Operators")(op)


for _name, _f in {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mult": lambda a, b: a * b, "div": F.try_divide}.items():
    _two(_name, _f)


def _one(name: str, f: Callable[[Column], Column]) -> None:
    def op(df: DataFrame, real: str, out: str = name) -> DataFrame:
        return df.withColumn(out, f(F.col(real)))

    op.__name__ = name
    indicator("Math Transform")(op)


for _name, _f in {
    "sqrt": lambda c: F.when(c >= 0, F.sqrt(c)), "ln": F.ln, "log10": F.log10, "exp": F.exp, "floor": lambda c: F.floor(c).cast("double"), "ceil": lambda c: F.ceil(c).cast("double"),
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "atan": F.atan,
    "asin": lambda c: F.when(F.abs(c) <= 1, F.asin(c)), "acos": lambda c: F.when(F.abs(c) <= 1, F.acos(c)),
}.items():
    _one(_name, _f)
for _name in ("MAX_", "MIN_", "SUM_"):
    _REGISTRY[_name[:-1]] = _REGISTRY.pop(_name)


# Candles


@indicator("Pattern Recognition")
def cdldoji(df: DataFrame, open: str = "open", high: str = "high", low: str = "low", close: str = "close", share: float = 0.1, out: str = "cdldoji") -> DataFrame:
    """100 where the body is at most ``share`` of the mean range of the ten bars before."""
    w = _w().rowsBetween(-10, -1)
    span = F.when(F.count(high).over(w) == 10, F.avg(F.col(high) - F.col(low)).over(w))
    return df.withColumn(out, F.when(F.abs(F.col(close) - F.col(open)) <= share * span, 100).otherwise(0))


@indicator("Pattern Recognition")
def cdlengulfing(df: DataFrame, open: str = "open", high: str = "high", low: str = "low", close: str = "close", out: str = "cdlengulfing") -> DataFrame:
    """100 (-100) where a rising (falling) body covers the opposite body before it."""
    w, o, c = _w(), F.col(open), F.col(close)
    o1, c1 = F.lag(open).over(w), F.lag(close).over(w)
    up = (c > o) & (c1 < o1) & (c >= o1) & (o <= c1) & ((c > o1) | (o < c1))
    down = (c < o) & (c1 > o1) & (o >= c1) & (c <= o1) & ((o > c1) | (c < o1))
    return df.withColumn(out, F.when(up, 100).when(down, -100).otherwise(0))


class IndicatorFactory:
    """Looks indicators up and makes steps ``df -> df`` from them."""

    def get_function_groups(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for name, (group, _) in _REGISTRY.items():
            out.setdefault(group, []).append(name)
        return out

    def get_functions(self) -> list[str]:
        return list(_REGISTRY)

    def get_args_kwargs(self, func_name: str) -> tuple[list[str], dict[str, Any]]:
        """Column arguments, and parameters with their defaults."""
        columns, parameters = [], {}
        for p in list(inspect.signature(self.get_ta_func(func_name)).parameters.values())[1:]:
            if p.name == "out":
                continue
            if p.annotation in (str, "str"):
                columns.append(p.name)
            else:
                parameters[p.name] = p.default
        return columns, parameters

    def get_ta_func(self, func_name: str) -> Indicator:
        if func_name not in _REGISTRY:
            raise ValueError(f"unknown indicator {func_name}")
        return _REGISTRY[func_name][1]

    def _columns(self, func_name: str, col: str | list[str] | None, mapping: dict[str, str] | None) -> dict[str, str]:
        wanted, _ = self.get_args_kwargs(func_name)
        if mapping is not None:
            if not isinstance(mapping, dict):
                raise TypeError("col_to_transform_mapping must be a dict")
            if unknown := set(mapping) - set(wanted):
                raise ValueError(f"{func_name} has no arguments {sorted(unknown)}")
        given = inspect.signature(self.get_ta_func(func_name)).parameters
        found = {n: n if given[n].default is inspect.Parameter.empty else given[n].default for n in wanted} | (mapping or {})
        if "real" in wanted and "real" not in (mapping or {}):
            if not isinstance(col, str):
                raise ValueError(f"{func_name} needs one column")
            found["real"] = col
        if "real0" in wanted and not {"real0", "real1"} <= set(mapping or {}):
            if not isinstance(col, (list, tuple)) or len(col) != 2:
                raise ValueError(f"{func_name} needs two columns")
            found |= dict(zip(("real0", "real1"), col, strict=True))
        return found

    def create_transformer(
        self, func_name: str, col_to_transform: str | list[str] | None = None, col_to_transform_mapping: dict[str, str] | None = None, kw_args: dict[str, Any] | None = None
    ) -> Callable[[DataFrame], DataFrame]:
        func, (_, allowed) = self.get_ta_func(func_name), self.get_args_kwargs(func_name)
        if kw_args and (unknown := set(kw_args) - set(allowed)):
            raise ValueError(f"{func_name} has no parameters {sorted(unknown)}")
        columns = self._columns(func_name, col_to_transform, col_to_transform_mapping)

        def step(df: DataFrame) -> DataFrame:
            if not isinstance(df, DataFrame):
                raise TypeError("a DataFrame is needed")
            if missing := sorted(set(columns.values()) - set(df.columns)):
                raise ValueError(f"missing columns: {missing}")
            return func(df, **columns, **(kw_args or {}))

        return step
