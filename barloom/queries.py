"""Registered queries of the bar operators and their DuckDB statements.

Queries run on hourly bars of the events table, one series per event type; both sides round to six decimals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import indicators as ind
from barloom.functions.windows import by_series, ewm
from barloom.operators import align, bars, bet_sizing, breaks, ensemble, labels, microstructure, rolling, sampling, technical, validation
from barloom.plans.strategy import StrategySignalPipeline, StrategyTrader, feature_union
from barloom.schema import from_millis, identity, nan_to_null, to_millis
from barloom.sources.events import ticks
from barloom.sources.lineitem import trades

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# The bars, on both sides

TICKS = """ticks as (
  select event_type as series_id, event_id, date_trunc('milliseconds', ts)::timestamp as ts, value + 1.0::double as price,
    regexp_extract(props, '"k":\\s*(\\d+)', 1)::double + 1.0::double as qty, event_type in ('purchase', 'view', 'signup') as is_buy
  from events)"""


def _bars_sql(keys: str, source: str = "ticks") -> str:
    return f"""select series_id, max(ts) as ts, min(epoch_ms(ts)) as first_timestamp,
    arg_min(price, row(ts, event_id)) as open, max(price) as high, min(price) as low, arg_max(price, row(ts, event_id)) as close,
    sum(qty) as base_asset_volume, sum(case when is_buy then qty else 0 end) as base_asset_buy_volume, sum(case when is_buy then 0 else qty end) as base_asset_sell_volume,
    sum(price * qty) as quote_asset_volume, sum(case when is_buy then price * qty else 0 end) as quote_asset_buy_volume, sum(case when is_buy then 0 else price * qty end) as quote_asset_sell_volume,
    count(*) as num_ticks, sum(is_buy::int)::bigint as num_buy_ticks, {keys}
  from {source} group by series_id, {keys.split(' as ')[0]}"""


BARS = f"{TICKS},\nbars as ({_bars_sql('''date_trunc('hour', ts) as unit''')}),\nb as (select *, row_number() over (partition by series_id order by ts) as pos from bars)"


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars.time_bars(ticks(spark, sf_dir), "hour")


def r(c: Column | str) -> Column:
    """Six decimals; what lies halfway, but for the last bits, goes up on both sides."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-10, 6) + 0.0


def R(e: str) -> str:
    return f"(round(({e})::double + 1e-10::double, 6) + 0.0)"


def full_sql(agg: str, x: str, n: int) -> str:
    w = f"over (partition by series_id order by ts rows between {n - 1} preceding and current row)"
    return f"case when count({x}) {w} = {n} then {agg} {w} end"


def lag_sql(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) over (partition by series_id order by ts)"


def register(name: str, spark_side: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = spark_side
    if sql:
        ORACLES[name] = sql


def on_bars(name: str, op: Callable[[DataFrame], DataFrame], columns: dict[str, str], ctes: str = "", source: str = "b", where: str = "", ints: tuple[str, ...] = ()) -> None:
    """A query that adds ``columns`` (name -> DuckDB expression over ``source``) to the bars' keys."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = op(hourly(spark, sf_dir))
        return out.select("series_id", "ts", *[F.col(c).cast("int").alias(c) if c in ints else r(c).alias(c) for c in columns])

    picked = ", ".join(f"{f'({e})::int' if c in ints else R(e)} as {c}" for c, e in columns.items())
    register(name, run, f"with {BARS}{',' if ctes else ''}\n{ctes}\nselect series_id, ts, {picked} from {source} {where}")


# Sources and bars


def _shown_bars(df: DataFrame, *more: str) -> DataFrame:
    whole = ("num_ticks", "num_buy_ticks", "first_timestamp")
    money = ("open", "high", "low", "close", "base_asset_volume", "base_asset_buy_volume", "base_asset_sell_volume", "quote_asset_volume", "quote_asset_buy_volume", "quote_asset_sell_volume")
    return df.select("series_id", "ts", *more, *[F.col(c).cast("long").alias(c) for c in whole], *[r(c).alias(c) for c in money])


_SHOWN = "first_timestamp::bigint as first_timestamp, num_ticks::bigint as num_ticks, num_buy_ticks::bigint as num_buy_ticks, " + ", ".join(
    f"{R(c)} as {c}" for c in ("open", "high", "low", "close", "base_asset_volume", "base_asset_buy_volume", "base_asset_sell_volume", "quote_asset_volume", "quote_asset_buy_volume", "quote_asset_sell_volume")
)
register("bars_time", lambda s, d: _shown_bars(hourly(s, d)), f"with {BARS} select series_id, ts, {_SHOWN} from bars")
for _kind, _amount, _limit in (("tick", "1.0::double", 10.0), ("volume", "qty", 500.0), ("dollar", "price * qty", 20000.0)):
    register(
        f"bars_{_kind}",
        lambda s, d, k=_kind, t=_limit: _shown_bars(bars.dynamic_bars(ticks(s, d), k, t), "bar_id"),
        f"""with {TICKS}, t as (select *, floor(coalesce(sum({_amount}) over (partition by series_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) / {_limit}) as bar from ticks),
x as ({_bars_sql("bar::bigint as bar_id", "t").replace("group by series_id, bar::bigint", "group by series_id, bar")}) select series_id, ts, bar_id, {_SHOWN} from x""",
    )
register(
    "ticks_millis",
    lambda s, d: identity(ticks(s, d)).select("event_id", to_millis(F.col("ts")).alias("millis"), from_millis(to_millis(F.col("ts"))).alias("back"), nan_to_null(F.when(F.col("price") > 0, F.col("price")).otherwise(F.lit(float("nan")))).alias("price")),
    f"with {TICKS} select event_id, epoch_ms(ts)::bigint as millis, ts as back, price from ticks",
)

_IMB = "base_asset_buy_volume - base_asset_sell_volume"
_VPIN0 = f"{full_sql(f'sum(abs({_IMB}))', _IMB, 20)} / ({full_sql('sum(base_asset_volume)', 'base_asset_volume', 20)})"
_VPIN = f"case when pos > 20 then coalesce({_VPIN0}, 0) else {_VPIN0} end"
_TRADES = """trades as (select l_suppkey::varchar as series_id, l_orderkey * 10 + l_linenumber as event_id, l_shipdate::timestamp as ts, l_extendedprice / l_quantity as price,
  l_quantity as qty, l_returnflag <> 'R' as is_buy from lineitem)"""
_UNIT = "date_trunc('day', ts) as unit"
_DAILY = f"{_TRADES}, bars as ({_bars_sql(_UNIT, 'trades')})"
register("bars_daily_lineitem", lambda s, d: _shown_bars(bars.time_bars(trades(s, d), "day")), f"with {_DAILY} select series_id, ts, {_SHOWN} from bars")
register(
    "vpin_daily_lineitem",
    lambda s, d: microstructure.vpin(bars.time_bars(trades(s, d), "day")).select("series_id", "ts", r("vpin").alias("vpin")),
    f"with {_DAILY}, b as (select *, row_number() over (partition by series_id order by ts) as pos from bars) select series_id, ts, {R(_VPIN)} as vpin from b",
)


# Rolling features

_Z = {
    "bar_arrival_time": f"(epoch_us(ts) - {lag_sql('epoch_us(ts)')})::double * 1000",
    "buy_sell_diff": "quote_asset_buy_volume - quote_asset_sell_volume",
    "average_buy_size": "case when num_buy_ticks > 0 then quote_asset_buy_volume / num_buy_ticks end",
    "high_to_low_ratio": "high / low",
}
for _key, _e in _Z.items():
    on_bars(
        f"zscore_{_key}",
        rolling.z_score_transformer(_key, 20),
        {f"{_key}_z": f"case when {full_sql('stddev_samp(x)', 'x', 20)} > 0 then (x - {full_sql('avg(x)', 'x', 20)}) / {full_sql('stddev_samp(x)', 'x', 20)} end"},
        f"x as (select series_id, ts, {_e} as x from b)",
        "x",
    )
on_bars("local_max_to_close", lambda b: rolling.local_max_to_close(b, 20), {"local_max_to_close": f"{full_sql('max(high)', 'high', 20)} / close"})

# Microstructure

_D = f"d1 as (select *, close - {lag_sql('close')} as d, ln(close) - {lag_sql('ln(close)')} as l from b),\nd2 as (select *, {lag_sql('d')} as e from d1)"
_ROLL = "case when count(case when e is not null then d end) over w = 20 then 2 * sqrt(abs(covar_samp(d, e) over w)) end"
_W20 = "window w as (partition by series_id order by ts rows between 19 preceding and current row)"
on_bars("roll_measure", microstructure.roll_measure, {"roll_measure": _ROLL}, _D, "d2", _W20)
on_bars("roll_impact", microstructure.roll_impact, {"roll_impact": f"{_ROLL} / quote_asset_volume"}, _D, "d2", _W20)
on_bars("parkinson_volatility", microstructure.parkinson_volatility, {"parkinson": full_sql("avg(x)", "x", 20)}, "x as (select *, ln(high / low) ^ 2 / (4 * ln(2)) as x from b)", "x")
_RANGE = f"""x1 as (select *, ln(high / low) ^ 2 + {lag_sql("ln(high / low) ^ 2")} as two,
  case when {lag_sql("high")} is not null then ln(greatest(high, {lag_sql("high")}) / least(low, {lag_sql("low")})) ^ 2 end as gamma from b),
x2 as (select *, {full_sql("avg(two)", "two", 20)} as beta from x1),
x3 as (select *, (sqrt(2) - 1) * sqrt(beta) / (3 - 2 * sqrt(2)) - sqrt(gamma / (3 - 2 * sqrt(2))) as a0,
  (pow(2, -0.5) - 1) * sqrt(beta) / (sqrt(8 / pi()) * (3 - 2 * sqrt(2))) + sqrt(gamma / (8 / pi() * (3 - 2 * sqrt(2)))) as s0 from x2),
x4 as (select *, case when a0 < 0 then 0 else a0 end as a from x3)"""
on_bars("corwin_schultz_spread", microstructure.corwin_schultz_spread, {"corwin_schultz": "2 * (exp(a) - 1) / (1 + exp(a))"}, _RANGE, "x4")
on_bars("beckers_parkinson_volatility", microstructure.beckers_parkinson_volatility, {"beckers_parkinson": "case when s0 < 0 then 0 else s0 end"}, _RANGE, "x4")
for _name, _op, _e in (("kyle_lambda", microstructure.kyle_lambda, "abs(d) / base_asset_volume"), ("amihud_lambda", microstructure.amihud_lambda, "abs(l) / quote_asset_volume"), ("hasbrouck_lambda", microstructure.hasbrouck_lambda, "abs(l) / sqrt(quote_asset_volume)")):
    on_bars(_name, _op, {_name: full_sql("avg(x)", "x", 20)}, f"{_D},\nx as (select *, {_e} as x from d2)", "x")
on_bars("vpin", microstructure.vpin, {"vpin": _VPIN})
on_bars("flagship", lambda b: microstructure.vpin(microstructure.roll_measure(b)), {"vpin": _VPIN, "roll_measure": _ROLL}, _D, "d2", _W20)

# Exponential weights and recurrences


def ewm_sql(name: str, source: str, x: str, span: int) -> str:
    """CTE ``name`` (series_id, pos, m, s): weighted mean and debiased deviation of ``x``."""
    q = 1 - 2 / (span + 1)
    return f"""{name}_i as (select series_id, pos, ({x})::double as x from {source}),
{name}_m as (select a.series_id, a.pos, sum(pow({q}, a.pos - c.pos) * c.x) / nullif(sum(case when c.x is not null then pow({q}, a.pos - c.pos) end), 0) as m,
  sum(case when c.x is not null then pow({q}, a.pos - c.pos) end) as w, sum(case when c.x is not null then pow({q * q}, a.pos - c.pos) end) as v, count(c.x) as n
  from {name}_i a join {name}_i c on a.series_id = c.series_id and c.pos <= a.pos group by a.series_id, a.pos),
{name} as (select a.series_id, a.pos, any_value(a.m) as m, case when any_value(a.n) > 1 then sqrt(sum(pow({q}, a.pos - c.pos) * (c.x - a.m) ^ 2) / any_value(a.w) * any_value(a.w) ^ 2 / (any_value(a.w) ^ 2 - any_value(a.v))) end as s
  from {name}_m a join {name}_i c on a.series_id = c.series_id and c.pos <= a.pos group by a.series_id, a.pos)"""


def ema_sql(name: str, source: str, x: str, n: int, alpha: float | None = None) -> str:
    """CTE ``name`` (series_id, pos, v): an average seeded with the mean of the first n values of ``x``."""
    a = 2 / (n + 1) if alpha is None else alpha
    return f"""{name}_i as (select series_id, pos, ({x})::double as x from {source}),
{name}_k as (select *, count(x) over (partition by series_id order by pos) as k, avg(x) over (partition by series_id order by pos rows between {n - 1} preceding and current row) as seed from {name}_i),
{name}_u as (select series_id, pos, k, case when k = {n} and x is not null then seed when k > {n} then {a} * x end as u from {name}_k),
{name} as (select a.series_id, a.pos, case when any_value(a.k) >= {n} then sum(c.u * pow({1 - a}, a.pos - c.pos)) end as v
  from {name}_u a join {name}_u c on a.series_id = c.series_id and c.pos <= a.pos group by a.series_id, a.pos)"""


def joined(*names: str) -> str:
    return "b " + " ".join(f"join {n} using (series_id, pos)" for n in names)


on_bars("ewm_mean_std", lambda b: ewm(ewm(b, "m", "close", 12), "s", "close", 30, std=True), {"m": "e1.m", "s": "e2.s"}, f"{ewm_sql('e1', 'b', 'close', 12)},\n{ewm_sql('e2', 'b', 'close', 30)}", joined("e1", "e2"))
on_bars("ewm_difference", lambda b: technical.ewm_difference(b, 5, 20), {"ewm_difference": "(e1.m - e2.m) / (e1.m + 1)"}, f"{ewm_sql('e1', 'b', 'close', 5)},\n{ewm_sql('e2', 'b', 'close', 20)}", joined("e1", "e2"))
_QI = "quote_asset_buy_volume - quote_asset_sell_volume"
on_bars("buy_sell_imbalance", lambda b: technical.buy_sell_imbalance(b, 5, 20), {"imbalance": "(e1.m - e2.m) / (quote_asset_volume + 1)"}, f"{ewm_sql('e1', 'b', _QI, 5)},\n{ewm_sql('e2', 'b', _QI, 20)}", joined("e1", "e2"))

_CROSS = f"""f as (select *, {full_sql("avg(close)", "close", 5)} as f, {full_sql("avg(close)", "close", 20)} as s from b),
g as (select *, {lag_sql("f")} as f1, {lag_sql("s")} as s1 from f),
h as (select *, case when f1 <= s1 and f > s then 1 when f1 >= s1 and f < s then -1 else 0 end as x from g)"""
on_bars("ma_crossover", lambda b: technical.moving_average_crossover(b, 5, 20), {"crossover": "x"}, _CROSS, "h", ints=("crossover",))
on_bars(
    "ma_crossover_filled",
    lambda b: technical.predict_proba(technical.moving_average_crossover(b, 5, 20, fill_between_crossovers=True), "crossover"),
    {"crossover": "y", "proba_0": "(y = -1)::int", "proba_1": "(y = 0)::int", "proba_2": "(y = 1)::int"},
    f"{_CROSS}, k as (select *, coalesce(last_value(nullif(x, 0) ignore nulls) over (partition by series_id order by ts rows between unbounded preceding and current row), 0) as y from h)", "k", ints=("crossover",),
)
_RSI = f"dd as (select *, close - {lag_sql('close')} as d from b),\n{ema_sql('rg', 'dd', 'case when d is not null then greatest(d, 0) end', 14, 1 / 14)},\n{ema_sql('rl', 'dd', 'case when d is not null then greatest(-d, 0) end', 14, 1 / 14)},\nrs as (select rg.series_id, rg.pos, case when rg.v + rl.v = 0 then 0 else 100 * rg.v / (rg.v + rl.v) end as v from rg join rl using (series_id, pos))"
_MACD = f"{ema_sql('mf', 'b', 'close', 12)},\n{ema_sql('ms', 'b', 'close', 26)},\nmm as (select mf.series_id, mf.pos, mf.v - ms.v as v from mf join ms using (series_id, pos)),\n{ema_sql('mg', 'mm', 'v', 9)},\nmh as (select mm.series_id, mm.pos, case when mg.v is not null then mm.v end as macd, mg.v as signal, mm.v - mg.v as hist from mm join mg using (series_id, pos))"
on_bars("ta_ema_rsi", lambda b: ind.rsi(ind.ema(b, "close", 10), "close", 14), {"ema": "e.v", "rsi": "rs.v"}, f"{ema_sql('e', 'b', 'close', 10)},\n{_RSI}", joined("e", "rs"))
on_bars("ta_macd", lambda b: ind.macd(b, "close"), {"macd": "mh.macd", "macd_signal": "mh.signal", "macd_hist": "mh.hist"}, _MACD, joined("mh"))
_SIGN = f"sg as (select series_id, pos, sign(round(hist, 12)) as g from mh), sh as (select series_id, pos, (g - lag(g) over (partition by series_id order by pos)) / 2 as v from sg)"
on_bars("macd_histogram_crossover", technical.macd_histogram_crossover, {"macd_crossover": "sh.v"}, f"{_MACD},\n{_SIGN}", joined("sh"))
on_bars("mean_reversion", lambda b: technical.mean_reversion(b, 0.05, 10), {"side": "case when (close - e.v) / e.v > 0.05 then -1 when (close - e.v) / e.v < -0.05 then 1 else 0 end"}, ema_sql("e", "b", "close", 10), joined("e"), ints=("side",))
_ARR = f"ta as (select *, (epoch_us(ts) - {lag_sql('epoch_us(ts)')})::double * 1000 as t from b), tb as (select *, ({full_sql('avg(t)', 't', 5)} - {full_sql('avg(t)', 't', 20)}) / 1e13 as p from ta)"
on_bars(
    "bar_arrival_rsi", lambda b: technical.bar_arrival_rsi(b, 14, 30.0, 60.0, 5, 20, 1e13, -0.5, 0.5),
    {"side": "case when rs.v > 30 and rs.v < 60 and tb.p > -0.5 and tb.p < 0.5 then 1 else 0 end"}, f"{_RSI},\n{_ARR}", "tb join rs using (series_id, pos)", ints=("side",),
)
_CONF = """ra as (select b.series_id, b.ts, b.pos, rs.v as v, case when rs.v < 55 then 1 else 0 end as below from b join rs using (series_id, pos)),
rb as (select *, min(below) over (partition by series_id order by ts rows between 2 preceding and current row) as all_below, count(*) over (partition by series_id order by ts rows between 2 preceding and current row) as n,
  case when count(v) over (partition by series_id order by ts rows between 4 preceding and current row) = 5 then avg(v) over (partition by series_id order by ts rows between 4 preceding and current row) end as m from ra),
rc as (select *, m - lag(m) over (partition by series_id order by ts) as d from rb)"""
on_bars("rsi_confirmation", lambda b: technical.rsi_confirmation(b, 14, 55.0, 3, 5), {"side": "case when all_below = 1 and n = 3 and d > 0 then 1 else 0 end"}, f"{_RSI},\n{_CONF}", "rc", ints=("side",))

# The rest of the indicator registry, by lowering


def _chain(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = s(df)
        return df

    return run


_MAKE = ind.IndicatorFactory().create_transformer
on_bars(
    "ta_overlap",
    _chain(_MAKE("SMA", "close", kw_args={"timeperiod": 10}), _MAKE("WMA", "close", kw_args={"timeperiod": 10}), _MAKE("TRIMA", "close", kw_args={"timeperiod": 10}), _MAKE("BBANDS", "close"), _MAKE("MIDPOINT", "close"), _MAKE("MIDPRICE")),
    {
        "sma": full_sql("avg(close)", "close", 10),
        "wma": "case when pos >= 10 then (" + " + ".join(f"{10 - k} * {lag_sql('close', k)}" if k else "10 * close" for k in range(10)) + ") / 55 end",
        "trima": full_sql("avg(tri)", "tri", 5),
        "bbands_upper": f"{full_sql('avg(close)', 'close', 5)} + 2 * {full_sql('stddev_pop(close)', 'close', 5)}", "bbands_middle": full_sql("avg(close)", "close", 5), "bbands_lower": f"{full_sql('avg(close)', 'close', 5)} - 2 * {full_sql('stddev_pop(close)', 'close', 5)}",
        "midpoint": f"({full_sql('max(close)', 'close', 14)} + {full_sql('min(close)', 'close', 14)}) / 2", "midprice": f"({full_sql('max(high)', 'high', 14)} + {full_sql('min(low)', 'low', 14)}) / 2",
    },
    f"t as (select *, {full_sql('avg(close)', 'close', 6)} as tri from b)", "t",
)
on_bars(
    "ta_mavp", lambda b: ind.mavp(b.withColumn("periods", F.pmod(F.col("num_ticks"), F.lit(7)) + 2), "close", "periods", maxperiod=8), {"mavp": "case when pos >= 8 then list_avg(list_slice(l, -n, -1)) end"},
    "t as (select *, least(greatest(num_ticks % 7 + 2, 2), 8)::int as n, list(close) over (partition by series_id order by ts rows between 7 preceding and current row) as l from b)", "t",
)
on_bars(
    "ta_nested_ema", _chain(lambda b: ind.dema(b, "close", 8), lambda b: ind.tema(b, "close", 8), lambda b: ind.trix(b, "close", 8)),
    {"dema": "2 * e1.v - e2.v", "tema": "3 * e1.v - 3 * e2.v + e3.v", "trix": "100 * (e3.v - tr.v) / tr.v"},
    f"{ema_sql('e1', 'b', 'close', 8)},\n{ema_sql('e2', 'e1', 'v', 8)},\n{ema_sql('e3', 'e2', 'v', 8)},\ntr as (select series_id, pos, lag(v) over (partition by series_id order by pos) as v from e3)", joined("e1", "e2", "e3", "tr"),
)
_TYP = "(high + low + close) / 3"
on_bars(
    "ta_momentum",
    _chain(lambda b: ind.mom(b, "close"), lambda b: ind.roc(b, "close"), lambda b: ind.rocp(b, "close"), lambda b: ind.apo(b, "close"), lambda b: ind.ppo(b, "close"), ind.willr, ind.stochf, ind.cci, ind.bop),
    {
        "mom": f"close - {lag_sql('close', 10)}", "roc": f"100 * (close / {lag_sql('close', 10)} - 1)", "rocp": f"close / {lag_sql('close', 10)} - 1",
        "apo": f"{full_sql('avg(close)', 'close', 12)} - {full_sql('avg(close)', 'close', 26)}", "ppo": f"100 * (({full_sql('avg(close)', 'close', 12)} - {full_sql('avg(close)', 'close', 26)}) / {full_sql('avg(close)', 'close', 26)})",
        "willr": f"-100 * ({full_sql('max(high)', 'high', 14)} - close) / nullif({full_sql('max(high)', 'high', 14)} - {full_sql('min(low)', 'low', 14)}, 0)",
        "stochf_k": "k", "stochf_d": full_sql("avg(k)", "k", 3),
        "cci": "case when pos >= 14 then (p - list_avg(l)) / nullif(0.015 * list_avg(list_transform(l, lambda x: abs(x - list_avg(l)))), 0) end",
        "bop": "coalesce((close - open) / nullif(high - low, 0), 0)",
    },
    f"t as (select *, {_TYP} as p, list({_TYP}) over (partition by series_id order by ts rows between 13 preceding and current row) as l, 100 * (close - {full_sql('min(low)', 'low', 5)}) / nullif({full_sql('max(high)', 'high', 5)} - {full_sql('min(low)', 'low', 5)}, 0) as k from b)", "t",
)
on_bars(
    "ta_aroon_mfi_cmo", _chain(ind.aroon, ind.mfi, lambda b: ind.cmo(b, "close")),
    {"aroon_up": "up", "aroon_down": "down", "mfi": f"100 * {full_sql('sum(u)', 'u', 14)} / nullif({full_sql('sum(u)', 'u', 14)} + {full_sql('sum(d)', 'd', 14)}, 0)", "cmo": "2 * r - 100"},
    f"""{_RSI},
t1 as (select b.*, rs.v as r, {_TYP} as p, lag({_TYP}) over (partition by b.series_id order by b.ts) as q,
  case when pos > 14 then 100 * (14 - (pos - arg_max(pos, row(high, pos)) over (partition by b.series_id order by b.ts rows between 14 preceding and current row))) / 14.0 end as up,
  case when pos > 14 then 100 * (14 - (pos - arg_max(pos, row(-low, pos)) over (partition by b.series_id order by b.ts rows between 14 preceding and current row))) / 14.0 end as down from b join rs using (series_id, pos)),
t as (select * exclude (r), r, case when q is not null then case when p > q then p * base_asset_volume else 0 end end as u, case when q is not null then case when p < q then p * base_asset_volume else 0 end end as d from t1)""", "t",
)
_TR = f"case when {lag_sql('close')} is not null then greatest(high, {lag_sql('close')}) - least(low, {lag_sql('close')}) end"
_DX = f"""v1 as (select *, {_TR} as tr, high - {lag_sql("high")} as up, {lag_sql("low")} - low as dn from b),
v2 as (select *, case when up > dn and up > 0 then up when up is not null then 0 end as plus, case when dn > up and dn > 0 then dn when up is not null then 0 end as minus from v1),
{ema_sql("tt", "v2", "tr", 14, 1 / 14)},
{ema_sql("ap", "v2", "plus", 14, 1 / 14)},
{ema_sql("am", "v2", "minus", 14, 1 / 14)},
dx as (select tt.series_id, tt.pos, 100 * ap.v / tt.v as p, 100 * am.v / tt.v as m, case when tt.v is not null then coalesce(100 * abs(ap.v - am.v) / nullif(ap.v + am.v, 0), 0) end as v from tt join ap using (series_id, pos) join am using (series_id, pos)),
{ema_sql("ax", "dx", "v", 14, 1 / 14)}"""
on_bars(
    "ta_volatility_direction", _chain(ind.trange, ind.atr, ind.natr, ind.dx, ind.adx),
    {"trange": "v2.tr", "atr": "tt.v", "natr": "100 * tt.v / v2.close", "dx_plus": "dx.p", "dx_minus": "dx.m", "dx": "dx.v", "adx": "ax.v"}, _DX,
    "v2 join tt using (series_id, pos) join dx using (series_id, pos) join ax using (series_id, pos)",
)
on_bars(
    "ta_volume", _chain(ind.obv, ind.ad), {"obv": "sum(o) over (partition by series_id order by ts)", "ad": "sum(a) over (partition by series_id order by ts)"},
    f"t as (select *, coalesce(sign(close - {lag_sql('close')}) * base_asset_volume, base_asset_volume) as o, coalesce((2 * close - high - low) / nullif(high - low, 0), 0) * base_asset_volume as a from b)", "t",
)
on_bars(
    "ta_price", _chain(ind.avgprice, ind.medprice, ind.typprice, ind.wclprice, _MAKE("ADD", ["high", "low"]), _MAKE("SUB", ["high", "low"]), _MAKE("MULT", ["high", "low"]), _MAKE("DIV", ["high", "low"]), _MAKE("SQRT", "close"), _MAKE("LN", "close"), _MAKE("TANH", "close")),
    {"avgprice": "(open + high + low + close) / 4", "medprice": "(high + low) / 2", "typprice": _TYP, "wclprice": "(high + low + 2 * close) / 4", "add": "high + low", "sub": "high - low", "mult": "high * low", "div": "high / low", "sqrt": "sqrt(close)", "ln": "ln(close)", "tanh": "tanh(close)"},
)
_REGR = lambda f, n=14: f"case when pos >= {n} then {f}(close, pos::double) over (partition by series_id order by ts rows between {n - 1} preceding and current row) end"
on_bars(
    "ta_statistics", _chain(_MAKE("STDDEV", "close"), _MAKE("VAR", "close"), _MAKE("LINEARREG", "close"), _MAKE("LINEARREG_SLOPE", "close"), _MAKE("LINEARREG_INTERCEPT", "close"), _MAKE("TSF", "close"), _MAKE("CORREL", ["high", "low"]), _MAKE("MAX", "close"), _MAKE("MIN", "close"), _MAKE("SUM", "close")),
    {
        "stddev": full_sql("stddev_pop(close)", "close", 5), "var": full_sql("var_pop(close)", "close", 5),
        "linearreg": f"{full_sql('avg(close)', 'close', 14)} + 6.5 * {_REGR('regr_slope')}", "linearreg_slope": _REGR("regr_slope"), "linearreg_intercept": f"{full_sql('avg(close)', 'close', 14)} - 6.5 * {_REGR('regr_slope')}", "tsf": f"{full_sql('avg(close)', 'close', 14)} + 7.5 * {_REGR('regr_slope')}",
        "correl": full_sql("corr(high, low)", "high", 30), "max": full_sql("max(close)", "close", 30), "min": full_sql("min(close)", "close", 30), "sum": full_sql("sum(close)", "close", 30),
    },
)
on_bars(
    "ta_ratios_extremes",
    _chain(
        lambda b: ind.rocr(b, "close"), lambda b: ind.rocr100(b, "close"), ind.aroonosc, ind.ultosc, ind.stoch, _MAKE("LINEARREG_ANGLE", "close"), _MAKE("BETA", ["high", "low"]),
        _MAKE("MAXINDEX", "close"), _MAKE("MININDEX", "close"), _MAKE("MINMAX", "close"), _MAKE("MINMAXINDEX", "close", kw_args={"timeperiod": 10}),
    ),
    {
        "rocr": f"close / {lag_sql('close', 10)}", "rocr100": f"100 * close / {lag_sql('close', 10)}",
        "aroonosc": "case when pos > 14 then 100 * (arg_max(pos, row(high, pos)) over f15 - arg_max(pos, row(-low, pos)) over f15) / 14.0 end",
        "ultosc": "100 * (" + " + ".join(f"{k} * {full_sql('sum(bp)', 'bp', n)} / nullif({full_sql('sum(tr)', 'tr', n)}, 0)" for k, n in ((4, 7), (2, 14), (1, 28))) + ") / 7",
        "stoch_k": "sk", "stoch_d": full_sql("avg(sk)", "sk", 3), "linearreg_angle": f"degrees(atan({_REGR('regr_slope')}))",
        "beta": "case when pos > 5 then coalesce(case when isfinite(bs) then bs end, 0) end",
        "maxindex": "case when pos >= 30 then arg_max(pos, row(close, pos)) over f30 - 1 end", "minindex": "case when pos >= 30 then arg_max(pos, row(-close, pos)) over f30 - 1 end",
        "minmax_min": full_sql("min(close)", "close", 30), "minmax_max": full_sql("max(close)", "close", 30),
        "minmaxindex_min": "case when pos >= 10 then arg_max(pos, row(-close, pos)) over f10 - 1 end", "minmaxindex_max": "case when pos >= 10 then arg_max(pos, row(close, pos)) over f10 - 1 end",
    },
    f"""t1 as (select *, {_TR} as tr, case when {lag_sql("close")} is not null then close - least(low, {lag_sql("close")}) end as bp, high / {lag_sql("high")} - 1 as x, low / {lag_sql("low")} - 1 as y,
  100 * (close - {full_sql('min(low)', 'low', 5)}) / nullif({full_sql('max(high)', 'high', 5)} - {full_sql('min(low)', 'low', 5)}, 0) as k from b),
t as (select *, {full_sql("avg(k)", "k", 3)} as sk, regr_slope(y, x) over (partition by series_id order by ts rows between 4 preceding and current row) as bs from t1)""", "t",
    "window f10 as (partition by series_id order by ts rows between 9 preceding and current row), f15 as (partition by series_id order by ts rows between 14 preceding and current row), f30 as (partition by series_id order by ts rows between 29 preceding and current row)",
)
on_bars(
    "ta_direction_smoothed", _chain(ind.adxr, ind.plus_di, ind.minus_di, ind.plus_dm, ind.minus_dm),
    {"adxr": "xr.v", "plus_di": "dx.p", "minus_di": "dx.m", "plus_dm": "14 * ap.v", "minus_dm": "14 * am.v"},
    f"{_DX},\nxr as (select series_id, pos, (v + lag(v, 13) over (partition by series_id order by pos)) / 2 as v from ax)", joined("xr", "dx", "ap", "am"),
)
on_bars(
    "ta_stochrsi_macdfix", _chain(lambda b: ind.stochrsi(b, "close"), lambda b: ind.macdfix(b, "close")),
    {"stochrsi_k": "sr.k", "stochrsi_d": "sd.v", "macdfix": "case when mg.v is not null then mm.v end", "macdfix_signal": "mg.v", "macdfix_hist": "mm.v - mg.v"},
    f"""{_RSI},
sr as (select series_id, pos, 100 * (v - lo) / nullif(hi - lo, 0) as k from (select rs.series_id, rs.pos, v, case when count(v) over w = 5 then min(v) over w end as lo, case when count(v) over w = 5 then max(v) over w end as hi from rs window w as (partition by series_id order by pos rows between 4 preceding and current row))),
sd as (select series_id, pos, case when count(k) over w = 3 then avg(k) over w end as v from sr window w as (partition by series_id order by pos rows between 2 preceding and current row)),
{ema_sql("mf", "b", "close", 12, 0.15)},
{ema_sql("ms", "b", "close", 26, 0.075)},
mm as (select mf.series_id, mf.pos, mf.v - ms.v as v from mf join ms using (series_id, pos)),
{ema_sql("mg", "mm", "v", 9)}""", joined("sr", "sd", "mm", "mg"),
)
on_bars(
    "ta_t3_adosc", _chain(lambda b: ind.t3(b, "close"), ind.adosc),
    {"t3": "4.913 * e3.v - 6.069 * e4.v + 2.499 * e5.v - 0.343 * e6.v", "adosc": "case when b.pos >= 10 then af.v - al.v end"},
    ",\n".join(ema_sql(f"e{k}", f"e{k - 1}" if k > 1 else "b", "v" if k > 1 else "close", 5) for k in range(1, 7))
    + f",\nad as (select *, sum(coalesce((2 * close - high - low) / nullif(high - low, 0), 0) * base_asset_volume) over (partition by series_id order by ts) as a from b),\n{ema_sql('af', 'ad', 'a', 1, 0.5)},\n{ema_sql('al', 'ad', 'a', 1, 2 / 11)}",
    joined("e3", "e4", "e5", "e6", "af", "al"),
)
_MATHS = ("log10", "exp", "floor", "ceil", "sin", "cos", "tan", "sinh", "cosh", "atan", "asin", "acos")
on_bars(
    "ta_math", lambda b: _chain(*(_MAKE(n.upper(), "x") for n in _MATHS))(b.withColumn("x", F.col("close") / (F.col("close") + 2))), {n: f"{n}(close / (close + 2))" for n in _MATHS},
)
on_bars(
    "ta_patterns", _chain(ind.cdldoji, ind.cdlengulfing),
    {
        "cdldoji": "case when abs(close - open) <= 0.1 * case when count(high) over v = 10 then avg(high - low) over v end then 100 else 0 end",
        "cdlengulfing": "case when close > open and c1 < o1 and close >= o1 and open <= c1 and (close > o1 or open < c1) then 100 when close < open and c1 > o1 and open >= c1 and close <= o1 and (open > c1 or close < o1) then -100 else 0 end",
    },
    f"t as (select *, {lag_sql('open')} as o1, {lag_sql('close')} as c1 from b)", "t", "window v as (partition by series_id order by ts rows between 10 preceding and 1 preceding)", ints=("cdldoji", "cdlengulfing"),
)

# Labels

_VOL = f"""vr as (select *, arg_max(close, us) over (partition by series_id order by us range between unbounded preceding and 86400000001 preceding) as before from (select *, epoch_us(ts) as us from b)),
vx as (select *, close / before - 1 as ret from vr),
{ewm_sql("vv", "vx", "ret", 100)}"""
on_bars("daily_volatility", labels.daily_volatility, {"daily_vol": "vv.s"}, _VOL, joined("vv"))


def _barrier_sql(n: int, pt: float, sl: float, meta: bool) -> str:
    return f"""{_VOL},
p0 as (select b.*, vv.s as vol, {"case when num_buy_ticks * 2 >= num_ticks then 1 else -1 end" if meta else "1"} as side, lead(ts, {n}) over w as expiry, lead(close, {n}) over w as expiry_close, count(*) over (partition by series_id) as total
  from {joined("vv")} window w as (partition by series_id order by ts)),
p1 as (select a.series_id, a.pos, min(case when (c.close / a.close - 1) * a.side < -{sl} * a.vol then c.pos end) as stop, min(case when (c.close / a.close - 1) * a.side > {pt} * a.vol then c.pos end) as profit
  from p0 a join p0 c on a.series_id = c.series_id and c.pos >= a.pos and c.pos < least(a.pos + {n}, case when a.expiry is null then a.total else a.pos + {n} end) group by a.series_id, a.pos),
p2 as (select p0.*, p1.stop, p1.profit, least(p1.stop, p1.profit, case when expiry is not null then p0.pos + {n} end) as hit from p0 left join p1 using (series_id, pos)),
p3 as (select a.*, c.ts as end_ts, c.close / a.close - 1 as ret0 from p2 a left join p0 c on a.series_id = c.series_id and a.hit = c.pos),
p4 as (select *, case when vol is not null then ret0 {"* side" if meta else ""} end as ret, case when vol is not null then end_ts end as et from p3)"""


def _barriers(meta: bool, expiration: bool) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = hourly(spark, sf_dir)
        if meta:
            b = b.withColumn("side", F.when(F.col("num_buy_ticks") * 2 >= F.col("num_ticks"), 1).otherwise(-1))
        out = labels.triple_barrier(b, 8, 1.0, 1.0, metalabeling=meta, expiration_label=expiration)
        return out.select("series_id", "ts", "event_end_time", r("daily_vol").alias("daily_vol"), r("return").alias("return"), r("label").alias("label"))

    return run


for _name, _meta, _exp in (("triple_barrier", False, False), ("triple_barrier_meta", True, False), ("triple_barrier_expiration", False, True)):
    _label = "case when ret > 0 then 1 when ret < 0 then 0 end" if _meta else "sign(ret)"
    _label = f"case when ret is not null and stop is null and profit is null then 0 else {_label} end" if _exp else _label
    register(_name, _barriers(_meta, _exp), f'with {BARS},\n{_barrier_sql(8, 1.0, 1.0, _meta)}\nselect series_id, ts, et as event_end_time, {R("vol")} as daily_vol, {R("ret")} as "return", {R(_label)} as label from p4')

_TREND_LENGTHS = range(5, 20)
register(
    "trend_scanning",
    lambda s, d: labels.trend_scanning(hourly(s, d)).select("series_id", "ts", r("t_value").alias("t_value"), "event_end_time", r("return").alias("return"), r("label").alias("label")),
    f"""with {BARS}, t1 as (select a.series_id, a.pos, l.n, corr(c.close, c.pos::double) as r0 from b a cross join (select unnest(range(5, 20)) as n) l join b c on c.series_id = a.series_id and c.pos between a.pos and a.pos + l.n - 1 group by all having count(*) = l.n),
t2 as (select *, case when isnan(r0) then null else r0 end as r from t1),
t3 as (select *, case when 1 - r * r > 1e-12 then r * sqrt((n - 2) / (1 - r * r)) end as t from t2),
t4 as (select series_id, pos, arg_max(row(n, t, r), row(coalesce(abs(t), -1), -n)) as best from t3 group by all),
t5 as (select b.*, best[1] as n, best[2] as t, best[3] as r, count(*) over (partition by b.series_id) as total from b left join t4 using (series_id, pos))
select a.series_id, a.ts, case when a.pos + 19 <= a.total then {R("a.t")} end as t_value, case when a.pos + 19 <= a.total then c.ts end as event_end_time, case when a.pos + 19 <= a.total then {R("c.close / a.close - 1")} end as "return",
  case when a.pos + 19 <= a.total then {R("sign(coalesce(a.t, a.r))")} end as label from t5 a left join b c on c.series_id = a.series_id and c.pos = a.pos + a.n - 1""",
)

# Sampling, intervals, weights

register(
    "cusum_filter",
    lambda s, d: sampling.cusum_filter(hourly(s, d), 100.0),
    f"""with recursive {BARS}, s as (select series_id, pos, ts, close - {lag_sql("close")} as d from b),
c(series_id, pos, p, n, hit) as (
  select series_id, pos, 0.0::double, 0.0::double, false from s where pos = 1
  union all
  select s.series_id, s.pos, case when least(0, c.n + s.d) >= -100 and greatest(0, c.p + s.d) > 100 then 0 else greatest(0, c.p + s.d) end,
    case when least(0, c.n + s.d) < -100 then 0 else least(0, c.n + s.d) end, least(0, c.n + s.d) < -100 or greatest(0, c.p + s.d) > 100
  from c join s on s.series_id = c.series_id and s.pos = c.pos + 1)
select series_id, s.ts from c join s using (series_id, pos) where hit""",
)


def events_of(b: DataFrame, every: int = 3, length: int = 8) -> DataFrame:
    """Every third bar opens an event that ends eight bars later (fewer for later ones): overlapping intervals."""
    w = by_series()
    n = F.row_number().over(w)
    rows = b.select("series_id", F.col("ts").alias("start_ts"), F.lead("ts", length).over(w).alias("end_ts"), n.alias("n"))
    return rows.where((F.col("n") % every == 0) & F.col("end_ts").isNotNull()).drop("n")


_EVENTS = "ev as (select series_id, ts as start_ts, pos as a, lead(ts, 8) over (partition by series_id order by ts) as end_ts, pos + 8 as z from b qualify pos % 3 = 0 and lead(ts, 8) over (partition by series_id order by ts) is not null)"
_CONC = f"{_EVENTS}, co as (select b.series_id, b.pos, b.ts, count(*) filter (ev.a is not null) as c from b join (select series_id, min(a) as lo, max(z) as hi from ev group by series_id) m on m.series_id = b.series_id and b.pos between lo and hi left join ev on ev.series_id = b.series_id and b.pos between ev.a and ev.z group by all)"
register("concurrency", lambda s, d: (lambda b: sampling.concurrency(events_of(b), b).select("series_id", "ts", F.col("concurrency").cast("long").alias("concurrency")))(hourly(s, d)), f"with {BARS}, {_CONC} select series_id, ts, c::bigint as concurrency from co")


def _on_events(op: Callable[[DataFrame, DataFrame], DataFrame], out: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = hourly(spark, sf_dir)
        return op(events_of(b), b).select("series_id", "start_ts", "end_ts", r(out).alias(out))

    return run


_UNIQ = f"{_CONC}, un as (select ev.series_id, ev.start_ts, ev.end_ts, avg(1.0::double / c) as u from ev join co on co.series_id = ev.series_id and co.pos between ev.a and ev.z group by all)"
register("average_uniqueness", _on_events(sampling.average_uniqueness, "uniqueness"), f"with {BARS}, {_UNIQ} select series_id, start_ts, end_ts, {R('u')} as uniqueness from un")
register(
    "conditional_uniqueness", _on_events(lambda e, b: sampling.conditional_uniqueness(e, e.where(F.minute("start_ts") < 20), b), "uniqueness"),
    f"""with {BARS}, {_CONC}, k as (select co.series_id, co.pos, count(*) filter (ev.a is not null) as k from co left join ev on ev.series_id = co.series_id and co.pos between ev.a and ev.z and minute(ev.start_ts) < 20 group by all)
select ev.series_id, start_ts, end_ts, {R("avg(1.0::double / (1 + k))")} as uniqueness from ev join k on k.series_id = ev.series_id and k.pos between ev.a and ev.z group by ev.series_id, start_ts, end_ts""",
)
register(
    "weights_by_returns", _on_events(sampling.weights_by_returns, "weight"),
    f"with {BARS}, {_CONC}, x as (select co.*, ln(b.close) - ln(p.close) as d from co join b using (series_id, pos) left join b p on p.series_id = b.series_id and p.pos = b.pos - 1) select ev.series_id, start_ts, end_ts, {R('abs(coalesce(sum(d / c), 0))')} as weight from ev join x on x.series_id = ev.series_id and x.pos between ev.a and ev.z group by ev.series_id, start_ts, end_ts",
)
for _name, _c in (("weights_by_time_decay", 0.4), ("weights_by_time_decay_cut", -0.3)):
    _slope = f"(1 - {_c}) / l" if _c >= 0 else f"1 / ({_c + 1} * l)"
    register(
        _name, _on_events(lambda e, b, c=_c: sampling.weights_by_time_decay(e, b, c), "weight"),
        f"with {BARS}, {_UNIQ}, x as (select *, sum(u) over (partition by series_id order by start_ts) as cu, sum(u) over (partition by series_id) as l from un) select series_id, start_ts, end_ts, {R(f'greatest(0, 1 - ({_slope}) * l + ({_slope}) * cu)')} as weight from x",
    )


def _every_bar(name: str, run: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
    """The query ``name`` with an event at every bar; its own statement differs from the other one in that alone."""
    register(f"{name}_every_bar", lambda s, d: (lambda b: run(events_of(b, 1), b))(hourly(s, d)), ORACLES[name].replace("qualify pos % 3 = 0 and lead", "qualify lead"))


def _out(op: Callable[[DataFrame, DataFrame], DataFrame], out: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda e, b: op(e, b).select("series_id", "start_ts", "end_ts", r(out).alias(out))


_every_bar("concurrency", lambda e, b: sampling.concurrency(e, b).select("series_id", "ts", F.col("concurrency").cast("long").alias("concurrency")))
_every_bar("average_uniqueness", _out(sampling.average_uniqueness, "uniqueness"))
_every_bar("conditional_uniqueness", _out(lambda e, b: sampling.conditional_uniqueness(e, e.where(F.minute("start_ts") < 20), b), "uniqueness"))
_every_bar("weights_by_returns", _out(sampling.weights_by_returns, "weight"))
_every_bar("weights_by_time_decay", _out(lambda e, b: sampling.weights_by_time_decay(e, b, 0.4), "weight"))
_every_bar("weights_by_time_decay_cut", _out(lambda e, b: sampling.weights_by_time_decay(e, b, -0.3), "weight"))


def _numbered(b: DataFrame) -> DataFrame:
    """Bars with an interval each, as positions in their series: from the bar to the eighth after it."""
    n = F.row_number().over(by_series()).cast("long")
    return b.withColumn("event", n - 1).withColumn("start", n).withColumn("end", n + 8)


register("sequential_bootstrap", lambda s, d: ensemble.bootstrap_series(_numbered(hourly(s, d)), 4, 1.0, seed=7, update_every=5))

# Bet sizes

_PROB = "(0.5 + ((event_id * 7919) % 10007) / 20014.0)::double"
_BETS = f"bets as (select event_type as series_id, date_trunc('milliseconds', ts)::timestamp as ts, {_PROB} as prob, case event_id % 3 when 0 then -1 else 1 end as pred, case event_id % 2 when 0 then 1 else -1 end as side, case when event_id % 11 = 0 then null else date_trunc('milliseconds', ts)::timestamp + to_hours((event_id % 30 + 1)::int) end as event_end_time, event_id from events)"


def _bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ts = F.date_trunc("MILLISECOND", "ts").cast("timestamp_ntz")
    hours = F.make_dt_interval(F.lit(0), (F.col("event_id") % 30 + 1).cast("int"))
    return e.select(
        F.col("event_type").alias("series_id"), ts.alias("ts"), (0.5 + F.pmod(F.col("event_id") * 7919, F.lit(10007)) / 20014.0).alias("prob"),
        F.when(F.col("event_id") % 3 == 0, -1).otherwise(1).alias("pred"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(-1).alias("side"),
        F.when(F.col("event_id") % 11 != 0, ts + hours).alias("event_end_time"), "event_id",
    )


_SIZED = f"{_BETS}, z as (select *, (prob - 1.0::double / 2) / sqrt(prob * (1 - prob)) / sqrt(2) as z from bets), "


def _erf_sql() -> str:
    """erf(z) by its series of positive terms, summed over a list."""
    return "case when abs(z) > 6 then sign(z) else 2 / sqrt(pi()) * z * exp(-z * z) * (1 + list_sum(list_transform(range(1, 121), lambda n: exp(n * ln(2 * z * z + 1e-300) - list_sum(list_transform(range(1, n + 1), lambda j: ln(2 * j + 1)))))) ) end"


_M = f"{_SIZED}m as (select *, pred * ({_erf_sql()}) as m from z)"
register(
    "bet_sizes", lambda s, d: bet_sizing.bet_sizes(_bets(s, d), 2).select("event_id", r("bet_size").alias("bet_size")), f"with {_M} select event_id, {R('abs(m)')} as bet_size from m"
)
register(
    "bet_sizes_meta_discretised",
    lambda s, d: bet_sizing.bet_sizes(_bets(s, d), 2, meta_labeling=True, discretised=True, step_size=0.1).select("event_id", r("bet_size").alias("bet_size")),
    f"with {_M} select event_id, {R('abs(greatest(-1, least(1, round_even(round_even(m * side / 0.1, 0) * 0.1, 3))))')} as bet_size from m",
)
register(
    "bet_sizes_average_active",
    lambda s, d: bet_sizing.bet_sizes(_bets(s, d), 2, average=True).select("series_id", "ts", r("bet_size").alias("bet_size")),
    f"""with {_M}, t as (select series_id, ts as t from m union select series_id, event_end_time from m where event_end_time is not null)
select t.series_id, t as ts, {R("abs(coalesce(avg(m.m), 0))")} as bet_size from t left join m on m.series_id = t.series_id and m.ts <= t.t and (t.t < m.event_end_time or m.event_end_time is null) group by t.series_id, t""",
)

# Alignment


def _align(method: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = ticks(spark, sf_dir)
        keys = bars.time_bars(t, "day")
        return align.align_on(keys, hourly(spark, sf_dir).select("series_id", "ts", "close", "base_asset_volume"), method).select("series_id", "ts", r("close").alias("close"), r("base_asset_volume").alias("base_asset_volume"))

    return run


for _method, _agg in (("mean", "avg"), ("max", "max"), ("min", "min")):
    register(
        f"align_{_method}", _align(_method),
        f"""with {BARS}, keys as (select series_id, max(ts) as key, lag(max(ts)) over (partition by series_id order by max(ts)) as before from ticks group by series_id, date_trunc('day', ts)),
x as (select k.series_id, k.key as ts, {_agg}(b.close) as c, {_agg}(b.base_asset_volume) as v from keys k left join b on b.series_id = k.series_id and b.ts <= k.key and (k.before is null or b.ts > k.before) group by all)
select series_id, ts, {R("last_value(c ignore nulls) over w")} as close, {R("last_value(v ignore nulls) over w")} as base_asset_volume from x window w as (partition by series_id order by ts rows between unbounded preceding and current row)""",
    )

# Strategy with a rule model


def _strategy() -> StrategySignalPipeline:
    step = feature_union(lambda b: b.withColumn("fast", ind.full(F.col("close"), F.avg, 3, by_series())), lambda b: b.withColumn("slow", ind.full(F.col("close"), F.avg, 12, by_series())))

    def rule(df: DataFrame) -> DataFrame:
        crossed = technical.crossover(df, "fast", "slow", True, "side_pred")
        gap = F.least(F.abs(F.try_divide(F.col("fast"), F.col("slow")) - 1), F.lit(1.0))
        up, down = F.col("side_pred") == 1, F.col("side_pred") == -1
        top = (2 + gap) / 3
        rest = (1 - top) / 2
        return crossed.withColumn("probability", F.array(F.when(down, top).otherwise(rest), F.when(~up & ~down, top).otherwise(rest), F.when(up, top).otherwise(rest)))

    return StrategySignalPipeline({"bars": step}, rule)


def _trader() -> StrategyTrader:
    return StrategyTrader(_strategy(), profit_taking_factor=1.5, stop_loss_factor=1.0, num_expiration_bars=8)


_STRAT = f"""f as (select *, {full_sql("avg(close)", "close", 3)} as fast, {full_sql("avg(close)", "close", 12)} as slow from b),
f2 as (select * from f where slow is not null and fast is not null),
f3 as (select *, lag(fast) over (partition by series_id order by ts) as f1, lag(slow) over (partition by series_id order by ts) as s1 from f2),
f4 as (select *, case when f1 <= s1 and fast > slow then 1 when f1 >= s1 and fast < slow then -1 else 0 end as x from f3),
f5 as (select *, coalesce(last_value(nullif(x, 0) ignore nulls) over (partition by series_id order by ts rows between unbounded preceding and current row), 0) as side, (2 + least(abs(fast / slow - 1), 1)) / 3 as size from f4)"""
register(
    "strategy_signal",
    lambda s, d: _trader().create_signal({"bars": hourly(s, d)}).select("series_id", "ts", r("side").alias("side"), r("size").alias("size"), "strategy_valid"),
    f"with {BARS}, {_STRAT} select series_id, ts, {R('side')} as side, {R('size')} as size, side between -1 and 1 and size between 0 and 1 as strategy_valid from f5",
)
register(
    "strategy_position",
    lambda s, d: _trader().create_position({"bars": hourly(s, d)}).select("series_id", "ts", r("side").alias("side"), r("size").alias("size"), r("stop_loss").alias("stop_loss"), r("profit_taking").alias("profit_taking"), "num_expiration_bars"),
    f"with {BARS}, {_STRAT}, {_VOL} select b.series_id, b.ts, {R('side')} as side, {R('size')} as size, {R('vv.s * 1.0')} as stop_loss, {R('vv.s * 1.5')} as profit_taking, 8::int as num_expiration_bars from {joined('vv')} left join f5 on f5.series_id = b.series_id and f5.ts = b.ts",
)

# Cross-validation

_CV = validation.CombPurgedKFold(6, 2, 3 * 3_600_000_000)


def _cv_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples_of(hourly(spark, sf_dir).where(F.col("series_id") == "view"))


def _samples_of(b: DataFrame) -> DataFrame:
    return b.select(F.col("ts").alias("pred_time"), (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(5))).alias("eval_time"))


def _cv_sql(cv: validation.CombPurgedKFold = _CV) -> str:
    rounds = ", ".join(f"({k}, {list(c)})" for k, c in enumerate(cv.rounds()))
    return f"""with {BARS}, s as (select row_number() over (order by ts) - 1 as pos, ts as p, ts + interval 5 hour as e, count(*) over () as n, ntile({cv.n_groups}) over (order by ts) - 1 as f from b where series_id = 'view'),
r(round, fs) as (values {rounds}),
t as (select r.round, s.pos, s.p, s.e, s.n, list_contains(fs, s.f) as test from r, s),
m as (select *, lag(test, 1, false) over (partition by round order by pos) as before, row_number() over (partition by round, test order by pos) as nth from t),
starts as (select round, pos as a, p as first_pred, row_number() over (partition by round order by pos) as k from m where test and not before),
ends as (select round, pos as z, row_number() over (partition by round order by pos) as k from (select *, lead(test, 1, false) over (partition by round order by pos) as next from t) where test and not next),
blocks as (select round, a, z + 1 as z, first_pred from starts join ends using (round, k)),
last as (select b.round, b.a, b.z, b.first_pred, max(m.e) + interval {cv.embargo_micros // 3_600_000_000} hour as last from blocks b join m on m.round = b.round and m.test and m.nth <= b.z group by all),
cut as (select l.round, l.a, l.z, l.first_pred, count(*) as m from last l join s on s.p <= l.last group by all),
ok as (select t.round, t.pos, bool_and((t.pos < c.a and t.e < c.first_pred) or (t.pos >= c.z and (c.m >= t.n or t.pos >= c.m))) as ok, any_value(t.test) as test from t join cut c using (round) group by t.round, t.pos)
select round::int as round, pos::int as pos, case when test then 'test' else 'train' end as role from ok where test or ok"""


register("cv_split", lambda s, d: _CV.split(_cv_samples(s, d)).select(F.col("round").cast("int").alias("round"), F.col("pos").cast("int").alias("pos"), "role"), _cv_sql())


_CV_PATHS = validation.CombPurgedKFold(4, 2)


def _cv_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths_of(hourly(spark, sf_dir).where(F.col("series_id") == "view"))


def _paths_of(b: DataFrame) -> DataFrame:
    return _path_rows(b).groupBy("path").agg(F.count(F.lit(1)).alias("rows"))


def _path_rows(b: DataFrame) -> DataFrame:
    b = b.select(F.col("ts").alias("pred_time"), (F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(5))).alias("eval_time"), "close")

    def fit(train: DataFrame) -> Callable[[DataFrame], DataFrame]:
        mean = train.agg(F.avg("close").alias("prediction"))
        return lambda rows: rows.join(F.broadcast(mean)).select("pos", "close", "prediction")  # one row

    return validation.cross_validation_paths(_CV_PATHS, b, fit)


register("cv_paths", _cv_paths, f"with {BARS} select p::int as path, (select count(*) from b where series_id = 'view')::bigint as rows from range(3) t(p)")

# The same over the bars of all series in one order


def _cv_paths_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths_of(hourly(spark, sf_dir))


register(
    "cv_split_all_series",
    lambda s, d: _CV.split(_samples_of(hourly(s, d))).select(F.col("round").cast("int").alias("round"), F.col("pos").cast("int").alias("pos"), "role"),
    ORACLES["cv_split"].replace("from b where series_id = 'view'", "from b"),
)
register("cv_paths_all_series", _cv_paths_all, ORACLES["cv_paths"].replace("from b where series_id = 'view'", "from b"))

_PATH_MEANS = f"""{_cv_sql(_CV_PATHS).replace("from b where series_id = 'view'", "from b").replace("s as (select row_number()", "s as (select close, row_number()").rsplit("select round::int", 1)[0].rstrip()},
mean as (select ok.round, avg(s.close) as prediction from ok join s using (pos) where not ok.test and ok.ok group by ok.round),
dealt(round, fold, path) as (values {", ".join(map(str, validation.dealt_paths(_CV_PATHS)))})
select path::int as path, s.pos::int as pos, fold::int as fold, {R("prediction")} as prediction from dealt join mean using (round) join s on s.f = dealt.fold"""
register("cv_path_predictions", lambda s, d: _path_rows(hourly(s, d)).select("path", F.col("pos").cast("int").alias("pos"), "fold", r("prediction").alias("prediction")), _PATH_MEANS)

# Ensemble


def _bagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    ahead = F.lead("close", 8).over(by_series())
    b = _numbered(hourly(spark, sf_dir)).withColumn("label", (ahead > F.col("close")).cast("double"))
    rows = b.select("series_id", "event", "start", "end", "close", "base_asset_volume", "num_ticks", "label").na.drop()  # the last eight have no label
    model = ensemble.SequentiallyBootstrappedBagging(["close", "base_asset_volume", "num_ticks"], n_estimators=3, max_samples=0.5, max_features=2, update_every=10)
    return model.fit(rows, rows).predict_proba(rows).select("series_id", "event", "label", "probability", "prediction")


register("sequential_bagging", _bagging)

# Structural breaks

_CSW = f"""q as (select *, close - {lag_sql("close")} as d from b),
q2 as (select *, sum(d * d) over (partition by series_id order by ts) / nullif(pos - 1, 0) as s2 from q),
q3 as (select a.series_id, a.ts, a.pos, c.pos as n, abs(a.close - c.close) / sqrt(nullif(a.s2, 0) * (a.pos - c.pos)) as s from q2 a join q2 c on a.series_id = c.series_id and c.pos < a.pos),
q4 as (select series_id, ts, pos, max(s) as s, arg_max(n, row(s, -n)) filter (s is not null) as n from q3 group by all)"""
register(
    "chu_stinchcombe_white",
    lambda s, d: breaks.chu_stinchcombe_white(hourly(s, d)).select("series_id", "ts", r("statistic").alias("statistic"), r("critical_value").alias("critical_value")),
    f"with {BARS}, {_CSW} select series_id, ts, {R('s')} as statistic, case when s is not null then {R('sqrt(4.6 + ln(pos - n))')} end as critical_value from q4",
)
register(
    "dickey_fuller_chow",
    lambda s, d: breaks.dickey_fuller_chow(hourly(s, d)).select("series_id", "ts", r("statistic").alias("statistic")),
    f"""with {BARS}, x as (select *, {lag_sql("close")} as x, close - {lag_sql("close")} as d, count(*) over (partition by series_id) as n from b),
y as (select *, sum(d * x) over w as sxy, sum(x * x) over w as sxx, sum(d * d) over (partition by series_id) as syy from x window w as (partition by series_id order by ts rows between 1 following and unbounded following))
select series_id, ts, {R("(sxy / sxx) / sqrt((syy - sxy / sxx * sxy) / (n - 2) / sxx)")} as statistic from y where pos - 1 >= 20 and pos - 1 < n - 20""",
)
for _model in breaks.MODELS:
    register(f"sup_adf_{_model}", lambda s, d, m=_model: breaks.sup_adf(hourly(s, d), m, 1, 50, True, 0.5).select("series_id", "ts", r("statistic").alias("statistic")))
