"""Scenarios with known outcomes and plain recomputations."""

from __future__ import annotations

import math
from datetime import datetime

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.functions import indicators as ind
from barloom.functions.windows import decayed_sum, erf, ewm, totals_before
from barloom.operators import align, bars, bet_sizing, breaks, ensemble, labels, microstructure, rolling, sampling, technical, validation
from barloom.plans.strategy import StrategySignalPipeline, StrategyTrader
from barloom.schema import require_columns


def frame(spark, start="2018-01-01", freq="D", **columns):
    n = len(next(iter(columns.values())))
    df = pd.DataFrame({"series_id": "a", "ts": pd.date_range(start, periods=n, freq=freq), **columns})
    out = spark.createDataFrame(df)
    out = out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    for c, kind in out.dtypes:  # NaN is missing
        if kind == "double":
            out = out.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    return out


def values(df, column):
    return [r[column] for r in df.orderBy("series_id", "ts").select("series_id", "ts", column).collect()]


def test_required_columns(spark):
    with pytest.raises(AssertionError, match="missing"):
        require_columns(spark.range(1), "id", "close")


def test_z_score_series(spark):
    x = [1.0, 3.0, 24.0, 5.0, 31.0, 32.0, 5.0]
    got = values(rolling.rolling_z_score(frame(spark, x=x), 3, lambda: F.col("x")), "z_score")
    s = pd.Series(x)
    want = ((s - s.rolling(3).mean()) / s.rolling(3).std()).tolist()
    assert got[:2] == [None, None]
    assert np.allclose(got[2:], want[2:])
    with pytest.raises(KeyError):
        rolling.z_score_transformer("nothing", 3)


def test_roll_measure_by_hand(spark):
    rng = np.random.default_rng(1)
    close = 100 + rng.standard_normal(60).cumsum()
    got = values(microstructure.roll_measure(frame(spark, close=close), 10), "roll_measure")
    d = pd.Series(close).diff()
    want = 2 * np.sqrt(d.rolling(10).cov(d.shift()).abs())
    assert sum(v is None for v in got) == 11
    assert np.allclose(got[11:], want[11:])


def test_vpin_zero_volume(spark):
    buy, sell = np.ones(60) * 3.0, np.ones(60)
    buy[20:40] = sell[20:40] = 0
    df = frame(spark, base_asset_buy_volume=buy, base_asset_sell_volume=sell, base_asset_volume=buy + sell)
    got = values(microstructure.vpin(df, 5), "vpin")
    assert got[:4] == [None] * 4
    assert got[25:40] == [0.0] * 15
    assert got[10] == 0.5


@pytest.mark.parametrize("span", [3, 10, 100])
def test_ewm_equals_pandas(spark, span):
    rng = np.random.default_rng(span)
    x = rng.standard_normal(300)
    x[[0, 1, 50, 51, 200]] = np.nan
    df = ewm(ewm(frame(spark, x=x), "m", "x", span), "s", "x", span, std=True)
    s = pd.Series(x).ewm(span=span)
    assert np.allclose(np.array(values(df, "m"), float), s.mean(), equal_nan=True)
    assert np.allclose(np.array(values(df, "s"), float), s.std(), equal_nan=True)


def test_decayed_sum_over_many_blocks(spark):
    x = np.random.default_rng(2).standard_normal(3000)
    got = values(decayed_sum(frame(spark, freq="min", x=x), "y", F.col("x"), 0.3), "y")
    y, want = 0.0, []
    for v in x:
        y = 0.3 * y + v
        want.append(y)
    assert np.allclose(got, want, atol=1e-12)


def test_erf(spark):
    rows = spark.createDataFrame([(float(x),) for x in np.linspace(-8, 8, 81)], "x double").select("x", erf(F.col("x")).alias("y")).collect()
    assert all(abs(r.y - math.erf(r.x)) < 1e-14 for r in rows)


def test_crossovers(spark):
    fast, slow = [1.0, 1, 1, 1, 2, 3, 3, 4], [2.0, 2, 2, 2, 1, 1, 2, 2]
    assert values(technical.crossover(frame(spark, f=fast, s=slow), "f", "s"), "crossover") == [0, 0, 0, 0, 1, 0, 0, 0]
    assert values(technical.crossover(frame(spark, f=slow, s=fast), "f", "s"), "crossover") == [0, 0, 0, 0, -1, 0, 0, 0]
    assert values(technical.crossover(frame(spark, f=fast, s=slow), "f", "s", True), "crossover") == [0, 0, 0, 0, 1, 1, 1, 1]
    with pytest.raises(ValueError):
        technical.moving_average_crossover(frame(spark, close=fast), 5, 2)


def test_sma_ramp_and_ema_warm_up(spark):
    df = frame(spark, close=np.arange(50.0))
    assert values(ind.sma(df, "close", 5), "sma") == [None] * 4 + [k - 2.0 for k in range(4, 50)]
    assert sum(v is None for v in values(ind.ema(df, "close", 7), "ema")) == 6


def test_factory(spark):
    f = ind.IndicatorFactory()
    assert "SMA" in f.get_functions() and "SMA" in f.get_function_groups()["Overlap Studies"]
    assert f.get_args_kwargs("SMA") == (["real"], {"timeperiod": 30})
    df = frame(spark, close=np.arange(40.0), open=np.arange(40.0), high=np.arange(40.0) + 2, low=np.arange(40.0) - 1, base_asset_volume=np.ones(40), periods=np.full(40, 5.0))
    for bad in (lambda: f.get_ta_func("NOPE"), lambda: f.create_transformer("SMA"), lambda: f.create_transformer("ADD", ["high"]), lambda: f.create_transformer("SMA", "close", kw_args={"no": 1}), lambda: f.create_transformer("SMA", "gone")(df)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        f.create_transformer("SMA", "close", col_to_transform_mapping=3)
    with pytest.raises(TypeError):
        f.create_transformer("SMA", "close")(pd.DataFrame())
    for name in f.get_functions():  # every indicator runs
        columns, _ = f.get_args_kwargs(name)
        mapping = {"periods": "periods"} if "periods" in columns else None
        step = f.create_transformer(name, ["high", "low"] if "real0" in columns else "close", mapping)
        assert len(step(df).columns) > len(df.columns)


@pytest.mark.parametrize("day", [15, 60])
@pytest.mark.parametrize("sign", [1, -1])
def test_triple_barrier_price_spike(spark, day, sign):
    close = np.full(120, 10.0)
    close[day] *= 1 + sign * 0.5
    n = 7
    out = labels.triple_barrier(frame(spark, close=close), n, 1.0, 1.0)
    got = values(out, "label")
    assert all(v is None for v in got[:3])
    assert got[day] == -sign
    assert sum(v == sign for v in got) == min(n, day - 3)


def test_metalabels(spark):
    close = 10 + np.sin(np.arange(120) / 5)
    right = np.sign(np.roll(close, -5) - close)
    for side, want in ((right, 1.0), (-right, 0.0)):
        out = labels.triple_barrier(frame(spark, close=close, side=side), 5, 0.0, 0.0, metalabeling=True)
        got = [v for v in values(out, "label")[10:110] if v is not None]
        assert got and set(got) == {want}


def test_barrier_factors(spark):
    with pytest.raises(ValueError):
        labels.triple_barrier(frame(spark, close=np.arange(1.0, 20)), 3, -1.0, -1.0)


@pytest.mark.parametrize("kind, sign", [("up", 1), ("down", -1)])
def test_trend_scanning(spark, kind, sign):
    close = np.linspace(1, 100, 150) ** 2 if kind == "up" else 1 / np.linspace(0.1, 10, 150) ** 2
    out = labels.trend_scanning(frame(spark, close=close), 20, 5)
    got = values(out, "label")
    assert sum(v is None for v in got) == 19
    assert {v for v in got if v is not None} == {float(sign)}


def test_trend_of_a_perfect_line_has_no_t(spark):
    out = labels.trend_scanning(frame(spark, close=np.arange(40.0) + 1), 10, 5).orderBy("ts").first()
    assert out["t_value"] is None and out["label"] == 1.0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-30, 30), min_size=2, max_size=60), st.integers(5, 40))
def test_cusum_filter_equals_loop(spark, steps, threshold):
    close = np.cumsum(np.array(steps, float))
    df = frame(spark, close=close)
    got = {r.ts for r in sampling.cusum_filter(df, float(threshold)).collect()}
    up = down = 0.0
    want = set()
    for t, d in zip(pd.date_range("2018-01-01", periods=len(close))[1:], np.diff(close), strict=True):
        up, down = max(0.0, up + d), min(0.0, down + d)
        if down < -threshold:
            down = 0.0
            want.add(t.to_pydatetime())
        elif up > threshold:
            up = 0.0
            want.add(t.to_pydatetime())
    assert got == want


def _events(spark, pairs, n):
    t = pd.date_range("2020-01-01", periods=n)
    ev = spark.createDataFrame(pd.DataFrame({"series_id": "a", "start_ts": [t[a] for a, _ in pairs], "end_ts": [t[b] for _, b in pairs]}))
    ev = ev.withColumn("start_ts", F.col("start_ts").cast("timestamp_ntz")).withColumn("end_ts", F.col("end_ts").cast("timestamp_ntz"))
    return ev, frame(spark, "2020-01-01", close=np.exp(np.arange(n) / 10.0))


def test_uniqueness_by_matrix(spark):
    pairs, n = [(0, 1), (2, 5), (5, 7), (7, 8)], 9
    ev, bars = _events(spark, pairs, n)
    c = np.zeros(n)
    for a, b in pairs:
        c[a : b + 1] += 1
    want = [np.mean(1 / c[a : b + 1]) for a, b in pairs]
    got = [r.uniqueness for r in sampling.average_uniqueness(ev, bars).orderBy("start_ts").collect()]
    assert np.allclose(got, want)
    w = [r.weight for r in sampling.weights_by_returns(ev, bars).orderBy("start_ts").collect()]
    d = np.concatenate(([0], np.full(n - 1, 0.1)))
    assert np.allclose(w, [abs((d[a : b + 1] / c[a : b + 1]).sum()) for a, b in pairs])
    decay = [r.weight for r in sampling.weights_by_time_decay(ev, bars, 0.5).orderBy("start_ts").collect()]
    assert decay[-1] == pytest.approx(1) and sorted(decay) == decay
    with pytest.raises(AssertionError):
        sampling.weights_by_time_decay(ev, bars, 1.5)


def test_conditional_uniqueness(spark):
    pairs = [(0, 1), (2, 5), (5, 7), (7, 8)]
    ev, bars = _events(spark, pairs, 9)
    once = ev.orderBy("start_ts").limit(1)
    got = [r.uniqueness for r in sampling.conditional_uniqueness(ev, once, bars).orderBy("start_ts").collect()]
    twice = [r.uniqueness for r in sampling.conditional_uniqueness(ev, once.union(once), bars).orderBy("start_ts").collect()]
    assert got[2] == 1 and got[0] == 0.5 and twice[0] == pytest.approx(1 / 3)
    start, end = (np.array(x) for x in zip(*pairs, strict=True))
    assert np.allclose(ensemble.update_uniqueness(start, end, np.array([0]), 9), got)
    drawn = ensemble.sequential_bootstrap(start, end, 4, np.random.default_rng(0))
    assert len(drawn) == 4 and set(drawn) <= {0, 1, 2, 3}


def test_average_active_bets(spark):
    t = pd.date_range("2000-01-01", periods=12)
    ends = [t[k] + pd.Timedelta(days=x) if k < 10 else None for k, x in enumerate([0.5, 1, 2, 1.5, 0.8, 0.2] * 2)]
    size = np.linspace(-1, 1, 12)
    df = frame(spark, "2000-01-01", bet_size=size, event_end_time=pd.Series(ends))
    df = df.withColumn("event_end_time", F.col("event_end_time").cast("timestamp_ntz"))
    got = {r.ts: r.average_bet for r in bet_sizing.average_active(df).collect()}
    for at in set(t) | {e for e in ends if e is not None}:
        live = [m for s, e, m in zip(t, ends, size, strict=True) if s <= at and (e is None or at < e)]
        assert got[at.to_pydatetime()] == pytest.approx(np.mean(live) if live else 0)


def test_discretise(spark):
    x = np.linspace(-1, 1, 41)
    rows = spark.createDataFrame([(float(v),) for v in x], "x double").select(bet_sizing.discretise(F.col("x"), 0.25).alias("y")).collect()
    assert [r.y for r in rows] == [max(-1, min(1, round(round(v / 0.25) * 0.25, 3))) for v in x]
    with pytest.raises(AssertionError):
        bet_sizing.discretise(F.col("x"), 1.5)


@pytest.mark.parametrize("method, want", [("mean", 2.0), ("max", 3.0), ("min", 1.0)])
def test_align(spark, method, want):
    keys = frame(spark, "2020-01-02", k=[1.0])
    feats = frame(spark, "2020-01-01 00:01:00", "12h", x=[1.0, 3.0])
    assert values(align.align_on(keys, feats, method), "x") == [want]
    filled = align.align_on(frame(spark, "2020-01-01", "12h", k=[1.0, 1.0]), frame(spark, "2020-01-01", x=[5.0]))
    assert values(filled, "x") == [5.0, 5.0]


def test_cv_folds_and_merging():
    assert validation.merge_folds([(2, 4), (4, 6), (8, 10)]) == [(2, 6), (8, 10)]
    assert [b - a for a, b in validation.CombPurgedKFold(4, 2).bounds(21)] == [6, 5, 5, 5]
    assert validation.back_test_paths(6, 2) == 5
    with pytest.raises(ValueError):
        validation.CombPurgedKFold(4, 4)


def test_cv_rounds_of_uneven_times(spark):
    t = sorted([*pd.date_range("2000-01-01", periods=11, freq="2h"), *pd.date_range("2000-01-01", periods=10, freq="59min")])
    df = spark.createDataFrame(pd.DataFrame({"pred_time": t, "eval_time": [x + pd.Timedelta(hours=1) for x in t]}))
    rows = validation.CombPurgedKFold(4, 2).split(df).collect()
    pick = lambda r, role: sorted(x.pos for x in rows if x.round == r and x.role == role)
    assert pick(2, "test") == list(range(6, 16)) and pick(2, "train") == [*range(5), *range(16, 21)]
    assert pick(3, "test") == [*range(6), *range(16, 21)] and pick(3, "train") == list(range(7, 16))
    for r in range(6):
        test, train = pick(r, "test"), pick(r, "train")
        assert not set(test) & set(train)
        for p in train:  # no kept sample reaches into a test sample that follows it
            assert all(t[p] + pd.Timedelta(hours=1) < t[q] for q in test if q > p)


def test_csw_and_chow_by_loops(spark):
    y = np.random.default_rng(3).standard_normal(40).cumsum() + 50
    got = {r.ts: r for r in breaks.chu_stinchcombe_white(frame(spark, close=y)).collect()}
    assert len(got) == 39
    t = 20
    s2 = (np.diff(y[: t + 1]) ** 2).sum() / t
    stat = [abs(y[t] - y[n]) / math.sqrt(s2 * (t - n)) for n in range(t)]
    row = got[pd.date_range("2018-01-01", periods=40)[t].to_pydatetime()]
    assert row.statistic == pytest.approx(max(stat))
    assert row.critical_value == pytest.approx(math.sqrt(4.6 + math.log(t - int(np.argmax(stat)))))
    rows = breaks.dickey_fuller_chow(frame(spark, close=y), 10).orderBy("ts").collect()
    assert len(rows) == 20
    d, x, k = np.diff(y), y[:-1].copy(), 10
    x[:k] = 0
    b = (d * x).sum() / (x * x).sum()
    e = d - b * x
    assert rows[0].statistic == pytest.approx(b / math.sqrt((e @ e) / (len(d) - 1) / (x * x).sum()))


@pytest.mark.parametrize("model", breaks.MODELS)
def test_sup_adf_by_regressions(spark, model):
    y = np.random.default_rng(4).standard_normal(40).cumsum() + 50
    rows = breaks.sup_adf(frame(spark, close=y), model, 1, 15, True, 0.5, blocks=3).orderBy("ts").collect()
    x, target, tested, lost = breaks.design(y, model, 1, True)
    assert len(rows) == len(target) - 15 == (25 if model.startswith("sm_") else 23)
    end, best = len(target) - 1, -np.inf
    for start in range(end - 14 + 1):
        a, b = x[start : end + 1], target[start : end + 1]
        coef, *_ = np.linalg.lstsq(a, b, rcond=None)
        e = b - a @ coef
        se = math.sqrt(e @ e / (len(b) - a.shape[1]) * np.linalg.inv(a.T @ a)[tested, tested])
        tval = coef[tested] / se
        best = max(best, abs(tval) / (start + 1) ** 0.5 if model.startswith("sm_") else tval)
    assert rows[-1].statistic == pytest.approx(best, rel=1e-4)


def test_break_arguments(spark):
    df = frame(spark, close=np.arange(30.0))
    with pytest.raises(ValueError):
        breaks.sup_adf(df, "other")
    with pytest.warns(UserWarning):
        bare = breaks.sup_adf(df, "sm_exp", 1, 15, False)
    assert bare.count() == 15 and bare.collect() == breaks.sup_adf(df, "sm_exp", 1, 15, True).collect()
    with pytest.raises(AssertionError):
        breaks.sup_adf(df, phi=2)
    with pytest.raises(AssertionError):
        breaks.sup_adf(df, lags=[1, 30], min_length=20)
    with pytest.raises(ValueError):
        breaks.chu_stinchcombe_white(df, "sideways")


def test_bagging_learns_a_perfect_feature(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(100) > 0.5).astype(float)
    rows = spark.createDataFrame(pd.DataFrame({"event": range(100), "good": y, "noise": rng.random(100), "label": y}))
    where = pd.DataFrame({"start": range(100), "end": [k + 3 for k in range(100)]})
    model = ensemble.SequentiallyBootstrappedBagging(["good"], n_estimators=2, max_samples=0.8, update_every=20, oob_score=True).fit(rows, where)
    assert model.predict_proba(rows).where("prediction <> label").count() == 0
    assert model.oob_accuracy == 1.0
    for bad in ({"n_estimators": 0}, {"max_samples": 1.5}, {"max_features": 0}, {"warm_start": True, "oob_score": True}):
        with pytest.raises(ValueError):
            ensemble.SequentiallyBootstrappedBagging(["good"], **bad).fit(rows, where)


def test_strategy_needs_matching_frames(spark):
    pipe = StrategySignalPipeline({"bars": lambda df: df}, lambda df: df)
    with pytest.raises(AssertionError):
        pipe.transform({"other": frame(spark, close=[1.0])})
    trader = StrategyTrader(pipe, volatility_adjusted=False, profit_taking_factor=2.0, stop_loss_factor=1.0, num_expiration_bars=4)
    row = trader.create_strategy_bars(frame(spark, close=[1.0, 2.0])).first()
    assert (row.stop_loss, row.profit_taking, row.num_expiration_bars) == (1.0, 2.0, 4)
    assert trader.determine_positions_to_close({}) is None
    trader.closing_positions_model = lambda frames: "all"
    assert trader.determine_positions_to_close({}) == "all"


def test_metalabel_pipeline(spark):
    close = 10 + np.sin(np.arange(60) / 5)
    bars = frame(spark, close=close)

    def primary(df):
        return df.withColumn("side_pred", F.when(F.col("close") > 10, 1.0).otherwise(-1.0)).withColumn("probability", F.array(F.lit(0.2), F.lit(0.1), F.lit(0.7)))

    def meta(df):
        return df.withColumn("meta_proba", F.when(F.col("primary_side_pred") > 0, 0.8).otherwise(0.4))

    pick = lambda df: df.select("series_id", "ts", "close")
    pipe = StrategySignalPipeline({"bars": pick}, primary, metalabel_features={"bars": pick}, metalabel=meta, use_probabilities=True)
    rows = pipe.get_side_and_size({"bars": bars}).collect()
    assert len(rows) == 60 and {r["size"] for r in rows} == {0.8, 0.4}
    y = bars.select("series_id", "ts", F.when(F.col("close") > 10, 1.0).otherwise(-1.0).alias("label"))
    data = pipe.dataset_metalabeling({"bars": bars}, y)
    assert {r.y_meta for r in data.collect()} == {1.0} and "primary_side_pred_proba_2" in data.columns
    assert pipe.dataset_primary({"bars": bars}, y).count() == 60


def test_one_sort_for_an_operator(spark):
    plan = microstructure.vpin(frame(spark, base_asset_buy_volume=[1.0], base_asset_sell_volume=[1.0], base_asset_volume=[2.0]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    assert "Python" not in plan and "Pandas" not in plan


def test_align_keeps_columns_of_its_own_names(spark):
    keys = spark.createDataFrame([("a", 10), ("a", 10), ("a", 20), ("b", 5)], "series_id string, ts int")
    rows = spark.createDataFrame([("a", 3, 1.0, 7), ("a", 10, 3.0, 8), ("a", 11, 5.0, 9), ("a", 25, 9.0, 9), ("b", 6, 1.0, 1)], "series_id string, ts int, __key double, __row int")
    got = {(r.series_id, r.ts): (r["__key"], r["__row"]) for r in align.align_on(keys, rows, "max").collect()}
    assert got == {("a", 10): (3.0, 8), ("a", 20): (5.0, 9), ("b", 5): (None, None)}
    assert align.align_on(keys.limit(0), rows).count() == 0 and align.align_on(keys, rows.limit(0)).count() == 3


def test_events_need_both_ends(spark):
    bars = spark.createDataFrame([("a", datetime(2024, 1, d), 1.0) for d in (1, 2, 3)], "series_id string, ts timestamp_ntz, close double")
    kind = "series_id string, start_ts timestamp_ntz, end_ts timestamp_ntz"
    for start, end in ((1, None), (None, 2), (3, 1)):
        day = lambda d: d and datetime(2024, 1, d)
        events = spark.createDataFrame([("a", datetime(2024, 1, 1), datetime(2024, 1, 2)), ("a", day(start), day(end))], kind)
        with pytest.raises(Exception, match="needs a start and an end"):
            sampling.average_uniqueness(events, bars).collect()
    none = spark.createDataFrame([], kind)
    assert sampling.average_uniqueness(none, bars).count() == 0


def test_trader_refuses_repeated_keys(spark):
    day = lambda d: datetime(2024, 1, d)
    kind = "series_id string, ts timestamp_ntz, close double"
    rule = lambda df: df.withColumn("side_pred", F.lit(1)).withColumn("probability", F.array(F.lit(0.2), F.lit(0.8)))
    trader = StrategyTrader(StrategySignalPipeline({"bars": lambda df: df}, rule))
    fine = spark.createDataFrame([("a", day(1), 1.0), ("a", day(2), 1.0), ("b", day(1), 1.0)], kind)
    assert trader.create_signal({"bars": fine}).count() == 3
    with pytest.raises(Exception, match="repeated keys"):
        trader.create_signal({"bars": fine.union(fine)}).collect()


def test_frames_must_meet_and_metalabels_have_no_nulls(spark):
    day = lambda d: datetime(2024, 1, d)
    kind = "series_id string, ts timestamp_ntz, {} double"
    lead = spark.createDataFrame([("a", day(d), 1.0) for d in range(10, 20)], kind.format("x"))
    before = spark.createDataFrame([("a", day(2), 1.0)], kind.format("y"))
    late = spark.createDataFrame([("a", day(d), 1.0) for d in range(15, 20)], kind.format("y"))
    same = lambda df: df
    rule = lambda df: df.withColumn("side_pred", F.when(F.dayofmonth("ts") != 17, 1.0))
    pipe = StrategySignalPipeline({"x": same, "y": same}, rule, align_on="x")
    with pytest.raises(ValueError, match="no time of y"):
        pipe.predict({"x": lead, "y": before})
    with pytest.warns(UserWarning, match="starts much"):
        assert pipe.predict({"x": lead, "y": late})["primary"].count() == 5
    meta = StrategySignalPipeline({"x": same}, rule, metalabel=lambda df: df.withColumn("meta_proba", F.lit(0.5)))
    with pytest.raises(Exception, match="has a NULL"):
        meta.predict({"x": lead})["metalabeling"].collect()


def test_log_uniform_column(spark):
    values = [r.v for r in spark.range(4000).select(validation.log_uniform_column(0.1, 100.0, 3).alias("v")).collect()]
    assert min(values) >= 0.1 and max(values) <= 100
    logs = np.log10(values)
    assert abs(np.mean(logs) - 0.5) < 0.06 and abs((logs < -0.25).mean() - 0.25) < 0.04
    with pytest.raises(ValueError):
        validation.log_uniform_column(0.0, 1.0)


def test_extremes_by_loop(spark):
    x = [3.0, 5.0, 5.0, 1.0, 1.0, 4.0, 2.0]
    df = spark.createDataFrame([("a", datetime(2024, 1, i + 1), v, 0) for i, v in enumerate(x)], "series_id string, ts timestamp_ntz, close double, __row int")
    rows = ind.maxindex(ind.minindex(df, "close", 3), "close", 3).orderBy("ts").collect()
    for i, r in enumerate(rows):
        last = range(i - 2, i + 1) if i >= 2 else []
        assert r.maxindex == (max(last, key=lambda j: (x[j], j)) if last else None)
        assert r.minindex == (max(last, key=lambda j: (-x[j], j)) if last else None)
        assert r["__row"] == 0


def test_totals_on_a_bar_limit_equal_sql(spark, tmp_path):
    """Running totals of dimes meet the limits exactly; the last bits are those of SQL's window, over several days and levels of groups."""
    rng = np.random.default_rng(8)
    ticks = pd.DataFrame({"series_id": ["a"] * 9001 + ["b"] * 300, "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 5 * 86400, 9301), "s")})
    ticks = ticks.assign(event_id=rng.permutation(9301), price=rng.integers(1, 200, 9301) / 10, qty=1.0, is_buy=True)
    ticks.astype({"ts": "datetime64[us]"}).to_parquet(path := f"{tmp_path}/ticks.parquet")
    total = "coalesce(sum(price * qty) over (partition by series_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0)"
    want = duckdb.sql(f"select event_id, {total} as t from '{path}'").df().set_index("event_id").t
    rows = spark.read.parquet(path)
    at = F.row_number().over(Window.partitionBy("series_id").orderBy("ts", "event_id")) - 1
    got = totals_before(rows.withColumn("at", at), "t", "price", "at").toPandas().set_index("event_id").t
    assert (got.sort_index() == want.sort_index()).all()
    sql = duckdb.sql(f"select series_id, floor(t / 20)::bigint as bar_id, count(*) as n from (select *, {total} as t from '{path}') group by all").fetchall()
    made = bars.dynamic_bars(rows, "dollar", 20.0)
    assert {(r.series_id, r.bar_id, r.num_ticks) for r in made.collect()} == set(sql)
