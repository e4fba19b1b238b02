"""Structural-break tests."""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import by_series
from barloom.schema import require_columns

MODELS = ("no_trend", "linear", "quadratic", "sm_poly_1", "sm_poly_2", "sm_exp", "sm_power")


def chu_stinchcombe_white(df: DataFrame, side: str = "two_sided", column: str = "close") -> DataFrame:
    """(series_id, ts, statistic, critical_value) from the second row on: the largest departure from any earlier value.

    At each row all earlier ones are compared: quadratic by nature, row by row in parallel.
    """
    if side not in ("one_sided_positive", "one_sided_negative", "two_sided"):
        raise ValueError("side must be one_sided_positive, one_sided_negative or two_sided")
    require_columns(df, column)
    w = by_series()
    past = F.collect_list(F.col(column)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    d = F.col(column) - F.lag(column).over(w)
    work = df.select("series_id", "ts", F.col(column).cast("double").alias("y"), F.row_number().over(w).alias("n"), past.alias("past"), d.alias("d"))
    squares = F.sum(F.col("d") * F.col("d")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    work = work.withColumn("sq", squares).withColumn("s2", F.try_divide(F.col("sq"), (F.col("n") - 1).cast("double")))
    gap = {"one_sided_positive": lambda v: F.col("y") - v, "one_sided_negative": lambda v: v - F.col("y"), "two_sided": lambda v: F.abs(F.col("y") - v)}[side]
    each = F.transform("past", lambda v, i: F.struct(F.try_divide(gap(v), F.sqrt(F.col("s2") * (F.col("n") - 1 - i))).alias("s"), (-i).alias("m")))
    best = work.where("n > 1").withColumn("b", F.array_max(each))
    there = F.col("b.s").isNotNull()
    return best.select("series_id", "ts", F.col("b.s").alias("statistic"), F.when(there, F.sqrt(4.6 + F.ln((F.col("n") - 1 + F.col("b.m")).cast("double")))).alias("critical_value"))


def dickey_fuller_chow(df: DataFrame, min_num_samples: int = 20, column: str = "close") -> DataFrame:
    """(series_id, ts, statistic): t-value of the lagged level from row k on, for each k; by sums over the rows that follow."""
    require_columns(df, column)
    w = by_series()
    work = df.select("series_id", "ts", F.col(column).alias("y"), F.lag(column).over(w).alias("x"), (F.row_number().over(w) - 1).alias("k"), F.count(F.lit(1)).over(Window.partitionBy("series_id")).alias("n"))
    work = work.withColumn("d", F.col("y") - F.col("x"))
    after = Window.partitionBy("series_id").orderBy(F.col("ts").desc()).rowsBetween(Window.unboundedPreceding, -1)  # grows only: one pass
    sums = work.select("series_id", "ts", "k", "n", F.sum(F.col("d") * F.col("x")).over(after).alias("sxy"), F.sum(F.col("x") * F.col("x")).over(after).alias("sxx"), F.sum(F.col("d") * F.col("d")).over(Window.partitionBy("series_id")).alias("syy"))
    b = F.try_divide(F.col("sxy"), F.col("sxx"))
    var = F.try_divide(F.col("syy") - b * F.col("sxy"), (F.col("n") - 2).cast("double"))
    picked = sums.where((F.col("k") >= min_num_samples) & (F.col("k") < F.col("n") - min_num_samples))
    return picked.select("series_id", "ts", F.try_divide(b, F.when(var > 0, F.sqrt(F.try_divide(var, F.col("sxx"))))).alias("statistic"))


def lagged(df: DataFrame, column: str, lags: int | list[int]) -> DataFrame:
    """Columns {column}_lag_{k} for k = 1 .. lags, or for the lags given."""
    w = by_series()
    return df.withColumns({f"{column}_lag_{k}": F.lag(column, k).over(w) for k in (range(1, lags + 1) if isinstance(lags, int) else lags)})


def design(y: np.ndarray, model: str, lags: int | list[int], constant: bool) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Regressors, target, the tested column, and how many rows at the start fall out."""
    if model in ("no_trend", "linear", "quadratic"):
        steps = list(range(1, lags + 1)) if isinstance(lags, int) else list(lags)
        d = np.diff(y)
        lost = max(steps, default=0)
        target = d[lost:]
        n = len(target)
        cols = [y[lost : lost + n]] + [d[lost - k : lost - k + n] for k in steps]
        trend = np.arange(1, n + 1, dtype=float)
        cols += [np.ones(n)] * constant + {"no_trend": [], "linear": [trend], "quadratic": [trend, trend**2]}[model]
        return np.column_stack(cols) if n else np.zeros((0, len(cols))), target, 0, lost + 1
    trend = np.arange(1, len(y) + 1, dtype=float)
    tested = {"sm_poly_1": trend**2, "sm_poly_2": trend**2, "sm_exp": trend, "sm_power": np.log(trend)}[model]
    cols = [tested, np.ones(len(y))] + ([trend] if model.startswith("sm_poly") else [])
    return np.column_stack(cols), y if model == "sm_poly_1" else np.log(y), 0, 0


def sup_statistics(x: np.ndarray, y: np.ndarray, ends: np.ndarray, tested: int, min_length: int, phi: float | None) -> np.ndarray:
    """For each end the largest t-value of the tested coefficient over all starts with at least ``min_length`` rows.

    Normal equations of every window are differences of running sums; windows without a well-posed fit are left out.
    """
    k = x.shape[1]
    scale = np.abs(x).max(0) if len(x) else np.ones(k)
    scale[scale == 0] = 1
    z = x / scale
    xx = np.concatenate((np.zeros((1, k, k)), np.cumsum(z[:, :, None] * z[:, None, :], axis=0)))
    xy = np.concatenate((np.zeros((1, k)), np.cumsum(z * y[:, None], axis=0)))
    yy = np.concatenate(([0.0], np.cumsum(y * y)))
    out = np.full(len(ends), np.nan)
    for i, end in enumerate(ends):
        starts = np.arange(0, end + 1 - min_length + 1)
        n = end + 1 - starts
        a, b, c = xx[end + 1] - xx[starts], xy[end + 1] - xy[starts], yy[end + 1] - yy[starts]
        good = (n > k) & (np.linalg.cond(a) < 1e13) if len(starts) else np.zeros(0, bool)
        if not good.any():
            continue
        inverse = np.linalg.inv(a[good])
        coef = np.einsum("nij,nj->ni", inverse, b[good])
        rest = np.maximum(c[good] - np.einsum("ni,ni->n", coef, b[good]), 0) / (n[good] - k)
        var = rest * inverse[:, tested, tested]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = coef[:, tested] / np.sqrt(var)
        if phi is not None:
            t = np.abs(t) / (starts[good] + 1.0) ** phi
        t = t[np.isfinite(t)]
        if len(t):
            out[i] = t.max()
    return out


def sup_adf(df: DataFrame, model: str = "linear", lags: int | list[int] = 1, min_length: int = 20, add_constant: bool = True, phi: float = 0.0, column: str = "close", blocks: int = 16) -> DataFrame:
    """(series_id, ts, statistic): the supremum over starts of the test's t-value at each end from the row after the first ``min_length``.

    Ends without a well-posed fit have a null statistic. The sm_* models always have a constant.
    A series' ends are dealt to ``blocks`` tasks (interleaved, as later ends cost more); each has the whole series.
    """
    if model not in MODELS:
        raise ValueError(f"model must be one of {MODELS}")
    if not 0 <= phi <= 1:
        raise AssertionError("phi must lie between 0 and 1")
    most = lags if isinstance(lags, int) else max(lags, default=0)
    if min_length <= most:
        raise AssertionError("min_length must exceed the lags")
    require_columns(df, column)
    if model.startswith("sm_") and not add_constant:
        warnings.warn(f"{model} always has a constant; add_constant=False has no effect", stacklevel=2)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("ts")
        x, target, tested, lost = design(frame["y"].to_numpy(float), model, lags, add_constant)
        ends = np.arange(min_length, len(target))
        ends = ends[ends % blocks == key[1]]
        stat = sup_statistics(x, target, ends, tested, min_length, phi if model.startswith("sm_") else None)
        return pd.DataFrame({"series_id": key[0], "ts": frame["ts"].to_numpy()[ends + lost], "statistic": stat})

    rows = df.select("series_id", "ts", F.col(column).cast("double").alias("y"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    kind = dict(df.dtypes)
    return rows.groupBy("series_id", "block").applyInPandas(run, f"series_id {kind['series_id']}, ts {kind['ts']}, statistic double")
