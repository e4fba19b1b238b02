"""Frames over bars and the recurrences that they express.

``full`` is an aggregate over the last n rows that is NULL until n values are there.  ``decayed_sum`` is the first-order
recurrence y_t = q y_(t-1) + u_t as plain window sums, so exponentially weighted columns stay in the JVM.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.schema import SERIES, TS

FAN = 16  # rows or sums of a group in totals_before


def by_series(series: str = SERIES, ts: str = TS) -> WindowSpec:
    return Window.partitionBy(series).orderBy(ts)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def full(c: Column, agg: Callable[[Column], Column], n: int, w: WindowSpec) -> Column:
    frame = last_rows(w, n)
    return F.when(F.count(c).over(frame) == n, agg(c).over(frame))


def diff(c: Column, w: WindowSpec, lag: int = 1) -> Column:
    return c - F.lag(c, lag).over(w)


def decayed_sum(df: DataFrame, out: str, u: Column, q: float, series: str = SERIES, ts: str = TS) -> DataFrame:
    """Adds ``out`` = sum over rows i up to t of q**(t - i) u_i; NULL inputs add nothing.

    Rows are numbered in blocks so short that q**-block stays far from overflow and so long that what lies two blocks
    back has decayed below 1e-100: a block's running sum plus the total of the block before is the whole sum.
    """
    block = max(8, int(120 * math.log(10) / -math.log(q))) if 0 < q < 1 else 1 << 30
    w = by_series(series, ts)
    names = [f"__{out}_{x}" for x in ("pos", "block", "term")]
    pos, blk, term = (F.col(n) for n in names)
    grown = F.pow(F.lit(float(q)), -F.pmod(pos, F.lit(block)).cast("double")) if q > 0 else F.lit(1.0)
    numbered = df.withColumn(names[0], F.row_number().over(w) - 1).withColumn(names[1], F.floor(pos / block).cast("long"))
    numbered = numbered.withColumn(names[2], F.coalesce(u, F.lit(0.0)) * grown)
    own = F.sum(term).over(Window.partitionBy(series, names[1]).orderBy(names[0]).rowsBetween(Window.unboundedPreceding, 0))
    past = F.sum(term).over(Window.partitionBy(series).orderBy(names[1]).rangeBetween(-1, -1))
    place = F.pmod(pos, F.lit(block)).cast("double")
    total = own * F.pow(F.lit(float(q)), place) + F.coalesce(past, F.lit(0.0)) * F.pow(F.lit(float(q)), place + block)
    return numbered.withColumn(out, total).drop(*names)


def _climb(df: DataFrame, keys: list[str], at: str, x: str, steps: int) -> tuple[DataFrame, list[str]]:
    """Columns that hold, at the last of each FAN**j rows, the sum of these rows: row by row for j = 1, then FAN sums each."""
    names = [x]
    for j in range(1, steps + 1):
        last = F.col(at).bitwiseAND(F.lit(FAN ** (j - 1) - 1)) == FAN ** (j - 1) - 1
        w = Window.partitionBy(*keys, F.floor(F.col(at) / FAN**j)).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
        names.append(f"{x}_{j}")
        df = df.withColumn(names[-1], F.sum(F.when(last, F.col(names[-2]))).over(w))
    return df, names


def _descend(df: DataFrame, keys: list[str], at: str, names: list[str], out: str) -> DataFrame:
    """``out``, the total before each group of the largest size, becomes the total before each row: a group's, and then what lies in it, in order."""
    for j in range(len(names) - 1, 0, -1):
        w, done = Window.partitionBy(*keys, F.floor(F.col(at) / FAN**j)).orderBy(at), f"{out}_done"
        starts = [F.col(at).bitwiseAND(F.lit(FAN**i - 1)) == 0 for i in (j, j - 1)]
        df = df.withColumn(done, F.lag(names[j - 1]).over(w))
        term = F.when(starts[0], F.col(out)).when(starts[1], F.col(done))
        df = df.withColumn(out, F.sum(term).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop(done)
    return df


def totals_before(df: DataFrame, out: str, x: str, at: str, series: str = SERIES) -> DataFrame:
    """Adds ``out`` = sum of ``x`` over the series' rows before each, which ``at`` numbers from 0; NULL adds nothing.

    The order of the additions is fixed by the numbers alone, so that the last bits don't depend on how rows are dealt:
    sums of FAN rows, of FAN such sums and so on; a total takes the largest groups first, from left to right.  That is
    the order of a segment tree of this width, as in DuckDB's windows, up to FAN**8 rows a series.  Groups of FAN**2
    rows are summed in tasks of their own; one task orders the groups of a series.
    """
    chunk, inner, node = (f"__{out}_{n}" for n in ("chunk", "x", "node"))
    rows = df.withColumn(chunk, F.floor(F.col(at) / FAN**2)).withColumn(inner, F.coalesce(F.col(x).cast("double"), F.lit(0.0)))
    rows, low = _climb(rows.repartition(series, chunk), [series, chunk], at, inner, 2)
    full_group = F.col(at).bitwiseAND(F.lit(FAN**2 - 1)) == FAN**2 - 1
    groups = rows.groupBy(series, chunk).agg(F.max(F.when(full_group, F.col(low[-1]))).alias(node))
    groups, high = _climb(groups.repartition(series), [series], chunk, node, 5)
    complete = F.col(chunk).bitwiseAND(F.lit(FAN**5 - 1)) == FAN**5 - 1
    before = F.sum(F.when(complete, F.col(high[-1]))).over(Window.partitionBy(series).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1))
    groups = _descend(groups.withColumn(out, F.coalesce(before, F.lit(0.0))), [series], chunk, high, out)
    rows = rows.join(groups.select(series, chunk, out), [series, chunk])
    return _descend(rows, [series, chunk], at, low, out).drop(chunk, *low)


def ewm(df: DataFrame, out: str, x: str, span: float, std: bool = False, series: str = SERIES, ts: str = TS) -> DataFrame:
    """Exponentially weighted mean (or debiased standard deviation) with alpha = 2 / (span + 1), weights adjusted.

    Interior gaps decay the weights; rows before the first value are NULL and rows in gaps carry the last one on.
    """
    q, there = 1 - 2 / (span + 1), F.col(x).isNotNull()
    c = f"__{out}_c"
    work = df.withColumn(c, F.col(x) - F.avg(x).over(Window.partitionBy(series)))  # against cancellation
    work = decayed_sum(work, f"__{out}_n", F.col(c), q, series, ts)
    work = decayed_sum(work, f"__{out}_d", F.when(there, 1.0), q, series, ts)
    mean = F.try_divide(F.col(f"__{out}_n"), F.col(f"__{out}_d"))
    extra = [c, f"__{out}_n", f"__{out}_d"]
    if std:
        work = decayed_sum(work, f"__{out}_s", F.col(c) * F.col(c), q, series, ts)
        work = decayed_sum(work, f"__{out}_e", F.when(there, 1.0), q * q, series, ts)
        extra += [f"__{out}_s", f"__{out}_e"]
        d2 = F.col(f"__{out}_d") * F.col(f"__{out}_d")
        spread = F.greatest(F.try_divide(F.col(f"__{out}_s"), F.col(f"__{out}_d")) - mean * mean, F.lit(0.0))
        seen = F.count(x).over(by_series(series, ts).rowsBetween(Window.unboundedPreceding, 0))
        value = F.when(seen > 1, F.sqrt(F.try_divide(spread * d2, d2 - F.col(f"__{out}_e"))))
    else:
        value = mean + F.avg(x).over(Window.partitionBy(series))
    return work.withColumn(out, value).drop(*extra)


def seeded_ema(df: DataFrame, out: str, x: Column, n: int, alpha: float | None = None, series: str = SERIES, ts: str = TS) -> DataFrame:
    """A moving average that starts from the plain mean of the first n values and then moves by alpha (2 / (n + 1)).

    NULL before that; leading NULLs of ``x`` are skipped, values after the first must be there.
    """
    a = 2 / (n + 1) if alpha is None else alpha
    w, v, k = by_series(series, ts), f"__{out}_x", f"__{out}_k"
    work = df.withColumn(v, x).withColumn(k, F.count(v).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    seed = F.avg(v).over(last_rows(w, n))
    u = F.when((F.col(k) == n) & F.col(v).isNotNull(), seed).when(F.col(k) > n, F.col(v) * a)
    work = work.withColumn(f"__{out}_u", u)
    work = decayed_sum(work, out, F.col(f"__{out}_u"), 1 - a, series, ts)
    return work.withColumn(out, F.when(F.col(k) >= n, F.col(out))).drop(v, k, f"__{out}_u")


def erf(x: Column) -> Column:
    """The error function by its series of positive terms; +-1 beyond 6."""
    # the square is part of the state, so that ``x`` is evaluated once and not at each step
    term = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"), (2 * x * x).alias("q"))

    def step(a: Column, n: Column) -> Column:
        t = a["t"] * (a["q"] / (2 * n + 1))
        return F.struct(t.alias("t"), (a["s"] + t).alias("s"), a["q"].alias("q"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(120)), term, step)["s"]
    inside = F.lit(2 / math.sqrt(math.pi)) * x * F.exp(-x * x) * total
    return F.when(F.abs(x) > 6, F.signum(x)).otherwise(inside)
