"""Bet sizes from probabilities, averaging over active bets, discretisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.windows import by_series, erf
from barloom.schema import require_columns


def discretise(signal: Column, step: float) -> Column:
    """To the nearest multiple of ``step`` (halves to even), three decimals, within [-1, 1]."""
    if not 0 < step < 1:
        raise AssertionError("step must lie between 0 and 1")
    # bround(x, 0) on doubles; a scale in the call keeps the type
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.bround(F.bround(signal / step, 0) * step, 3)))


def signal(probability: Column, prediction: Column, num_classes: int) -> Column:
    """prediction (2 Phi(z) - 1) with z = (p - 1/K) / sqrt(p (1 - p)); p of 0 and 1 give -1 and 1 times it."""
    p = probability
    z = F.try_divide(p - 1 / num_classes, F.sqrt(p * (1 - p)))
    size = F.when(p >= 1, 1.0).when(p <= 0, -1.0).otherwise(erf(z / 2**0.5))
    return prediction * size


def average_active(df: DataFrame, size: str = "bet_size", end: str = "event_end_time", out: str = "average_bet") -> DataFrame:
    """At each start and end time the mean of the bets open then: start <= t and (t < end or no end); 0 if none."""
    require_columns(df, "series_id", "ts", size, end)
    up = F.struct(F.col("ts").alias("ts"), F.col(size).alias("m"), F.lit(1).alias("k"))
    down = F.struct(F.col(end).alias("ts"), (-F.col(size)).alias("m"), F.lit(-1).alias("k"))
    both = df.select("series_id", F.explode(F.when(F.col(end).isNotNull(), F.array(up, down)).otherwise(F.array(up))).alias("x"))
    marks = both.groupBy("series_id", F.col("x.ts").alias("ts")).agg(F.sum("x.m").alias("m"), F.sum("x.k").alias("k"))
    w = by_series().rowsBetween(Window.unboundedPreceding, 0)
    total, open_bets = F.sum("m").over(w), F.sum("k").over(w)
    return marks.select("series_id", "ts", F.when(open_bets > 0, total / open_bets).otherwise(0.0).alias(out))


def bet_sizes(
    df: DataFrame, num_classes: int, average: bool = False, meta_labeling: bool = False, discretised: bool = False, step_size: float = 0.1,
    probability: str = "prob", prediction: str = "pred", side: str = "side", end: str = "event_end_time", out: str = "bet_size",
) -> DataFrame:
    """Absolute bet sizes; with ``average``, one row per start and end time, of the mean over active bets."""
    require_columns(df, probability, prediction, *([side] if meta_labeling else []), *([end] if average else []))
    m = signal(F.col(probability), F.col(prediction), num_classes)
    work = df.withColumn(out, m * F.col(side) if meta_labeling else m)
    if average:
        work = average_active(work, out, end, out)
    if discretised:
        work = work.withColumn(out, discretise(F.col(out), step_size))
    return work.withColumn(out, F.abs(out))


def check_sizes(df: DataFrame, size: str = "bet_size") -> None:
    """An action: raises if a size lies outside [-1, 1]."""
    low, high = df.agg(F.min(size), F.max(size)).first()
    if low is not None and (low < -1 or high > 1):
        raise AssertionError("bet sizes must lie between -1 and 1")
