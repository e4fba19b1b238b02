"""Joining frames of different frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.schema import fresh

METHODS = ("mean", "max", "min")


def align_on(keys: DataFrame, features: DataFrame, method: str = "mean", series: str = "series_id", ts: str = "ts") -> DataFrame:
    """Feature rows in (previous key, key] reduced to the key; empty keys carry the last values on; later rows drop out.

    A NULL in a bucket makes the bucket NULL, which is then filled too. Repeated keys count once; without keys the result
    is empty; feature columns may have any name but those of the series and the time.
    """
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    agg = {"mean": F.avg, "max": F.max, "min": F.min}[method]
    names = [c for c in features.columns if c not in (series, ts)]
    key, row, at = fresh(features, "__key", "__row", "__at")
    marks = keys.select(series, ts).distinct().withColumn(key, F.col(ts)).withColumn(row, F.lit(1))
    rows = features.withColumn(key, F.lit(None).cast(dict(marks.dtypes)[key])).withColumn(row, F.lit(0))
    both = rows.unionByName(marks, allowMissingColumns=True)
    # the next key is the last one met from the end; a frame that only grows is one pass over the rows
    ahead = Window.partitionBy(series).orderBy(F.col(ts).desc(), F.col(row).desc()).rowsBetween(Window.unboundedPreceding, 0)
    placed = both.withColumn(at, F.last(key, ignorenulls=True).over(ahead)).where((F.col(row) == 0) & F.col(at).isNotNull())
    bucket = placed.groupBy(series, F.col(at).alias(ts)).agg(*[F.when(F.count(c) == F.count(F.lit(1)), agg(c)).alias(c) for c in names])
    back = Window.partitionBy(series).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    joined = keys.select(series, ts).distinct().join(bucket, [series, ts], "left")
    return joined.select(series, ts, *[F.last(c, ignorenulls=True).over(back).alias(c) for c in names])
