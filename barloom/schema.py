"""Column names and contracts of bar frames: (series_id, ts) keys, NULL for missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES, TS = "series_id", "ts"
BAR_COLUMNS = (
    "open", "high", "low", "close", "base_asset_volume", "base_asset_buy_volume", "base_asset_sell_volume",
    "quote_asset_volume", "quote_asset_buy_volume", "quote_asset_sell_volume", "num_ticks", "num_buy_ticks",
)


def require_columns(df: DataFrame, *names: str) -> None:
    """Raise before planning if ``df`` lacks a column."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise AssertionError(f"missing columns: {missing}")


def to_millis(ts: Column) -> Column:
    """Epoch milliseconds of a timestamp, floored."""
    return F.unix_millis(ts.cast("timestamp"))


def floor_to_millis(ts: Column) -> Column:
    return F.date_trunc("MILLISECOND", ts)


def from_millis(millis: Column) -> Column:
    """A timestamp without time zone from epoch milliseconds."""
    return F.timestamp_millis(millis).cast("timestamp_ntz")


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def identity(df: DataFrame) -> DataFrame:
    return df


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that ``df`` doesn't have, whatever the letters' case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for base in bases:
        while base.lower() in taken:
            base = "_" + base
        taken.add(base.lower())
        out.append(base)
    return out


def must(df: DataFrame, fine: Column, message: str) -> DataFrame:
    """The rows as they are; the job that reads them fails with ``message`` at a row that isn't ``fine``. No job of its own."""
    return df.where(F.when(F.coalesce(fine, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def unique_keys(df: DataFrame, name: str) -> DataFrame:
    """The rows as they are; the job fails at repeated (series_id, ts). The partitioning and order are those that operators on bars share."""
    (twice,) = fresh(df, "__twice")
    same = F.coalesce(F.lag(TS).over(Window.partitionBy(SERIES).orderBy(TS)) == F.col(TS), F.lit(False))
    return must(df.withColumn(twice, same), ~F.col(twice), f"{name} has repeated keys").drop(twice)
