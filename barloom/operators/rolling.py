"""Rolling z-scores and ratios."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.windows import by_series, full
from barloom.schema import require_columns


def _bar_arrival_time() -> Column:
    """Nanoseconds since the bar before."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return ((micros - F.lag(micros).over(by_series())) * 1000).cast("double")


#: Name -> (needed columns, column builder). Own entries can be added.
SERIES_FUNCTIONS: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "bar_arrival_time": (("ts",), _bar_arrival_time),
    "buy_sell_diff": (("quote_asset_buy_volume", "quote_asset_sell_volume"), lambda: F.col("quote_asset_buy_volume") - F.col("quote_asset_sell_volume")),
    "average_buy_size": (("quote_asset_buy_volume", "num_buy_ticks"), lambda: F.try_divide(F.col("quote_asset_buy_volume"), F.col("num_buy_ticks"))),
    "high_to_low_ratio": (("high", "low"), lambda: F.try_divide(F.col("high"), F.col("low"))),
}


def rolling_z_score(df: DataFrame, window: int, to_series: Callable[[], Column] | str, out: str = "z_score") -> DataFrame:
    """(x - mean) / std over the last ``window`` rows, ddof 1; NULL until they are full, and for no spread."""
    if isinstance(to_series, str):
        needed, to_series = SERIES_FUNCTIONS[to_series]
        require_columns(df, *needed)
    w, x = by_series(), F.col("__x")
    spread = F.nullif(full(x, F.stddev_samp, window, w), F.lit(0.0))
    return df.withColumn("__x", to_series()).withColumn(out, F.try_divide(x - full(x, F.avg, window, w), spread)).drop("__x")


def z_score_transformer(key: str, window: int) -> Callable[[DataFrame], DataFrame]:
    """A z-score step by name; unknown names raise KeyError."""
    SERIES_FUNCTIONS[key]
    return lambda df: rolling_z_score(df, window, key, f"{key}_z")


def local_max_to_close(df: DataFrame, window: int, out: str = "local_max_to_close") -> DataFrame:
    """The highest high of the last ``window`` rows over the close."""
    require_columns(df, "high", "close")
    return df.withColumn(out, F.try_divide(full(F.col("high"), F.max, window, by_series()), F.col("close")))
