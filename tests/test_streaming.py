from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from barloom.functions import indicators as ind
from barloom.operators import sampling
from barloom.sources.events import ticks
from barloom.streaming import bars as streaming


def _replay(spark, tmp_path, df, name, mode="append"):
    path = str(tmp_path / name)
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def _result(spark, out, tmp_path, name, mode):
    query = out.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_stream_of_bars_equals_batch(spark, sf_dir, tmp_path):
    t = ticks(spark, sf_dir).drop("user_id")
    out = _result(spark, streaming.streaming_time_bars(_replay(spark, tmp_path, t, "ticks")), tmp_path, "bars_stream", "complete")
    want = t.groupBy("series_id", F.window(F.col("ts").cast("timestamp"), "1 hour").alias("w")).agg(F.sum("qty").alias("v"), F.max("price").alias("h"))
    got = {(r.series_id, r.bar_start): (r.base_asset_volume, r.high) for r in out.collect()}
    assert got == {(r.series_id, r.w.start): (r.v, r.h) for r in want.collect()}


def test_stateful_filter_and_average_equal_batch(spark, tmp_path):
    rows = spark.range(300).select(F.lit("a").alias("series_id"), (F.timestamp_seconds(F.col("id") * 60)).cast("timestamp_ntz").alias("ts"), (50 + 10 * F.sin(F.col("id") / 7)).alias("close"))
    found = _result(spark, streaming.streaming_cusum(_replay(spark, tmp_path, rows, "c"), 5.0), tmp_path, "cusum_stream", "append")
    assert {r.ts for r in found.select(F.col("ts").cast("timestamp_ntz").alias("ts")).collect()} == {r.ts for r in sampling.cusum_filter(rows, 5.0).collect()}
    ema = _result(spark, streaming.streaming_ema(_replay(spark, tmp_path, rows, "e"), 10), tmp_path, "ema_stream", "append")
    got = {r.ts: r.ema for r in ema.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "ema").collect()}
    for r in ind.ema(rows, "close", 10).collect():
        assert got[r.ts] is None if r.ema is None else got[r.ts] == pytest.approx(r.ema)
