from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.ml import Pipeline

from barloom import queries, transformers
from barloom.functions import indicators as ind
from barloom.operators import microstructure


def test_pipeline_of_operators(spark, sf_dir):
    bars = queries.hourly(spark, sf_dir)
    steps = [transformers.RollMeasure(window=10), transformers.VPIN(window=10), transformers.EMA(real="close", timeperiod=5)]
    out = Pipeline(stages=steps).fit(bars).transform(bars)
    want = microstructure.vpin(microstructure.roll_measure(bars, 10), 10)
    pick = lambda df: sorted((r.series_id, r.ts, r.roll_measure, r.vpin) for r in df.where("vpin is not null and roll_measure is not null").collect())
    assert pick(out) == pick(want) and "ema" in out.columns
    with pytest.raises(TypeError):
        transformers.VPIN(wndow=3)


def test_readme_counts_the_registry():
    text = (Path(__file__).resolve().parents[1] / "README.md").read_text()
    assert f"the indicator registry ({len(ind._REGISTRY)} indicators)" in text
