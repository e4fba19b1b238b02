from __future__ import annotations

from collections import defaultdict

import pytest
from common import EDGES, docs_of
from pyspark.sql import functions as F

from barloom.llm import mixing


def fill(sizes, weights, cap=3):
    """Plain water-filling by rounds."""
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        rest, w = total - sum(fixed.values()), sum(weights[s] for s in free)
        over = [s for s in free if weights[s] * rest / w > cap * sizes[s]] if free else []
        if not over:
            return fixed | {s: weights[s] * rest / w for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1, "b": 2, "c": 1000, "d": 5}, {"a": 1000, "b": 1, "c": 1}, {"a": 5}])
def test_targets_by_rounds(spark, sizes):
    rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
    want = fill(sizes, {s: 1 + k % 3 for k, s in enumerate(sorted(sizes))})
    for r in rows:
        assert r.target == pytest.approx(want[r.source])


def test_mixture_meets_its_targets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mix(docs).collect()
    taken, aim = defaultdict(int), {}
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        aim[r.source] = r.target
    for s in aim:
        assert abs(taken[s] - aim[s]) <= 1
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_edges(spark):
    rows = [(d, t, s) for (d, t), s in zip(EDGES, ["a", "a", None, None, "ä", "Z", "a", "b", "b", None, "empty", "a", "b"], strict=True)] + [(50, "", "void"), (51, None, "void"), (None, "w w", "a")]
    got = mixing.mix(docs_of(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r.target == 0 and r.taken == 0 for r in got if r.source == "void")
    assert mixing.mix(docs_of(spark, [])).count() == 0


def test_repeated_rows_of_the_mixture(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    times = {r.doc_id: r["count"] for r in mixing.repeat(docs).groupBy("doc_id").count().collect()}
    for r in mixing.mix(docs).collect():
        want = r.whole + (1 if r["size"] and 2 * r.part >= r["size"] else 0)
        assert times.get(r.doc_id, 0) == want
    assert mixing.repeat(docs).columns == docs.columns
    assert mixing.repeat(docs_of(spark, [(1, "a b", None), (1, "a b", None)])).select(F.col("p" + "art")).count() == 2
