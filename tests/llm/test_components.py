from __future__ import annotations

import random

import pytest

from barloom.llm.components import components

KIND = "u long, v long"


def joined(spark, pairs):
    return {r.node: r.root for r in components(spark.createDataFrame(pairs, KIND)).collect()}


def test_no_links(spark):
    assert joined(spark, []) == {}
    assert joined(spark, [(3, 3), (None, 4), (4, None), (None, None)]) == {}


def test_equals_a_loop(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2080)]
    root = {x: x for p in pairs for x in p}
    moved = True
    while moved:
        moved = False
        for u, v in pairs:
            low = min(root[u], root[v])
            moved |= (root[u], root[v]) != (low, low)
            root[u] = root[v] = low
    assert joined(spark, pairs + [(v, u) for u, v in pairs[:50]]) == {x: r for x, r in root.items() if x != r}


def test_unfinished_is_an_error(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(60)], KIND)
    with pytest.raises(RuntimeError, match="weren't joined"):
        components(links, rounds=1)
