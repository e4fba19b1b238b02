from __future__ import annotations

import math

import numpy as np
import pytest
from common import EDGES, docs_of, words

from barloom.llm import toxicity


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    own = labels.where("doc_id % 4 <> 1")
    model = toxicity.train(docs, own)
    rows = toxicity.score(docs.join(labels.where("doc_id % 4 = 1"), "doc_id", "left_semi"), model).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    clean = [r.toxic for r in rows if not truth[r.doc_id]]
    bad = [r.p_toxic for r in rows if truth[r.doc_id]]
    assert np.mean(clean) <= 0.006
    good = [r.p_toxic for r in rows if not truth[r.doc_id]]
    assert np.mean([a > b for a in bad for b in good]) > 0.85
    for r in rows:
        assert 0 <= r.p_severe <= r.p_toxic <= 1 and abs(r.expected_severity - r.p_toxic - r.p_severe) < 1e-9


def test_thresholds_are_ordered_and_gradients_fit():
    rng = np.random.default_rng(0)
    names = np.sort(rng.integers(0, 1 << 62, 6).astype(np.uint64))
    rows = [np.flatnonzero(rng.random(6) < 0.5) for _ in range(400)]
    grades = np.array([min(2, (0 in r) + (1 in r)) for r in rows])
    model = toxicity.fit(names, rows, grades)
    assert model.theta[0] < model.theta[1]
    tail = model.at_least(np.array([model.weights[r].sum() for r in rows]))
    assert (((tail > 0.5).sum(1)) == grades).mean() > 0.98


def test_edges(spark):
    docs = docs_of(spark, EDGES)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs, toxicity.train(docs, none)).collect()
    assert len(rows) == len(EDGES) and all(r.p_toxic < 1e-9 for r in rows)
    odd = spark.createDataFrame([(7, 1, 1), (7, 0, 1), (9, 1, None), (None, 1, 1), (99, 1, 1), (4, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, odd)).count() == len(EDGES)
    assert toxicity.score(docs_of(spark, []), toxicity.train(docs_of(spark, []), odd)).count() == 0


def hashed(word: str) -> list[int]:
    """The features of a word by their definition: the whole word, and its first 3 to 7 bytes, each with its length's mark."""
    w = toxicity.Words([word.encode()])
    whole = [int(w.hashes[0])]
    for k in toxicity.STARTS:
        cut = toxicity.Words([word.encode()[:k]])
        whole.append(int(toxicity.mix(cut.pieces(cut.first, cut.last) + np.uint64(k))[0]))
    return whole


def test_scores_by_loop(spark, sf_dir):
    """Every document's severity, summed feature by feature from the model's weights."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.select("doc_id", "text").union(docs_of(spark, EDGES).selectExpr("doc_id + 1000000", "text"))
    model = toxicity.train(docs, labels)
    weight = dict(zip(model.names.tolist(), model.weights.tolist(), strict=True))
    assert len(weight) > 10
    got = {}
    for r in toxicity.score(docs, model).collect():
        got.setdefault(r.doc_id, []).append(r)
    known: dict[str, list[int]] = {}
    for d in docs.collect():
        found = set()
        for w in set(words(d.text)):
            found.update(known.setdefault(w, hashed(w)))
        s = sum(weight.get(f, 0.0) for f in sorted(found))
        tail = [1 / (1 + math.exp(t - s)) for t in model.theta]
        chance = [1 - tail[0], tail[0] - tail[1], tail[1]]
        for r in got[d.doc_id]:
            assert (r.p_toxic, r.p_severe, r.expected_severity) == pytest.approx((*tail, sum(tail)), abs=1e-9)
            assert chance[r.grade] == pytest.approx(max(chance), abs=1e-9) and r.toxic == (tail[0] > 0.5)


def test_no_small_step_lowers_the_loss():
    """The fit is the minimum of the penalized loss, computed row by row."""
    rng = np.random.default_rng(2)
    names = np.sort(rng.integers(0, 1 << 62, 5).astype(np.uint64))
    rows = [np.flatnonzero(rng.random(5) < 0.4) for _ in range(300)]
    grades = np.array([int(np.clip((0 in r) + (1 in r) - (2 in r) + rng.integers(-1, 2), 0, 2)) for r in rows])
    model = toxicity.fit(names, rows, grades, rounds=3000, decay=0.01)
    start = [*model.weights, model.theta[0], math.log(model.theta[1] - model.theta[0])]

    def loss(p: list[float]) -> float:
        theta, total = (p[5], p[5] + math.exp(p[6])), 0.0
        for r, g in zip(rows, grades, strict=True):
            s = sum(p[j] for j in r)
            tail = [1.0, *(1 / (1 + math.exp(t - s)) for t in theta), 0.0]
            total -= math.log(tail[g] - tail[g + 1])
        return total / len(rows) + 0.01 / 2 * sum(x * x for x in p[:5])

    least = loss(start)
    for j in range(7):
        for step in (0.03, -0.03):
            assert loss([x + step * (i == j) for i, x in enumerate(start)]) > least
