from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from common import EDGES, docs_of, words

from barloom.llm import lm
from barloom.llm.gru import FAR, Gru


def base_of(rows):
    tokens = [(d, [*words(t), None]) for d, t in rows]
    c = Counter(x for d, w in tokens if zlib.crc32(str(d).encode()) % 7 != 2 for x in w)
    n, v = sum(c.values()), len(c)
    return {d: (len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)) for d, w in tokens}


def test_scores(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = base_of([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    rows = lm.score(docs, max_docs=150, epochs=1).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges(spark):
    rows = lm.score(docs_of(spark, EDGES), max_docs=5, epochs=1).collect()
    want = base_of(EDGES)
    assert len(rows) == len(EDGES)
    for r in rows:
        assert r.n_tokens == want[r.doc_id][0] and r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9) and math.isfinite(r.score)
    assert lm.score(docs_of(spark, [])).count() == 0


def test_rare_words_by_join(spark, monkeypatch):
    """With a tiny table most counts come by the join; the result is the same."""
    texts = [(k, " ".join(f"w{(k * j) % 37}" for j in range(1, 30))) for k in range(30)]
    monkeypatch.setattr(lm, "TABLE", 3)
    want = base_of(texts)
    for r in lm.score(docs_of(spark, texts), max_docs=5, epochs=1).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3] and r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9)


def test_learns_from_all_documents(spark, monkeypatch):
    """What only documents outside the starting sample show is learned, whatever the number of shares."""
    texts = [(k, "one two three four five six seven eight " * 40) for k in range(600)]
    for share in (1 << 22, 60_000):
        monkeypatch.setattr(lm, "SHARE", share)
        rows = lm.score(docs_of(spark, texts), max_docs=2, epochs=1).collect()
        assert sum(r.score for r in rows) > 0.5 * sum(r.base_score for r in rows)


def test_probabilities_sum_to_one():
    net = Gru(3, 4, 2, 5, seed=1)
    h = np.random.default_rng(0).standard_normal((1, 5)).astype(np.float32)
    logp, _ = net.log_probs(np.repeat(h, 14, 0), np.arange(14))
    assert np.exp(logp).sum() == pytest.approx(1, abs=1e-5)


def test_windows_carry_the_state():
    net = Gru(3, 4, 2, 5, seed=1)
    docs = [np.random.default_rng(k).integers(0, 14, n) for k, n in enumerate((1, 7, 40, 40, 3))]
    whole = net.score(docs, 0, window=1000)
    assert np.allclose(whole, net.score(docs, 0, window=3), atol=1e-4)
    h, total = np.zeros((1, 5), np.float32), 0.0
    before = 0
    for t in docs[2]:
        h = net.step(net.p["x"][[before]] + net.p["b"], h)[0]
        total += float(net.log_probs(h, np.array([t]))[0][0])
        before = t
    assert whole[2] == pytest.approx(total, abs=1e-3)


def test_training_lowers_the_loss():
    net = Gru(2, 4, 2, 8, seed=1)
    docs = [np.array([1, 2, 3, 4] * 20 + [0]) for _ in range(40)]
    losses = net.train(docs, 0, 6, lanes=8, window=8)
    assert losses[-1] < 0.4 < losses[0]


def test_gradients():
    net = Gru(2, 3, 1, 4, seed=3)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    h, ids = np.random.default_rng(1).standard_normal((6, 4)), np.array([0, 1, 2, 3, 6, 4])
    g = {k: np.zeros_like(v) for k, v in net.p.items()}
    logp, dh = net.log_probs(h, ids, g)
    for k in ("c", "w", "wb"):
        at = tuple(0 for _ in net.p[k].shape)
        net.p[k][at] += 1e-6
        more = net.log_probs(h, ids)[0].sum()
        net.p[k][at] -= 1e-6
        assert g[k][at] == pytest.approx(-(more - logp.sum()) / 1e-6, abs=1e-4)
    h[2, 1] += 1e-6
    assert dh[2, 1] == pytest.approx(-(net.log_probs(h, ids)[0].sum() - logp.sum()) / 1e-6, abs=1e-4)


def plain_kind(word: str) -> int:
    raw = word.encode()
    return (max(raw) > 127) * 1 + (chr(raw[-1]) in ".,;:!?") * 2 + any(chr(b) in "#*$%&|<>!=_/\\@+0123456789" for b in raw) * 4


def softmax_log(logits: np.ndarray, at: int) -> float:
    top = logits.max()
    return float(logits[at] - top - math.log(np.exp(logits - top).sum()))


@pytest.mark.parametrize("table", [1 << 18, 40])
def test_whole_score_by_loop(spark, monkeypatch, table):
    """The score of each document, word by word: the network's part from its weights, the rare part from plain counts."""
    made, fit = [], lm.fit
    monkeypatch.setattr(lm, "TABLE", table)
    monkeypatch.setattr(lm, "fit", lambda docs, vocab, *rest: made.append((vocab, fit(docs, vocab, *rest))) or made[-1][1])
    rng, ends = np.random.default_rng(4), ["", "", ".", "7", "é", "é!", "_x,"]
    texts = [(k, " ".join(f"v{'abcdefghij'[w % 10]}{'klmnopqrst'[w // 10 % 10]}{'uvwxyzabcd'[w // 100 % 10]}{'efgh'[w // 1000 % 4]}{ends[w % 7]}" for w in np.minimum(rng.pareto(0.3, 500) * 3, 1e9).astype(np.int64) % 9000)) for k in range(90)]
    texts += [(90, None), (91, "never seen before by anyone.")]
    got = {r.doc_id: r for r in lm.score(docs_of(spark, texts), max_docs=20, epochs=1).collect()}
    (vocab, net), = made
    count = Counter(w for d, t in texts if zlib.crc32(str(d).encode()) % 7 != 2 for w in words(t))
    ids = {}
    for w in {w for _, t in texts for w in words(t)}:
        at, there = vocab.find(lm.Words([w.encode()]).hashes)
        if there[0] and vocab.ids[at[0]] > 0:
            ids[w] = int(vocab.ids[at[0]])
    inside = sorted(ids, key=ids.get)
    assert 0 < len(ids) <= table and (table < lm.CLASSES * lm.SIZE or len(ids) == min(lm.CLASSES * lm.SIZE - 1, len(count)))
    assert [count[w] for w in inside] == sorted((count[w] for w in inside), reverse=True)
    mass, kinds_ = Counter(), Counter()
    for w in count:
        if w not in ids:
            mass[plain_kind(w)] += count[w]
            kinds_[plain_kind(w)] += 1
    size, rare_seen = lm.SIZE, 0
    for d, t in texts:
        h, before, want = np.zeros((1, lm.HIDDEN), np.float32), 0, 0.0
        for w in [*words(t), None]:
            now = 0 if w is None else ids.get(w, lm.CLASSES * size + plain_kind(w))
            h = net.step(net.p["x"][[before]] + net.p["b"], h)[0]
            cls = now // size if now < lm.CLASSES * size else lm.CLASSES + plain_kind(w)
            want += softmax_log((h @ net.p["c"] + net.p["cb"])[0].astype(np.float64), cls) / math.log(10)
            if now < lm.CLASSES * size:
                want += softmax_log((h @ net.p["w"][cls] + net.p["wb"][cls])[0].astype(np.float64), now % size) / math.log(10)
            else:
                k = plain_kind(w)
                want += math.log10((count[w] + 1) / (mass[k] + kinds_[k] + 1))
                rare_seen += 1
            before = now
        assert got[d].score == pytest.approx(want, rel=1e-4), d
    assert rare_seen > 50 and len(count) > lm.CLASSES * lm.SIZE  # some words of the table are outside the network


@pytest.mark.parametrize("size", [1, 30])
def test_state_and_chances_by_plain_formulas(size):
    """Gates by half tangents, and rows of exponents with and without moving them (weights of size 30 go beyond what is safe)."""
    net, rng = Gru(3, 4, 2, 5, seed=1), np.random.default_rng(2)
    net.p = {k: rng.standard_normal(v.shape) * size for k, v in net.p.items()}
    h, ids = rng.uniform(-1, 1, (40, 5)), rng.integers(0, 14, 40)
    gates, u = rng.standard_normal((40, 15)), net.p["u"]
    z, r = (1 / (1 + np.exp(-(gates + h @ u)[:, a : a + 5])) for a in (0, 5))
    n = np.tanh(gates[:, 10:] + r * (h @ u)[:, 10:])
    zr, cand = net.halves(gates)
    moved = net.move(zr, cand, h, net.halves(u), np.empty((40, 5)), np.empty((40, 5)))
    assert np.allclose(moved, (1 - z) * n + z * h) and np.allclose(np.hstack((zr, cand)), np.hstack((z, r, n)))
    want = []
    for row, w in zip(h, ids, strict=True):
        c = w // 4 if w < 12 else w - 9
        want.append(softmax_log(row @ net.p["c"] + net.p["cb"], c) + (softmax_log(row @ net.p["w"][c] + net.p["wb"][c], w % 4) if w < 12 else 0))
    bound = (np.abs(h).max(0) @ np.abs(net.p["c"]) + np.abs(net.p["cb"])).max()
    assert (bound < FAR) == (size == 1)
    assert np.allclose(net.log_probs(h, ids)[0], want)
