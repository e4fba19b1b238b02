from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from common import EDGES, docs_of, words
from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import jaccard
from barloom.llm.components import components
from barloom.llm.words import Words, shingles


def shingle_set(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, num, den):
    """doc_id -> (set size, smallest linked doc_id); candidates by a full index of rare shingles, all compared."""
    sets = {d: shingle_set(t, k) for d, t in rows}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    df = Counter(x for s in sets.values() for x in s)
    index = defaultdict(list)
    for d in sorted(sets, key=lambda d: len(sets[d])):
        s = sets[d]
        first = sorted(s, key=lambda x: (df[x], x))[: len(s) - -(-num * len(s) // den) + 1]
        near = {c for x in first for c in index[x]}
        for x in first:
            index[x].append(d)
        for c in near:
            n = len(s & sets[c])
            if den * n >= num * (len(s) + len(sets[c]) - n):
                a, b = sorted((root(d), root(c)))
                parent[b] = a
    return {d: (len(sets[d]), root(d)) for d in sets}


def edited(base, share, rng):
    return " ".join(w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in base)


def near_rows():
    rng = random.Random(5)
    rows, n = [], 0
    for size, copies, shares in ((200, 40, (0.01, 0.03)), (60, 60, (0.02, 0.05)), (12, 20, (0.05, 0.1)), (1500, 12, (0.01, 0.02))):
        base = [f"w{rng.randrange(5000)}" for _ in range(size)]
        for k in range(copies):
            rows.append((n, edited(base, shares[k % 2], rng)))
            n += 1
    passage = " ".join(f"p{k}" for k in range(60))
    for _ in range(60):
        rows.append((n, passage + " " + " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(5, 150)))))
        n += 1
    return rows


@pytest.mark.parametrize("k, num", [(3, 90), (5, 80)])
def test_near_copies_by_brute_force(spark, k, num):
    rows = near_rows()
    rng = random.Random(1)
    rng.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(docs_of(spark, rows), k, num, 100).collect()}
    assert got == brute(rows, k, num, 100)
    assert len({c for _, c in got.values()}) < len(rows) - 20


@pytest.mark.parametrize("many, k, num", [(2, 3, 90), (8, 5, 80)])
def test_blocks_of_large_rows(spark, monkeypatch, many, k, num):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "MANY", many)
    rows = near_rows()[:100]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(docs_of(spark, rows), k, num, 100).collect()}
    assert got == brute(rows, k, num, 100)


def test_groups_open_the_same_pairs(monkeypatch):
    """The bound of a group leaves open every pair that the bound of its members leaves open, in one block and between two."""
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 1 << 63, 200).astype(np.uint64)
        sets += [np.concatenate((base[: 200 - c], rng.integers(0, 1 << 63, c).astype(np.uint64))) for c in (0, 3, 8, 40)]
    n, comp, key = np.array([len(x) for x in sets]), np.arange(len(sets)) // 2, np.arange(len(sets))
    bits = np.stack([np.frombuffer(jaccard.parity(x), np.uint64) for x in sets])
    for side in (np.zeros(len(sets), int), key % 2):
        want = set()
        for i in key:
            for j in key:
                between = i < j if not side.any() else side[i] == 0 and side[j] == 1
                if between and comp[i] != comp[j] and jaccard._may_link(n[i], bits[i], n[j], bits[j], 90, 100):
                    want.add((min(i, j), max(i, j)))
        for cells in (1, 100, 1 << 15):
            monkeypatch.setattr(jaccard, "CELLS", cells)
            got = {tuple(sorted(map(int, p))) for a, b in jaccard._opened(key, comp, n, bits, side, 90, 100) for p in zip(a, b, strict=True)}
            assert got == want and (got or side.any())


def test_open_pairs_of_a_large_group_grow_with_its_size():
    """A row of copies that are all open with each other makes some pairs for each copy, the nearest, not all pairs."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    for size in (100, 200, 400):
        sets = [np.concatenate((base[: 298 - k % 3], rng.integers(0, 1 << 63, 2 + k % 3).astype(np.uint64))) for k in range(size)]
        for side in (np.zeros(size, int), np.repeat([0, 2], size)):  # as one block, and as a block with itself
            rows = [(5, 0, 0, int(s), j % size, j % size, 300, jaccard.parity(sets[j % size])) for j, s in enumerate(side)]
            cols = [pa.array(c, pa.binary() if j == 7 else pa.int64()) for j, c in enumerate(zip(*rows, strict=True))]
            batch = pa.RecordBatch.from_arrays(cols, names=["token", "a", "b", "side", "key", "comp", "n", "bits"])
            got = [tuple(r.values()) for b in jaccard._open_groups(90, 100)(iter([batch])) for r in b.to_pylist()]
            assert size - 1 <= len(got) <= 8 * size
            assert len({r[:2] for r in got}) == len(got) and all(r[0] < r[1] for r in got)
            assert {r[0] for r in got if r[2] == 5} == set(range(size - 8)) and {r[2] for r in got if r[0] > size - 9} == {None}


def test_copies_are_dealt_to_blocks_once(spark, monkeypatch):
    """Copies share many tokens, each with nearly the same classes: their rows are one, and in a band they grow as the group."""
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    rng = random.Random(19)
    for size in (64, 256):
        rows = [(t, j, True, True, 999, j) for t in range(40) for j in range(size) if rng.random() < 0.95]
        rows += [(100 + t, t * size + j, True, j < 3, 1000, t * size + j) for t in range(6) for j in range(size)]  # rows that have no class in common
        rows = spark.createDataFrame(rows, "token long, key long, heavy boolean, poor boolean, hub long, comp long")
        classes = spark.createDataFrame([(j, 1, b"") for j in range(6 * size)], "key long, n long, bits binary")
        one = jaccard._merged(rows)
        assert {r.token: r["count"] for r in one.groupBy("token").count().collect()} == {0: size} | {100 + t: size for t in range(6)}
        assert jaccard._blocks(rows.where("hub = 999"), classes, 2).count() > 100 * size  # each token's row on its own
        assert jaccard._blocks(one.where("hub = 999"), classes, 2, 2).count() <= 5 * size


def test_pairs_of_blocks_hold_every_pair(spark, monkeypatch):
    """Each pair of different components with a poor class meets; in a band the rows of a class stay as many."""
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(23)
    for size, poor, comps in ((150, 40, 150), (150, 150, 3), (90, 60, 40)):
        rows = [(5, j, True, j < poor, 999, 0 if rng.random() < 0.6 and comps < size else rng.randrange(comps)) for j in range(size)]
        left = spark.createDataFrame(rows, "token long, key long, heavy boolean, poor boolean, hub long, comp long")
        classes = spark.createDataFrame([(j, 1, b"") for j in range(size)], "key long, n long, bits binary")
        met, of = set(), {r[1]: r for r in rows}
        places = {}
        for r in jaccard._blocks(left, classes, 2).collect():
            places.setdefault((r.token, r.a, r.b), []).append((r.key, r.side))
        for members in places.values():
            met |= {tuple(sorted((x, y))) for x, s in members if s == 0 for y, t in members if t > 0 and (t == 1 or y > x)}
        assert met >= {(x, y) for y in range(size) for x in range(min(y, poor)) if of[x][5] != of[y][5]}
        assert jaccard._blocks(left, classes, 2, 2).count() <= 6 * size


@pytest.mark.parametrize("k, num", [(3, 90), (5, 80)])
def test_rounds_of_nearest_lose_no_link(spark, monkeypatch, k, num):
    monkeypatch.setattr(jaccard, "NEAREST", 1)
    monkeypatch.setattr(jaccard, "BLOCK", 32)
    monkeypatch.setattr(jaccard, "MANY", 8)
    labels, verify = [], jaccard._verify
    monkeypatch.setattr(jaccard, "_verify", lambda *a: labels.append(a[-1]) or verify(*a))
    rng = random.Random(17)
    base = [f"v{x}" for x in range(150)]
    rows = [(j, edited(base, 0.02, rng)) for j in range(120)]
    rows += [(1000 + j, " ".join(base + [f"z{j}_{x}" for x in range(45)])) for j in range(6)]  # hubs that no copy is similar to
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(docs_of(spark, rows), k, num, 100).collect()}
    assert got == brute(rows, k, num, 100)
    assert "links-4" in labels


def test_shared_passages(spark, monkeypatch):
    """Documents around one passage: rich ones by their own words, poor ones that are mostly passage, copies of both."""
    rng = random.Random(11)
    passage = [f"p{k}" for k in range(60)]
    rows = []
    for k in range(90):
        own = [f"w{rng.randrange(9000)}" for _ in range(rng.choice([3, 8, 12, 40, 200]))]
        rows.append((k, " ".join(passage + own)))
        if k % 3 == 0:
            rows.append((100 + k, " ".join(passage + own[: len(own) - 1] + [f"x{k}"])))
            rows.append((200 + k, edited(passage + own, 0.01, rng)))
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "MEMBERS", 4)
    for many, num, sample in ((4, 80, 64), (32, 80, 1)):  # sample of 1: each token of more than 16 classes is dealt to several tasks
        monkeypatch.setattr(jaccard, "MANY", many)
        monkeypatch.setattr(jaccard, "SAMPLE", sample)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(docs_of(spark, rows), 5, num, 100).collect()}
        assert got == brute(rows, 5, num, 100)


def test_sets_are_moved_by_shuffle_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    rows = near_rows()[:60]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(docs_of(spark, rows)).collect()}
    assert got == brute(rows, 3, 90, 100)


def test_matrix_in_passes(spark, monkeypatch):
    """No more than a share of the tokens is on its way at once, and the matrix has all that two classes share."""
    rng = random.Random(29)
    sets = {j: sorted({rng.randrange(900) * 7919 - 10**6 for _ in range(rng.randrange(1, 40))}) for j in range(150)}
    base = spark.createDataFrame([(j, t, len(t) // 2) for j, t in sets.items()], "key long, tokens array<long>, p int")
    written, stash = [], jaccard.stash
    monkeypatch.setattr(jaccard, "stash", lambda df, label, *a, **k: written.append((label, stash(df, label, *a, **k))) or written[-1][1])
    matrix = jaccard._matrix(base, 2)
    rows = sorted((r.token, r.key) for part in matrix for r in part.collect())
    times = Counter(t for s in sets.values() for t in s)
    assert rows == sorted((t, j) for j, s in sets.items() for t in s if times[t] > 1)
    assert max(table.count() for label, table in written if label == "matrix") <= 0.6 * len(rows)


def test_runs_by_loop():
    rng = np.random.default_rng(4)
    for many in (1, 2, 5):
        rows = sorted((int(t), int(s), int(k), 7) for t, s, k in zip(rng.integers(0, 30, 400), np.zeros(400), rng.integers(0, 9, 400), strict=True))
        rows = [(t, -1 if t < 20 else k % 3, k, p) for t, _, k, p in rows]
        rows.sort()
        want = []
        for t, s in sorted({r[:2] for r in rows}):
            keys = sorted({r[2] for r in rows if r[:2] == (t, s)})
            if len(keys) > 1 or s >= 0:
                want += [(t, k, 7, many + 1 if s >= 0 else min(len(keys), many + 1)) for k in keys]
        for size in (1, 3, 50, 1000):
            batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[a : a + size], strict=True)], names=list("tskp")) for a in range(0, len(rows), size)]
            got = [tuple(r.values()) for b in jaccard._runs(many)(iter(batches)) for r in b.to_pylist()]
            assert got == want


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 3, 90, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link(docs).collect()} == want


def test_edges(spark):
    rows = jaccard.link(docs_of(spark, EDGES)).collect()
    assert len(rows) == len(EDGES)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in rows}
    assert got == brute(EDGES, 3, 90, 100)
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[8][1] == 7
    assert jaccard.link(docs_of(spark, [])).count() == 0
    docs = docs_of(spark, EDGES)
    kept = jaccard.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 5, 6, 7, 9, 10, 11, 12] and kept.columns == docs.columns
    named = docs_of(spark, [(None, "a b c d e f g h i j k l m n o p q r s t u v"), (None, "a b c d e f g h i j k l m n o p q r s t u w"), (5, "a b c d e f g h i j k l m n o p q r s t u w x")])
    assert sorted((str(r.doc_id), r.component_id) for r in jaccard.link(named, 3, 80, 100).collect()) == [("5", 5), ("None", 5), ("None", 5)]
    texts = docs_of(spark, [(3, "a b c d e f g"), (3, "t u v w x y z"), (4, "a b c d e f g")])  # one doc_id, two texts
    assert sorted(r.text for r in jaccard.keep_one(texts).collect()) == ["a b c d e f g", "t u v w x y z"]
    twice = docs_of(spark, [(3, "a b c d e f g"), (3, "a b c d e f g"), (4, "a b c d e f g"), (None, "x y z"), (None, "x y z")])
    assert sorted(str(r.doc_id) for r in jaccard.keep_one(twice).collect()) == ["3", "None", "None"]


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 400), st.integers(0, 60), st.integers(0, 10**6), st.sampled_from([(90, 100), (80, 100)]))
def test_similar_sets_share_a_token(n, changes, seed, bound):
    num, den = bound
    rng = np.random.default_rng(seed)
    pool = rng.integers(0, 1 << 63, n + changes).astype(np.uint64)
    a, b = np.unique(pool[:n]), np.unique(pool[min(changes, n - 1) :])
    common = len(np.intersect1d(a, b))
    if den * common >= num * (len(a) + len(b) - common) and common < max(len(a), len(b)):
        x, y = (z[: jaccard.lengths(len(z), num, den)[0]] for z in (a, b))
        assert np.intersect1d(x, y).size
        # with as many more of each, as many more are in both
        more = rng.integers(0, 20)
        x, y = (z[: jaccard.lengths(len(z), num, den)[0] + more] for z in (a, b))
        assert np.intersect1d(x, y).size > min(more, common - 1)
        bits = [np.frombuffer(jaccard.parity(x), np.uint64) for x in (a, b)]
        assert jaccard._may_link(np.array(len(a)), bits[0], np.array(len(b)), bits[1], num, den)


def test_shingles_by_loop():
    texts = [t or "" for _, t in EDGES]
    for k in (3, 5):
        assert [len(h) for h in shingles(Words([t.encode() for t in texts]), k)] == [len(shingle_set(t, k)) for t in texts]
    w = Words([b"Same WORD here", b"", b"word same"])
    assert w.hashes[0] == w.hashes[4] and w.hashes[1] == w.hashes[3] and list(w.counts) == [3, 0, 2]


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200), (5, 5)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert roots == {**{k: 0 for k in range(1, 41)}, **{k: 100 for k in range(101, 160)}, 201: 200}
