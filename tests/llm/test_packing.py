from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from common import EDGES, docs_of

from barloom.llm import packing


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [np.array([*e.ids, 1], "<u4") for e in t.encode_batch(texts, add_special_tokens=False)]


def check(rows, ids):
    """rows: pieces; ids: the documents' ids, by doc_id."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.start)
        assert [p.start for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1]]
        for p in pieces:
            assert p.doc_tokens == len(ids[d]) and p.ids_crc32 == zlib.crc32(ids[d][p.start : p.start + p.length].tobytes())
        assert sum(p.length for p in pieces) == len(ids[d])
    padding = 0
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1]]
        total = sum(p.length for p in pieces)
        assert total <= 2048
        padding += 0 if total & (total - 1) == 0 else 2048 - total
    return padding


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    ids = dict(zip([d for d, _ in texts], reference_ids([t for _, t in texts]), strict=True))
    rows = packing.pack(docs).collect()
    assert check(rows, ids) <= max(2048, 0.005 * sum(map(len, ids.values())))


def test_edges(spark):
    rows = [(k, t) for k, (_, t) in enumerate(EDGES)] + [(90, "<|endoftext|> it's 1234   x"), (91, "a" * 20000)]
    ids = dict(zip([d for d, _ in rows], reference_ids([t or "" for _, t in rows]), strict=True))
    check(packing.pack(docs_of(spark, rows)).collect(), ids)
    assert packing.pack(docs_of(spark, [])).count() == 0
    assert sum(r.length for r in packing.pack(docs_of(spark, EDGES)).where("doc_id = 8").collect()) == 2 * len(ids[7])


@pytest.mark.parametrize("seed", range(3))
def test_plan_holds_all_pieces_with_little_waste(seed):
    rng = np.random.default_rng(seed)
    lengths = np.sort(rng.choice(np.arange(1, 2049), 60, replace=False))
    counts = rng.integers(1, 5000, 60)
    plan = packing.solve(lengths, counts)
    assert (sum(p * n for p, n in plan) == counts).all() and all((p * lengths).sum() <= 2048 for p, _ in plan)
    left, first_fit = counts.copy(), 0  # largest first, patterns repeated while they last
    while left.any():
        room, pattern = 2048, np.zeros(60, int)
        for i in range(59, -1, -1):
            pattern[i] = min(left[i], room // lengths[i])
            room -= pattern[i] * lengths[i]
        n = min(left[i] // pattern[i] for i in range(60) if pattern[i])
        left -= n * pattern
        first_fit += n
    assert sum(n for _, n in plan) <= first_fit + 60
    value, pattern = packing.price(np.array([3, 5]), np.array([3.0, 5.2]), 11)
    assert (pattern * [3, 5]).sum() <= 11 and value == pytest.approx(5.2 + 6)
