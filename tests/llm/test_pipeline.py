from __future__ import annotations

from collections import Counter

import corpus_pipeline
import numpy as np
from common import words
from test_jaccard import brute
from test_packing import check, reference_ids

from barloom.llm import mixing, quality, secrets
from barloom.llm.packing import encoder, vocabulary


def test_pipeline_against_a_plain_version(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and corpus_pipeline.ORACLE_SQL is None
    kept = {r.doc_id: r for r in docs.collect()}
    bits = {r.doc_id: r.fail_bits for r in quality.ledger(docs, ["doc_id"]).collect()}
    kept = {d: r for d, r in kept.items() if bits[d] == 0}
    roots = brute([(d, r.text) for d, r in kept.items()], 5, 80, 100)
    kept = {d: r for d, r in kept.items() if not roots[d][0] or roots[d][1] == d}
    encode = encoder(vocabulary()).encode_ordinary
    texts = {d: secrets.mask(r.text, secrets.find(r.text, encode)[1]) for d, r in kept.items()}
    mixed = mixing.mix(spark.createDataFrame([(d, t, kept[d].source) for d, t in texts.items()], "doc_id long, text string, source string")).collect()
    times = Counter({r.doc_id: r.whole + (1 if r["size"] and 2 * r.part >= r["size"] else 0) for r in mixed})
    ids = dict(zip(texts, reference_ids(list(texts.values())), strict=True))
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    tokens = Counter()
    for r in rows:
        tokens[r.doc_id] += r.length
    assert tokens == Counter({d: len(ids[d]) * n for d, n in times.items() if n})
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        assert [p.offset for p in pieces] == [0, *np.cumsum([p.length for p in pieces])[:-1]] and sum(p.length for p in pieces) <= 2048
    assert check and words


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf_dir).columns == docs.columns
