from __future__ import annotations

import __spark_entry__ as entry
from common import EDGES, docs_of, words
from oracle import assert_same, connect
from pyspark.sql import functions as F

from barloom.llm import oracles, quality, queries


def repeat_words(w):
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)})


def raw_words(t):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_matches_sql(spark, sf_dir):
    con = connect(sf_dir)
    for name in oracles.ORACLES:
        assert_same(queries.QUERIES[name](spark, sf_dir).toPandas(), con.execute(oracles.ORACLES[name]).df())
    assert set(oracles.ORACLES) <= set(entry.oracle_sql()) and "op2_quality_ledger" in entry.queries()


def test_edges_by_loop(spark):
    rows = [*EDGES, (20, "a b c d e f a b c d e f g h"), (21, "l1 x\nl2\n\nl1 x\nl1 x\n \n "), (22, "A# $b *%& <c> | d " * 4)]
    got = quality.ledger(docs_of(spark, rows), ["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        w, t = raw_words(r.text), r.text or ""
        lines = [x for x in t.split("\n") if raw_words(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), repeat_words(w))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in t) and r.n_dup_lines == len(lines) - len(set(lines))
    assert quality.ledger(docs_of(spark, []), ["doc_id"]).count() == 0


def test_policies_and_ablation(spark):
    good = "This is a plain text with more than ten words in one line of prose. "
    docs = docs_of(spark, [(1, good), (2, "too short"), (3, "SHOUT " * 3 + " ".join(f"W{k}X" for k in range(20)).upper()), (4, " ".join(f"w{k}%%%" for k in range(20))), (5, None)])
    kept = quality.keep_passing(docs)
    assert [r.doc_id for r in kept.collect()] == [1] and kept.columns == docs.columns
    assert {r.doc_id for r in quality.keep_passing(docs, "v1").collect()} == {1, 3, 4}
    book = quality.ledger(docs, ["doc_id"])
    rows = {r.rule: r for r in quality.ablation(book).collect()}
    total = book.where(quality.passes(F.col("fail_bits"))).count()
    bits = [r.fail_bits for r in book.collect()]
    for k, rule in enumerate(quality.RULES):
        assert rows[rule].n_failed == sum(b >> k & 1 for b in bits)
        assert rows[rule].n_failed_alone == sum(b == 1 << k for b in bits)
        assert rows[rule].n_kept_without == total + rows[rule].n_failed_alone
    assert quality.mask("v1") == 3


def test_no_python_in_the_plan(spark, sf_dir):
    plan = queries.op2_quality_ledger(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
