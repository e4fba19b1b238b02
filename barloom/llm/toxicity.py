"""Severity of toxicity by cumulative-link ordinal regression on sparse text features.

Grades come from ``labels``: 0 not toxic, 1 toxic, 2 toxic in a text that is also of low quality.  One weight vector is
shared by all thresholds: P(grade >= k) = sigmoid(w.x - theta_k) with increasing theta; the expected severity is the sum
of these probabilities.  Features are a text's distinct words and their first three to seven bytes, hashed;
those that tell toxic from other texts apart (|z| >= ``MIN_Z``) are kept.

The model is fitted on a bounded sample: the ``max_rows`` labelled documents with the smallest seeded hash of doc_id
(all, where there are fewer), at most ``MAX_FEATURES`` features.  Scoring covers every text whole.

Defined results: a null text has no features and gets the intercept's severity; repeated rows are scored each;
labels without a document, and null labels, are ignored; of several labels of one document the highest grade counts;
without labels every probability is 0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.scratch import drop, stash
from barloom.llm.words import Words, groups, mix

MAX_ROWS, MAX_FEATURES, MIN_Z, MIN_COUNT, GRADES, DECAY = 20_000, 16_384, 3.0, 3, 3, 2e-3
STARTS = (3, 4, 5, 6, 7)


def features(texts: list[bytes]) -> list[np.ndarray]:
    """Each text's distinct features, sorted."""
    w = Words(texts)
    all_of = np.stack([w.hashes, *(mix(w.pieces(w.first, np.minimum(w.last, w.first + k)) + np.uint64(k)) for k in STARTS)])
    return [np.unique(all_of[:, a : a + n]) for a, n in zip(w.begin[:-1], w.counts, strict=True)]


class Model:
    """names: sorted feature hashes; weights; theta: thresholds."""

    def __init__(self, names: np.ndarray, weights: np.ndarray, theta: np.ndarray):
        self.names, self.weights, self.theta = names, weights, theta

    def places(self, found: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.names, found)
        at[at == len(self.names)] = 0
        return at[self.names[at] == found] if len(self.names) else at[:0]

    def at_least(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k), k = 1.. in columns."""
        return 1 / (1 + np.exp(np.clip(self.theta[None] - score[:, None], -60, 60)))


def fit(names: np.ndarray, rows: list[np.ndarray], grades: np.ndarray, rounds: int = 300, decay: float = 1e-4, scale: np.ndarray | None = None) -> Model:
    """Maximum penalized likelihood by full-batch gradient steps; ``rows`` are places in ``names``.

    A weight is ``scale`` times the parameter that is penalized: telling features are held back less.
    """
    k = GRADES - 1
    if not len(grades):
        return Model(names[:0], np.zeros(0), np.full(k, 60.0))
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share = np.array([((grades >= j + 1).sum() + 0.5) / (len(grades) + 1) for j in range(k)])
    start = -np.log(share / (1 - share))
    p = np.concatenate((np.zeros(len(names)), start[:1], np.log(np.maximum(np.diff(start), 0.05))))
    m, v, n = np.zeros_like(p), np.zeros_like(p), len(names)
    scale = np.ones(n) if scale is None else scale
    for t in range(1, rounds + 1):
        theta = np.cumsum(np.concatenate((p[n : n + 1], np.exp(p[n + 1 :]))))
        score = np.bincount(of, (p[:n] * scale)[flat], len(rows))
        tail = 1 / (1 + np.exp(np.clip(theta[None] - score[:, None], -60, 60)))
        edge = np.concatenate((np.ones((len(rows), 1)), tail, np.zeros((len(rows), 1))), axis=1)
        own, above = edge[np.arange(len(rows)), grades], edge[np.arange(len(rows)), grades + 1]
        chance = np.maximum(own - above, 1e-12)
        slope = own + above - 1  # of the loss by the score
        by_theta = np.zeros((len(rows), k + 2))
        by_theta[np.arange(len(rows)), grades] += own * (1 - own) / chance
        by_theta[np.arange(len(rows)), grades + 1] -= above * (1 - above) / chance
        d = by_theta.mean(0)[1 : k + 1]
        grad = np.concatenate((
            scale * np.bincount(flat, slope[of], n)[:n] / len(rows) + decay * p[:n],
            [d.sum()], [d[j + 1 :].sum() * np.exp(p[n + 1 + j]) for j in range(k - 1)],
        ))
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        p -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Model(names, p[:n] * scale, np.cumsum(np.concatenate((p[n : n + 1], np.exp(p[n + 1 :])))))


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in groups(batch.column(1)):
            found = [x.view(np.int64) for x in features(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(found)), pa.array(found, pa.list_(pa.int64()))], names=["grade", "found"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of toxic and of other texts, counted in the task."""
    for batch in batches:
        grade = batch.column(0).to_numpy(zero_copy_only=False)
        found = batch.column(1)
        flat, sizes = found.flatten().to_numpy(zero_copy_only=False), np.diff(found.offsets.to_numpy())
        names, at = np.unique(flat, return_inverse=True)
        toxic = np.repeat(grade > 0, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(np.bincount(at, toxic, len(names)).astype(np.int64)), pa.array(np.bincount(at, ~toxic, len(names)).astype(np.int64))], names=["f", "a", "b"])


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, seed: str = "tox-1", text: str = "text") -> Model:
    grade = F.when(F.col("toxic") > 0, F.when(F.col("quality") == 0, 2).otherwise(1)).otherwise(0)
    named = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max(grade).cast("long").alias("grade"))
    known = named.join(docs.select(F.col("doc_id").cast("long").alias("l_id")).distinct(), "l_id", "left_semi")
    picked = known.orderBy(F.xxhash64(F.lit(seed), "l_id"), "l_id").limit(max_rows)
    picked = stash(picked, "labelled")  # at most max_rows rows of two numbers: small enough to send to all
    texts = docs.join(F.broadcast(picked), docs["doc_id"].cast("long") == picked["l_id"]).select("grade", F.col(text).alias("text"))
    sample = stash(texts.mapInArrow(_features_of, "grade long, found array<long>"), "labelled-features")
    totals = {r["grade"]: r["n"] for r in sample.groupBy("grade").agg(F.count(F.lit(1)).alias("n")).collect()}
    good, bad = totals.get(0, 0), sum(n for g, n in totals.items() if g)
    if not good + bad:
        drop(picked, sample)
        return fit(np.zeros(0, np.uint64), [], np.zeros(0, np.int64))
    counted = sample.mapInArrow(_counts, "f long, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    share = (F.col("a") + F.col("b")) / F.lit(float(good + bad))
    spread = F.sqrt(F.greatest(F.lit(float(bad)) * share * (1 - share) * F.lit(good / (good + bad)), F.lit(1e-9)))
    z = F.abs((F.col("a") - F.lit(float(bad)) * share) / spread)
    told = counted.where(F.col("a") + F.col("b") >= MIN_COUNT).select("f", "a", "b", z.alias("z")).where(F.col("z") >= MIN_Z)
    best = told.orderBy(F.desc("z"), "f").limit(MAX_FEATURES).toPandas()
    names = best["f"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(names)
    odds = np.abs(np.log((best["a"].to_numpy() + 0.5) / (bad + 1)) - np.log((best["b"].to_numpy() + 0.5) / (good + 1)))
    names, odds = names[order], odds[order]
    blank = Model(names, np.zeros(len(names)), np.zeros(GRADES - 1))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [blank.places(np.asarray(x.values).view(np.uint64)).astype(np.int32) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], names=["grade", "at"])

    rows = sample.mapInArrow(placed, "grade long, at array<int>").toArrow().combine_chunks()
    grades, lists = rows.column("grade").to_numpy(), rows.column("at").combine_chunks()
    ends, flat = np.asarray(lists.offsets), lists.values.to_numpy()
    places = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    order = np.lexsort(([int(x.sum(dtype=np.int64)) for x in places], [len(x) for x in places], grades))  # not that of arrival
    model = fit(names, [places[i] for i in order], grades[order], decay=DECAY, scale=odds)
    drop(picked, sample)
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """One row per document: doc_id, expected_severity, p_toxic, p_severe, grade (the likeliest), toxic (p_toxic > 0.5)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in groups(batch.column(1)):
                s = np.array([model.weights[model.places(x)].sum() for x in features(texts)])
                tail = model.at_least(s)
                edge = np.concatenate((np.ones((len(s), 1)), tail, np.zeros((len(s), 1))), axis=1)
                grade = np.argmax(edge[:, :-1] - edge[:, 1:], axis=1)
                cols = [pa.array(tail.sum(1)), pa.array(tail[:, 0]), pa.array(tail[:, -1]), pa.array(grade, pa.int64()), pa.array(tail[:, 0] > 0.5)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(s)), *cols], names=["doc_id", "expected_severity", "p_toxic", "p_severe", "grade", "toxic"])

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    return picked.mapInArrow(run, "doc_id long, expected_severity double, p_toxic double, p_severe double, grade long, toxic boolean")
