"""Language-model scores of whole documents: corpus counts of every word, and a gated recurrent network.

Tokens are lower-cased words and one end a document.  Counts cover all training documents (crc32 of doc_id mod 7 is not
2); they give the base score and the chances of rare words.  The network models the ``CLASSES * SIZE - 1`` most
frequent words and the end; any other word belongs to one of a few rare classes by its bytes (other than ASCII, with
punctuation at its end, with symbols) and within it has chance (c + 1) / (N_r + V_r + 1); a word never seen gets
what its class leaves over, 1 / (N_r + V_r + 1), so that is one chance for any such word and not one shared among them.

The network learns from every training document.  It starts from ``epochs`` passes on the driver over a bounded sample,
the ``max_docs`` training documents with the smallest seeded hash of doc_id, whole; then all training documents are dealt
by their hash to shares of about ``SHARE`` tokens, each share trains its own copy in one task, and the copies are averaged
by their tokens.  So the tasks grow with the corpus, and the memory of a task doesn't.  Counts, vocabulary and output
biases come from all training documents.  Scoring carries the state through each whole document.  Texts are turned into
ids once, in a stored table that both training and scoring read.

Counts of frequent words (at most ``TABLE`` of them, by a count threshold) are sent to all tasks; other words are looked
up by a join on their hash, so the vocabulary may grow without bound.  Words are told apart by 64-bit hashes.

Defined results: a null text is one end token; repeated rows are scored each; ties in frequency go by hash;
without training documents N and V are 0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import copy
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.gru import Gru
from barloom.llm.scratch import drop, stash
from barloom.llm.words import Words, groups

CLASSES, SIZE, HIDDEN, RARE = 64, 64, 24, 8
TABLE, MAX_DOCS, EPOCHS, SEED = 1 << 18, 2000, 2, "lm-1"
SHARE, LANES, PIECES = 1 << 22, 128, 16
MODULUS, HELD = 7, 2
END_HASH = 0x454E44  # no word's: hashes are mixed, and the end is counted under this number alone

_ASCII, _POINT, _SYMBOL = (np.zeros(256, bool) for _ in range(3))
_ASCII[128:] = True
_POINT[[ord(c) for c in ".,;:!?"]] = True
_SYMBOL[[ord(c) for c in "#*$%&|<>!=_/\\@+0123456789"]] = True


def kinds(w: Words) -> np.ndarray:
    """The rare class of each word, from its bytes."""
    data, first, last = w.data, w.first, w.last
    if not len(first):
        return np.zeros(0, np.int64)
    any_of = lambda flags: np.add.reduceat(flags[data].astype(np.int32), np.column_stack((first, last)).ravel())[::2] > 0
    return any_of(_ASCII) * 1 + _POINT[data[last - 1]] * 2 + any_of(_SYMBOL) * 4


def _held_out(column) -> F.Column:
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit(""))), F.lit(MODULUS)) == HELD


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, kind, n) of the task's documents, merged as they come."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    size = 0

    def merge() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, k, n = (np.concatenate(x) for x in zip(*held, strict=True))
        names, first, at = np.unique(h, return_index=True, return_inverse=True)
        return names, k[first], np.bincount(at, n, len(names)).astype(np.int64)

    def out(rows: tuple[np.ndarray, np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(rows[0]), 1 << 18):
            h, k, n = (x[a : a + (1 << 18)] for x in rows)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k.astype(np.int64)), pa.array(n)], names=["word", "kind", "n"])

    for batch in batches:
        for _, texts in groups(batch.column(0)):
            w = Words(texts)
            names, first, n = np.unique(w.hashes, return_index=True, return_counts=True)
            held.append((names, kinds(w)[first], n))
            held.append((np.array([END_HASH], np.uint64), np.zeros(1, np.int64), np.array([len(texts)])))
            size += len(names)
            if size > 1 << 20:
                held = [merge()]
                size = len(held[0][0])
                if size > 1 << 20:
                    yield from out(held[0])
                    held, size = [], 0
    if held:
        yield from out(merge())


class Vocabulary:
    """The frequent words: names (sorted hashes), counts, kinds, ids (of the network, or -1); totals of all words."""

    def __init__(self, names, counts, word_kinds, ids, tokens: int, distinct: int, rare_tokens, rare_distinct):
        self.names, self.counts, self.kinds, self.ids = names, counts, word_kinds, ids
        self.tokens, self.distinct, self.rare_tokens, self.rare_distinct = tokens, distinct, rare_tokens, rare_distinct

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.names, hashes)
        at[at == len(self.names)] = 0
        return at, (self.names[at] == hashes if len(self.names) else np.zeros(len(hashes), bool))

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / (self.tokens + self.distinct + 1))

    def network_ids(self, w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids for the network; places in the table, and whether they hold the words."""
        at, known = self.find(w.hashes)
        ids = np.where(known, self.ids[at], -1) if len(self.names) else np.full(len(at), -1)
        return np.where(ids >= 0, ids, CLASSES * SIZE + kinds(w)), at, known


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, int]:
    """The table of frequent words, and the least count that a word in it has."""
    by_count = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens"))
    by_count = stash(by_count, "lm-by-count")
    total = by_count.agg(F.sum("tokens"), F.sum("words")).first()
    tokens, distinct = int(total[0] or 0), int(total[1] or 0)
    # the least count such that no more than TABLE words reach it; different counts are few (their sum is at most the tokens)
    most = int(by_count.agg(F.max("n")).first()[0] or 0)
    reach = by_count.select("n", F.sum("words").over(Window.orderBy(F.desc("n"))).alias("reach"))
    low = reach.where(F.col("reach") <= TABLE).agg(F.min("n")).first()[0] or most + 1
    rows = counts.where((F.col("n") >= low) | (F.col("word") == END_HASH)).toArrow()  # the end is the network's, however rare
    h, k, n = (rows.column(c).to_numpy() for c in ("word", "kind", "n"))
    h = h.view(np.uint64)
    order = np.argsort(h)
    h, k, n = h[order], k[order], n[order]
    ids = np.full(len(h), -1, np.int64)
    ranked = np.lexsort((h, -n))
    ranked = ranked[h[ranked] != END_HASH][: CLASSES * SIZE - 1]
    ids[ranked] = np.arange(1, len(ranked) + 1)
    ids[h == END_HASH] = 0
    sums = {r["kind"]: (r["t"], r["v"]) for r in counts.groupBy("kind").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("v")).collect()}
    rare_t, rare_v = (np.array([sums.get(j, (0, 0))[i] for j in range(RARE)], np.float64) for i in (0, 1))
    in_net = ids >= 0
    rare_t -= np.bincount(k[in_net], n[in_net], RARE)
    rare_v -= np.bincount(k[in_net], minlength=RARE)
    drop(by_count)
    return Vocabulary(h, n.astype(np.float64), k, ids, tokens, distinct, rare_t, rare_v), low


CODED = "uid long, turn long, doc_id long, held_out boolean, n_tokens long, known long, base double, inner double, rare array<long>, times array<int>, ids binary"


def _coded(words):
    """Each document's network ids and its end as 16-bit numbers, and what the table of counts gives to its scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = words.value
        row, part = 0, TaskContext.get().partitionId()
        chance = np.log10(1 / (vocab.rare_tokens + vocab.rare_distinct + 1))
        at_end, ended = vocab.find(np.array([END_HASH], np.uint64))
        end_count = float(vocab.counts[at_end[0]]) if ended[0] else 0.0
        end_base = float(vocab.base(np.array([end_count]))[0])
        for batch in batches:
            for first, texts in groups(batch.column(3)):
                w = Words(texts)
                ids, at, seen = vocab.network_ids(w)
                n = np.where(seen, vocab.counts[at], 0.0) if len(vocab.names) else np.zeros(len(at))
                b = np.where(seen, vocab.base(n), 0.0)
                outside = ids >= CLASSES * SIZE
                kind = np.where(outside, ids - CLASSES * SIZE, 0)
                s = np.where(outside, np.where(seen, np.log10(n + 1), 0.0) + chance[kind], 0.0)  # others' counts come by the join
                sums = [np.concatenate(([0.0], np.cumsum(x))) for x in (b, s, seen)]
                base, inner, known = (x[w.begin[1:]] - x[w.begin[:-1]] for x in sums)
                short = ids.astype(np.int16)
                rows, rare, times = [], [], []
                for a, count in zip(w.begin[:-1], w.counts, strict=True):
                    rows.append(np.append(short[a : a + count], np.int16(0)).tobytes())
                    names, reps = np.unique(w.hashes[a : a + count][~seen[a : a + count]], return_counts=True)
                    rare.append(names.view(np.int64))
                    times.append(reps.astype(np.int32))
                uid = (part << 33) + row + np.arange(len(rows))
                row += len(rows)
                cols = [
                    pa.array(uid, pa.int64()), *(batch.column(c).slice(first, len(rows)) for c in range(3)), pa.array(w.counts + 1, pa.int64()), pa.array(np.rint(known).astype(np.int64) + (end_count > 0), pa.int64()),
                    pa.array(base + end_base, pa.float64()), pa.array(inner, pa.float64()), pa.array(rare, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32())), pa.array(rows, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in CODED.split(", ")])

    return run


def _learn(net):
    """(piece, turn, tokens, weights) of a copy of the network that was trained on the task's documents, all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[np.ndarray] = []
        turn = None
        for batch in batches:
            turn = batch.column(0)[0].as_py() if turn is None and len(batch) else turn
            docs += [np.frombuffer(x.as_py(), np.int16) for x in batch.column(1)]
        if not docs:
            return
        own = copy.deepcopy(net.value)  # workers are used again, so the one that was sent stays as it is
        tokens = sum(map(len, docs))
        own.train(docs, 0, 1, lanes=min(LANES, max(8, tokens >> 13)))  # fewer lanes make more steps of a small share
        for k, part in enumerate(np.array_split(own.flat(), PIECES)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([turn], pa.int64()), pa.array([tokens], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["piece", "turn", "tokens", "weights"]
            )

    return run


def _mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, weights): means of the copies' weights, by their tokens."""
    sums: dict[int, np.ndarray] = {}
    tokens: dict[int, int] = {}
    for batch in batches:
        for k, _, n, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            sums[k] = sums.get(k, 0.0) + np.frombuffer(part, np.float32).astype(np.float64) * n
            tokens[k] = tokens.get(k, 0) + n
    if sums:
        rows = [(x / tokens[k]).astype(np.float32).tobytes() for k, x in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(rows, pa.binary())], names=["piece", "weights"])


def fit(coded: DataFrame, words: Vocabulary, max_docs: int, epochs: int) -> Gru:
    """The network of the coded training documents: started on a bounded sample of whole ones on the driver, then trained on all in tasks."""
    spark = coded.sparkSession
    coded = coded.select("turn", "ids")
    last = coded.select("turn").orderBy("turn").limit(max_docs).agg(F.max("turn")).first()[0]
    net = Gru(CLASSES, SIZE, RARE, HIDDEN)
    counts = np.zeros(CLASSES * SIZE + RARE)
    np.add.at(counts, words.ids[words.ids >= 0], words.counts[words.ids >= 0])
    counts[CLASSES * SIZE :] = np.maximum(words.rare_tokens, 0)
    net.start_from(counts)
    if last is None:
        return net
    rows = [(r["turn"], bytes(r["ids"])) for r in coded.where(F.col("turn") <= last).collect()]
    rows.sort()
    net.train([np.frombuffer(ids, np.int16) for _, ids in rows[:max_docs]], 0, epochs)
    shares = -(-words.tokens // SHARE)
    dealt = coded.repartition(shares, "turn", "ids").sortWithinPartitions("turn", "ids")
    learned = dealt.mapInArrow(_learn(spark.sparkContext.broadcast(net)), "piece int, turn long, tokens long, weights binary")
    means = learned.repartition(PIECES, "piece").sortWithinPartitions("piece", "turn").mapInArrow(_mean, "piece int, weights binary").collect()
    net = copy.deepcopy(net)
    net.set_flat(np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(means, key=lambda r: r["piece"])]))
    return net


def _score(net):
    """The coded rows with the network's log10 probability in place of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *rest, ids = batch.columns
            docs = [np.frombuffer(x.as_py(), np.int16) for x in ids]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(net.value.score(docs, 0) / np.log(10), pa.float64())], names=[*batch.schema.names[:-1], "net"])

    return run


def score(docs: DataFrame, max_docs: int = MAX_DOCS, epochs: int = EPOCHS, seed: str = SEED, text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out(F.col("doc_id")).alias("held_out"), F.col(text).alias("text"))
    training = source.where("not held_out")
    counts = training.select("text").mapInArrow(_count, "word long, kind long, n long").groupBy("word").agg(F.min("kind").alias("kind"), F.sum("n").alias("n"))
    counts = stash(counts, "lm-counts")
    words, least = vocabulary(counts)
    turn = F.xxhash64(F.lit(seed), "doc_id")
    sent = spark.sparkContext.broadcast(words)  # TABLE words at most
    coded = stash(source.select(turn.alias("turn"), "doc_id", "held_out", "text").mapInArrow(_coded(sent), CODED), "lm-coded")
    net = spark.sparkContext.broadcast(fit(coded.where("not held_out"), words, max_docs, epochs))  # of fixed size
    kept = coded.drop("turn", "rare", "times")
    judged = stash(kept.mapInArrow(_score(net), kept.drop("ids").withColumn("net", F.lit(0.0)).schema), "lm-scores")
    scale = float(words.tokens + words.distinct + 1)
    each = coded.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("r"), F.col("x.times").cast("double").alias("k"))
    seldom = counts.where(F.col("n") < least).select("word", F.col("n").cast("double").alias("c"))
    met = each.join(seldom, F.col("r") == F.col("word"), "left")
    c = F.coalesce("c", F.lit(0.0))
    more = met.groupBy("uid").agg(
        F.sum(F.col("k") * F.log10((c + 1) / F.lit(scale))).alias("b"), F.sum(F.col("k") * F.log10(c + 1)).alias("s"), F.sum(F.when(c > 0, F.col("k")).otherwise(0.0)).cast("long").alias("m")
    ).withColumnRenamed("uid", "u")
    full = judged.join(more, F.col("uid") == F.col("u"), "left")
    return full.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("m", F.lit(0))).alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("b", F.lit(0.0))).alias("base_score"), (F.col("net") + F.col("inner") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )
