"""Packing documents into fixed-length sequences by cutting-stock column generation.

A document's tokens are cut into whole sequences, one piece whose length is a multiple of ``UNIT`` and a tail
shorter than that, so pieces fall into fewer than 100 classes of equal length however many documents there are.
Over the histogram of classes a linear program picks patterns (how many pieces of each class fill a sequence):
columns are priced by a knapsack dynamic program over the duals, until none has negative reduced cost.  Patterns
are used floor(x) times and the few pieces left are filled in greedily, largest first.

Pieces are ranked within their class (place in their partition plus the partition's offset), and a rank alone says
which pattern, which copy of it and which place a piece gets.  All pieces of a class have one length, so the
offset in the sequence follows too: nothing but counts is shuffled.

Defined results: a null text is empty and packs its end token alone; repeated rows are packed each; ties in rank
follow the order of the input's files; an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.scratch import stash

CAPACITY, UNIT, END = 2048, 32, 1
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part long, cls long, rank long"


def vocabulary() -> str:
    """The default vocabulary's path, as ranks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level vocabulary at ``path``; its ids are those of the tokenizers file of the same name."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def cut(n: int, capacity: int = CAPACITY, unit: int = UNIT) -> list[int]:
    """Lengths of a document's pieces."""
    rest = n % capacity
    return [capacity] * (n // capacity) + [x for x in (rest - rest % unit, rest % unit) if x]


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(path).encode_ordinary, TaskContext.get().partitionId()
        seen: dict[int, int] = {}
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), END], "<u4")
                at = 0
                for length in cut(len(ids)):
                    rank = seen.get(length, 0)
                    seen[length] = rank + 1
                    rows.append((doc, at, length, zlib.crc32(ids[at : at + length].tobytes()), len(ids), part, length, rank))
                    at += length
            if rows:
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "cls", "rank"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

    return run


def price(lengths: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of greatest worth: unbounded knapsack, each length in binary multiples."""
    items = [(k, m) for k in range(len(lengths)) if worth[k] > 1e-12 for m in (1 << j for j in range(12)) if m * lengths[k] <= capacity]
    best, took = np.zeros(capacity + 1), np.zeros((len(items), capacity + 1), bool)
    for i, (k, m) in enumerate(items):
        w = int(m * lengths[k])
        with_it = best[: capacity + 1 - w] + m * worth[k]
        better = with_it > best[w:] + 1e-12
        took[i, w:] = better
        best[w:] = np.where(better, with_it, best[w:])
    pattern, room = np.zeros(len(lengths), np.int64), capacity
    for i in range(len(items) - 1, -1, -1):
        if took[i, room]:
            k, m = items[i]
            pattern[k] += m
            room -= int(m * lengths[k])
    return float(best[capacity]), pattern


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int = CAPACITY, rounds: int = 2000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used; together they hold exactly ``counts`` pieces of each length."""
    k = len(lengths)
    if not k:
        return []
    basis = np.diag((capacity // lengths).astype(float))
    x = counts / np.diag(basis)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        x = np.maximum(inverse @ counts, 0)
        value, pattern = price(lengths, np.ones(k) @ inverse, capacity)
        if value <= 1 + 1e-7:
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = pattern
    used: dict[tuple, int] = {}
    left = counts.astype(np.int64).copy()
    for column, times in sorted(((tuple(int(round(v)) for v in basis[:, j]), x[j]) for j in range(k)), key=lambda p: -p[1]):
        pattern = np.array(column)
        most = min([int(left[i] // n) for i, n in enumerate(column) if n], default=0)
        if n := min(int(np.floor(times + 1e-6)), most):
            used[column] = used.get(column, 0) + n
            left -= n * pattern
    order = np.argsort(-lengths)
    while left.any():  # largest first; a filling is repeated while the pieces last
        room, pattern = capacity, np.zeros(k, np.int64)
        for i in order:
            n = min(int(left[i]), room // int(lengths[i]))
            pattern[i], room = n, room - n * int(lengths[i])
        n = min(int(left[i] // pattern[i]) for i in range(k) if pattern[i])
        used[tuple(map(int, pattern))] = used.get(tuple(map(int, pattern)), 0) + n
        left -= n * pattern
    return [(np.array(p), n) for p, n in used.items()]


def places(lengths: np.ndarray, plan: list[tuple[np.ndarray, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """Per length: from which rank on which pattern takes how many a copy, its first sequence and its first offset."""
    out: dict[int, list[tuple[int, ...]]] = {int(x): [] for x in lengths}
    next_rank, base = dict.fromkeys(out, 0), 0
    for pattern, copies in plan:
        at = 0
        for k, n in enumerate(pattern):
            if n:
                size = int(lengths[k])
                out[size].append((next_rank[size], int(n), base, at))
                next_rank[size] += int(n) * copies
                at += int(n) * size
        base += copies
    return {k: tuple(np.array(c, np.int64) for c in zip(*v, strict=True)) for k, v in out.items() if v}


def _assign(table: dict[int, tuple[np.ndarray, ...]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("cls", "rank", "ahead")}
            rank, sequence, offset = cols["rank"] + cols["ahead"], np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for size in np.unique(cols["cls"]):
                rows = np.flatnonzero(cols["cls"] == size)
                first, per, base, at = table[int(size)]
                p = np.searchsorted(first, rank[rows], "right") - 1
                past = rank[rows] - first[p]
                sequence[rows] = base[p] + past // per[p]
                offset[rows] = at[p] + past % per[p] * size
            kept = [batch.column(n) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, text: str = "text", vocab: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = stash(source.mapInArrow(_pieces(vocab or vocabulary()), _PIECES), "pieces")
    counts = stash(pieces.groupBy("part", "cls").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = sorted((r["cls"], r["n"]) for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect())  # under 100 rows
    lengths, totals = (np.array([r[k] for r in histogram], np.int64) for k in (0, 1))
    table = places(lengths, solve(lengths, totals))
    before = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select(F.col("part").alias("c_part"), F.col("cls").alias("c_cls"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    ranked = pieces.join(ahead, (F.col("part") == F.col("c_part")) & (F.col("cls") == F.col("c_cls")))
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "cls", "rank", "ahead").mapInArrow(_assign(table), out)
