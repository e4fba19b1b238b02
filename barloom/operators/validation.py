"""Combinatorial purged cross-validation on samples with prediction and evaluation times.

Folds are neighbouring positions (sizes differ by one at most).  The C(n, k) choices of test folds are a small table;
purging and embargo are predicates on position and time, so the result is one long frame (round, pos, role).
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.schema import require_columns


def merge_folds(bounds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Neighbouring [start, end) folds merged to blocks."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(bounds):
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def back_test_paths(n_groups: int, n_test_splits: int) -> int:
    """How many whole paths the test folds of all rounds make up."""
    return math.comb(n_groups - 1, n_test_splits - 1)


@dataclass(frozen=True)
class CombPurgedKFold:
    """Splits ``n_groups`` folds into every choice of ``n_test_splits`` test folds, last choices first."""

    n_groups: int = 10
    n_test_splits: int = 2
    embargo_micros: int = 0

    def __post_init__(self):
        if not 1 <= self.n_test_splits <= self.n_groups - 1:
            raise ValueError("n_test_splits must lie between 1 and n_groups - 1")
        if self.embargo_micros < 0:
            raise ValueError("the embargo must not be negative")

    def rounds(self) -> list[tuple[int, ...]]:
        return list(itertools.combinations(range(self.n_groups), self.n_test_splits))[::-1]

    def bounds(self, n: int) -> list[tuple[int, int]]:
        """[start, end) of each fold."""
        size, more = divmod(n, self.n_groups)
        ends = list(itertools.accumulate(size + (k < more) for k in range(self.n_groups)))
        return list(zip([0, *ends[:-1]], ends, strict=True))

    def split(self, samples: DataFrame, pred: str = "pred_time", eval_: str = "eval_time") -> DataFrame:
        """(round, pos, role): role test or train; purged and embargoed positions are missing.

        Train samples before a test block are kept if evaluated before the block's first prediction; after a block, if they
        are predicted later than the embargo past the last evaluation of the test positions up to the block's end.
        """
        require_columns(samples, pred, eval_)
        micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
        numbered = samples.select(micros(pred).alias("p"), micros(eval_).alias("e"))
        numbered = numbered.select("p", "e", (F.row_number().over(Window.orderBy("p", "e")) - 1).alias("pos"))
        n = samples.count()
        spark, rows = samples.sparkSession, []
        for r, chosen in enumerate(self.rounds()):
            blocks = merge_folds([self.bounds(n)[f] for f in chosen])
            tests = [p for a, b in blocks for p in (a, b)]
            for a, b in blocks:
                # the first b of the round's test positions, whichever they are
                reach, seen = -1, 0
                for x, y in zip(tests[::2], tests[1::2], strict=True):
                    take = min(y - x, b - seen)
                    if take > 0:
                        reach, seen = x + take, seen + take
                rows.append((r, a, b, reach, [list(x) for x in blocks]))
        table = spark.createDataFrame(rows, "round int, a int, b int, reach int, blocks array<array<int>>")
        tested = F.exists("blocks", lambda x: (F.col("pos") >= x[0]) & (F.col("pos") < x[1]))
        table = F.broadcast(table)  # C(n_groups, n_test_splits) rounds of as many blocks at most
        first = numbered.select(F.col("pos").alias("fp"), F.col("p").alias("first_pred"))
        # latest evaluation among the block's share of test positions
        late = numbered.join(table, tested & (F.col("pos") < F.col("reach"))).groupBy("round", "a", "b").agg((F.max("e") + F.lit(self.embargo_micros)).alias("last"))
        counts = numbered.join(F.broadcast(late), F.col("p") <= F.col("last")).groupBy("round", "a", "b").agg(F.count(F.lit(1)).alias("m"))
        edges = table.join(counts, ["round", "a", "b"], "left").join(first, F.col("a") == F.col("fp"))
        edges = edges.select("round", "a", "b", "blocks", "first_pred", F.coalesce("m", F.lit(0)).alias("m"))
        before = (F.col("pos") < F.col("a")) & (F.col("e") < F.col("first_pred"))
        after = (F.col("pos") >= F.col("b")) & ((F.col("m") >= n) | (F.col("pos") >= F.col("m")))
        judged = numbered.join(F.broadcast(edges)).withColumn("test", tested).withColumn("ok", before | after)
        whole = judged.groupBy("round", "pos").agg(F.bool_and("test").alias("test"), F.bool_and("ok").alias("ok"))
        return whole.where("test or ok").select("round", "pos", F.when(F.col("test"), "test").otherwise("train").alias("role"))


def dealt_paths(cv: CombPurgedKFold, seed: int = 0) -> list[tuple[int, int, int]]:
    """(round, fold, path): the whole path that a round's test fold belongs to, in seeded random order."""
    n, rng = back_test_paths(cv.n_groups, cv.n_test_splits), random.Random(seed)
    left = {f: rng.sample(range(n), n) for f in range(cv.n_groups)}
    return [(r, f, left[f].pop()) for r, chosen in enumerate(cv.rounds()) for f in chosen]


def cross_validation_paths(
    cv: CombPurgedKFold, samples: DataFrame, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], pred: str = "pred_time", eval_: str = "eval_time", seed: int = 0
) -> DataFrame:
    """(path, pos, fold, ...prediction columns): a model is fitted per round and the test folds' predictions are put
    together to ``back_test_paths`` whole paths, in seeded random order.  ``fit`` takes train rows and gives a predictor.
    The rows of all rounds stay cached until the session drops its cache."""
    roles = cv.split(samples, pred, eval_)
    numbered = samples.withColumn("pos", F.row_number().over(Window.orderBy(pred, eval_)) - 1)
    n, dealt = samples.count(), {(r, f): p for r, f, p in dealt_paths(cv, seed)}
    # every round reads it, so it is kept (on disk where memory ends; what a lost executor held is computed again)
    placed = numbered.join(roles, "pos").persist()
    parts: list[DataFrame] = []
    for r, chosen in enumerate(cv.rounds()):
        own = placed.where(F.col("round") == r)
        predict = fit(own.where("role = 'train'").drop("round", "role"))
        for f in chosen:
            a, b = cv.bounds(n)[f]
            rows = own.where((F.col("role") == "test") & (F.col("pos") >= a) & (F.col("pos") < b)).drop("round", "role")
            parts.append(predict(rows).withColumn("fold", F.lit(f)).withColumn("path", F.lit(dealt[r, f])))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def log_uniform(n: int, a: float = 1.0, b: float = math.e, seed: int = 0) -> Iterator[float]:
    """Values whose logarithm is uniform between those of a and b."""
    rng = random.Random(seed)
    return (a * math.exp(rng.random() * math.log(b / a)) for _ in range(n))


def log_uniform_column(a: float = 1.0, b: float = math.e, seed: int = 0) -> Column:
    """A value for each row whose logarithm is uniform between those of a and b."""
    if not 0 < a <= b:
        raise ValueError("0 < a <= b is needed")
    return F.lit(float(a)) * F.exp(F.rand(seed) * F.lit(math.log(b / a)))
