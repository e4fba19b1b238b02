"""Sequential bootstrap and bagging of trees on its draws.

A bag's draws depend on each other, so a bag of a series is one task; bags and series run in parallel.  Intervals are pairs of bar positions and
uniqueness comes from running sums over bars, so no indicator matrix is built.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def update_uniqueness(start: np.ndarray, end: np.ndarray, drawn: np.ndarray, bars: int) -> np.ndarray:
    """Each event's mean over its bars of 1 / (1 + drawn events there); ``drawn`` are event numbers, with repeats."""
    k = np.zeros(bars + 1)
    np.add.at(k, start[drawn], 1)
    np.add.at(k, end[drawn] + 1, -1)
    sums = np.concatenate(([0.0], np.cumsum(1 / (1 + np.cumsum(k[:bars])))))
    return (sums[end + 1] - sums[start]) / (end - start + 1)


def sequential_bootstrap(start: np.ndarray, end: np.ndarray, size: int, rng: np.random.Generator, update_every: int = 1) -> np.ndarray:
    """Draws of events, each with chance in proportion to its uniqueness given the draws before."""
    bars, drawn = int(end.max()) + 1, np.zeros(0, np.int64)
    while len(drawn) < size:
        u = update_uniqueness(start, end, drawn, bars)
        drawn = np.concatenate((drawn, rng.choice(len(start), min(update_every, size - len(drawn)), p=u / u.sum())))
    return drawn


def draw_features(rng: np.random.Generator, repeats: bool, n: int, size: int) -> np.ndarray:
    return rng.integers(0, n, size) if repeats else rng.choice(n, size, replace=False)


def bootstrap_bags(spark: SparkSession, intervals: pd.DataFrame, bags: int, size: int, seed: int = 0, update_every: int = 1) -> DataFrame:
    """(bag, event, times) of ``bags`` bags; intervals: start and end positions, one row per event."""
    start, end = intervals["start"].to_numpy(np.int64), intervals["end"].to_numpy(np.int64)

    def run(key: tuple, _: pd.DataFrame) -> pd.DataFrame:
        drawn = sequential_bootstrap(start, end, size, np.random.default_rng((seed, key[0])), update_every)
        event, times = np.unique(drawn, return_counts=True)
        return pd.DataFrame({"bag": key[0], "event": event, "times": times})

    return spark.range(bags).withColumnRenamed("id", "bag").repartition(bags, "bag").groupBy("bag").applyInPandas(run, "bag long, event long, times long")


def _share(value: int | float, n: int, name: str) -> int:
    """A count, or a share of n."""
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"{name} must be a number")
    out = int(value * n) if isinstance(value, float) else value
    if not 0 < out <= n:
        raise ValueError(f"{name} must lie in (0, {n}]")
    return out


def bootstrap_series(intervals: DataFrame, bags: int, size: int | float = 1.0, seed: int = 0, update_every: int = 1) -> DataFrame:
    """(series_id, bag, event, times) of ``bags`` bags of each series; intervals: series_id, event, start, end.

    ``size`` is a count, or a share of a series' events; a series gives one draw at least.
    """
    if isinstance(size, float) and not 0 < size <= 1:
        raise ValueError("a share must lie in (0, 1]")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("event")
        start, end = (rows[c].to_numpy(np.int64) - rows["start"].min() for c in ("start", "end"))
        count = max(1, int(size * len(rows))) if isinstance(size, float) else _share(size, len(rows), "size")
        drawn = sequential_bootstrap(start, end, count, np.random.default_rng((seed, key[1], zlib.crc32(str(key[0]).encode()))), update_every)
        place, times = np.unique(drawn, return_counts=True)
        return pd.DataFrame({"series_id": key[0], "bag": key[1], "event": rows["event"].to_numpy()[place], "times": times})

    each = intervals.select("series_id", "event", "start", "end", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bags - 1).cast("long"))).alias("bag"))
    return each.groupBy("series_id", "bag").applyInPandas(run, "series_id string, bag long, event long, times long")


@dataclass
class SequentiallyBootstrappedBagging:
    """Decision trees on sequentially bootstrapped samples; probabilities are averaged.

    ``train`` needs an ``event`` number for each row of ``intervals``; where these are a DataFrame with series, it needs
    ``series_id`` too, and each series gives its own draws (``max_samples`` is taken of its events).  A draw's multiplicity is the row's weight.
    """

    features: list[str]
    label: str = "label"
    n_estimators: int = 10
    max_samples: int | float = 1.0
    max_features: int | float = 1.0
    bootstrap_features: bool = False
    update_every: int = 1
    warm_start: bool = False
    oob_score: bool = False
    max_depth: int = 5
    seed: int = 0
    trees: list = field(default_factory=list)
    oob_accuracy: float | None = None

    def fit(self, train: DataFrame, intervals: pd.DataFrame | DataFrame, weight: str | None = None) -> SequentiallyBootstrappedBagging:
        if self.n_estimators < 1:
            raise ValueError("n_estimators must be positive")
        if self.warm_start and self.oob_score:
            raise ValueError("out-of-bag scores need a fit from the start")
        if self.warm_start and self.n_estimators < len(self.trees):
            raise ValueError("a warm start can't drop trees")
        width = _share(self.max_features, len(self.features), "max_features")
        one = isinstance(intervals, pd.DataFrame)
        size = _share(self.max_samples, len(intervals), "max_samples") if one else self.max_samples
        if not self.warm_start:
            self.trees = []
        new = range(len(self.trees), self.n_estimators)
        if one:
            draws = bootstrap_bags(train.sparkSession, intervals, self.n_estimators, size, self.seed, self.update_every).cache()
        else:
            draws = bootstrap_series(intervals, self.n_estimators, size, self.seed, self.update_every).cache()
        key = ["event"] if one else ["series_id", "event"]
        for bag in new:
            names = [self.features[i] for i in draw_features(np.random.default_rng((self.seed, 1, bag)), self.bootstrap_features, len(self.features), width)]
            names = list(dict.fromkeys(names))
            rows = train.join(draws.where(F.col("bag") == bag).drop("bag"), key)
            rows = rows.withColumn("__w", F.col("times").cast("double") * (F.col(weight) if weight else F.lit(1.0)))
            rows = VectorAssembler(inputCols=names, outputCol="__x").transform(rows).where("__w > 0")
            tree = DecisionTreeClassifier(featuresCol="__x", labelCol=self.label, weightCol="__w", maxDepth=self.max_depth, seed=self.seed + bag).fit(rows)
            self.trees.append((names, tree))
        if self.oob_score:
            self._score(train, draws, key)
        draws.unpersist()
        return self

    def _votes(self, rows: DataFrame, bag: int) -> DataFrame:
        names, tree = self.trees[bag]
        ready = VectorAssembler(inputCols=names, outputCol="__x").transform(rows)
        out = tree.transform(ready)
        return out.select(*rows.columns, vector_to_array(tree.getProbabilityCol()).alias(f"__p{bag}"))

    def _classes(self) -> int:
        return max(t.numClasses for _, t in self.trees)

    def predict_proba(self, rows: DataFrame, out: str = "probability") -> DataFrame:
        """Adds the mean of the trees' class probabilities, and ``prediction``, its argmax."""
        work = rows
        for bag in range(len(self.trees)):
            work = self._votes(work, bag)
        mean = F.array(*[sum((F.coalesce(F.get(f"__p{b}", F.lit(k)), F.lit(0.0)) for b in range(len(self.trees))), F.lit(0.0)) / len(self.trees) for k in range(self._classes())])
        work = work.withColumn(out, mean)
        return work.withColumn("prediction", (F.array_position(out, F.array_max(out)) - 1).cast("double")).drop(*[f"__p{b}" for b in range(len(self.trees))])

    def _score(self, train: DataFrame, draws: DataFrame, key: list[str]) -> None:
        """Accuracy of the votes of trees that haven't seen a row; rows that all have seen don't count."""
        seen = draws.groupBy(*key).agg(F.collect_set("bag").alias("__bags"))
        work = train.join(seen, key, "left")
        for bag in range(len(self.trees)):
            work = self._votes(work, bag)
        unseen = lambda b: ~F.coalesce(F.array_contains("__bags", b), F.lit(False))
        sums = F.array(*[sum((F.when(unseen(b), F.coalesce(F.get(f"__p{b}", F.lit(k)), F.lit(0.0))).otherwise(0.0) for b in range(len(self.trees))), F.lit(0.0)) for k in range(self._classes())])
        judged = work.withColumn("__s", sums).where(F.array_max("__s") > 0)
        hit = (F.array_position("__s", F.array_max("__s")) - 1) == F.col(self.label)
        self.oob_accuracy = judged.agg(F.avg(hit.cast("double"))).first()[0]
