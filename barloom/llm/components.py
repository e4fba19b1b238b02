"""Connected components of a graph given as links, by alternating large and small stars.

Every step is an aggregation and a join over the links; nothing is collected.  Stars converge in few rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.scratch import drop, stash


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large(links: DataFrame) -> DataFrame:
    both = links.union(links.select("v", "u")).toDF("u", "v")
    low = _least(both).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return both.join(low, F.col("u") == F.col("c")).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _least(down).withColumnRenamed("u", "c")
    hung = down.join(low, F.col("u") == F.col("c")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(low.select("c", "m")).toDF("u", "v")


def _settled(links: DataFrame) -> bool:
    """Whether each component is a star: every node hangs from one, and nothing hangs from those that hang."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """Links (u, v), any order and repeats -> (node, root) for every node that isn't the least of its component.

    Null ends are left out; without links the result is empty; more than ``rounds`` rounds raise an error.
    """
    state = stash(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(rounds):
        if _settled(state):
            break
        after = stash(_small(_large(state)).where("u <> v").distinct(), "stars")
        drop(state)
        state = after
    else:
        raise RuntimeError(f"the links weren't joined in {rounds} rounds")
    out = state.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out._barloom_path = state._barloom_path
    return out
