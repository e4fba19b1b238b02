"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Weights are dealt to sources in code-point order (null last), cycling through ``weights``.  A source's
target is its weighted share of the total size, clamped at ``max_epochs`` times its own size; the excess
is reshared by weight among the others until none is above.  That fixed point is min(w * level, cap), and
the level follows in closed form from one running sum over the sources ordered by cap / weight.

Sampling: with e = target / source size, every document is taken floor(e) whole times.  The rest of the
target is filled by one more repetition of documents in a seeded order (md5 of seed and doc_id); the
document at which it is reached is taken in part, so that a source's words are its target rounded.
``max_epochs`` bounds each document, the partial one included.

No source is brought into one task: sizes are summed by (source, slice of the order), the slice in which the
target is reached is found from the running sum over slices, and only that slice's rows are ordered one by one.

Defined results: a null text has size 0 and is taken 0 words; sources without words get target 0; null is
a source of its own; repeated rows are documents of their own that tie in the order and are exchangeable;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.scratch import fresh, stash

WEIGHTS, MAX_EPOCHS, SEED = (1, 2, 3), 3, "mix-1"
SLICES = 3  # hexadecimal digits of the order that name a slice: 4,096 slices of each source


def _sized(docs: DataFrame, seed: str, text: str) -> DataFrame:
    size = F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), ""))
    return docs.select(
        F.col("doc_id").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        size.cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("turn"),
    )


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> (source, source_size, weight, target).  One row per source."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = sources.withColumn("weight", w.cast("double")).withColumn("cap", (max_epochs * F.col("source_size")).cast("double"))
    by_cap = Window.orderBy((F.col("cap") / F.col("weight")), F.col("source").isNull(), "source")
    before, every = by_cap.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    rest = (
        weighed.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("total", F.sum("source_size").over(every).cast("double"))
    )
    # a source is clamped if the level that the sources from it on could share is above its own cap / weight
    clamped = rest.withColumn("clamped", F.col("weight") * (F.col("total") - F.col("capped")) > F.col("cap") * F.col("open"))
    first = Window.partitionBy(F.lit(1))
    free = F.when(~F.col("clamped"), F.struct(F.col("open").alias("k"), F.col("capped"), F.col("open")))
    level = F.max(free).over(first)  # the first source that isn't clamped has the most open weight
    return clamped.withColumn("level", level).select(
        "source", "source_size", "weight",
        F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("weight") * (F.col("total") - F.col("level.capped")) / F.col("level.open")).alias("target"),
    )


def _deal(docs: DataFrame, seed: str, weights: tuple[int, ...], max_epochs: int, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their source's plan, outside the slices in which a target is reached, and inside them."""
    sized = stash(_sized(docs, seed, text).withColumn("slice", F.substring("turn", 1, SLICES)), "mix-sized")
    slices = stash(sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size")), "mix-slices")
    aims = targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, max_epochs)
    aims = aims.withColumn("whole", F.coalesce(F.floor(F.try_divide(F.col("target"), F.col("source_size"))), F.lit(0)).cast("long"))
    aims = aims.withColumn("need", F.greatest(F.lit(0), F.round(F.col("target")).cast("long") - F.col("whole") * F.col("source_size")))
    run = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    aims = aims.withColumnRenamed("source", "a_source")
    plan = (
        slices.withColumn("before", F.coalesce(F.sum("slice_size").over(run), F.lit(0)))
        .join(aims, F.col("source").eqNullSafe(F.col("a_source")))
        .select(F.col("source").alias("p_source"), F.col("slice").alias("p_slice"), "before", "slice_size", "source_size", "target", "whole", "need")
    )
    dealt = sized.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("slice") == F.col("p_slice")))
    left = F.col("need") - F.col("before")
    cut = (left > 0) & (left < F.col("slice_size"))
    cols = ["doc_id", "source", "size", "source_size", "target", "whole", "turn"]
    plain = dealt.where(~cut).select(*cols, F.when(left > 0, F.col("size")).otherwise(F.lit(0)).cast("long").alias("part"))
    turn = Window.partitionBy("source", "slice").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("need") - F.col("before") - F.coalesce(F.sum("size").over(turn), F.lit(0))
    fine = dealt.where(cut).select(*cols, F.least(F.col("size"), F.greatest(F.lit(0), ahead)).cast("long").alias("part"))
    return plain, fine


def mix(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, text: str = "text") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, whole (repetitions), part (words), taken."""
    plain, fine = _deal(docs, seed, weights, max_epochs, text)
    return plain.unionByName(fine).drop("turn").withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))


def repeat(docs: DataFrame, seed: str = SEED, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, text: str = "text") -> DataFrame:
    """The mixture as rows of ``docs``, whole texts only: the partial repetition counts if half of it is taken.

    A source's plan is one row: its whole repetitions and the last place in the order that gets one more.  So texts
    are not moved; the plan is as small as the list of sources.
    """
    plain, fine = _deal(docs, seed, weights, max_epochs, text)
    extra = F.when((F.col("size") > 0) & (2 * F.col("part") >= F.col("size")), F.col("turn"))
    plan = plain.unionByName(fine).groupBy("source").agg(F.max("whole").alias("p_whole"), F.max(extra).alias("p_last"))
    plan = stash(plan.withColumnRenamed("source", "p_source"), "mix-plan")
    turn, times = fresh(docs, "mix_turn", "mix_times")
    placed = docs.withColumn(turn, F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))))
    joined = placed.join(plan, placed["source"].cast("string").eqNullSafe(plan["p_source"]))
    n = plan["p_whole"] + F.when(placed[turn] <= plan["p_last"], 1).otherwise(0)
    copies = joined.select(*[placed[c] for c in docs.columns], F.explode(F.array_repeat(F.lit(1), n.cast("int"))).alias(times))
    return copies.select(*docs.columns)
