"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document.  The ledger keeps each rule's measurement and one bit per
failed rule; a *policy* is a versioned set of bits, so policies are applied, compared and ablated by
bitwise arithmetic on the ledger without touching a text again.

Defined results: a null or blank text has no words, fails ``min_words`` and is rejected; repeated rows
are measured one by one; ties don't arise; an empty table gives an empty ledger; other columns of the
input, whatever their names, neither disturb the measurements nor are disturbed by them.

Five-word windows are compared by a 64-bit hash within one document (20,000 words: about 1e-11 chance
of one false repeat).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.scratch import fresh

SPACE = r"[\x20\x09-\x0D]"
MIN_WORDS, WINDOW = 10, 5

#: Rule names; a rule's place is its bit.  Only append.
RULES = ("min_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "capitals", "exclaims")
#: Policy version -> rules that it enforces.
POLICIES = {
    "v1": ("min_words", "repeated_windows"),
    "v2": ("min_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "capitals", "exclaims"),
}
CURRENT = "v2"


def mask(version: str) -> int:
    """The bits of a policy."""
    return sum(1 << RULES.index(r) for r in POLICIES[version])


def _repeat_words(windows: Column) -> Column:
    """Words inside windows that occur twice or more, from the windows' hashes in text order."""

    def covered(runs: Column) -> Column:
        last = F.size(runs) - 1
        twice = F.filter(
            F.sequence(F.lit(0), last),
            lambda k: (F.get(runs, k)["h"] == F.coalesce(F.get(runs, F.greatest(k - 1, F.lit(0)))["h"])) & (k > 0)
            | (F.get(runs, k)["h"] == F.get(runs, F.least(k + 1, last))["h"]) & (k < last),
        )
        places = F.sort_array(F.transform(twice, lambda k: F.get(runs, k)["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("at"))
        step = lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["at"])).alias("n"), x.alias("at"))
        return F.aggregate(places, zero, step)["n"]

    runs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    slow = F.transform(F.array(runs), covered)[0]  # bound once: not sorted again for each element
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), slow).otherwise(F.lit(0)).cast("long")


def ledger(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, the measurements and ``fail_bits``; one row per row of ``docs``."""
    t, words, lines, windows = (f"__{x}" for x in ("text", "words", "lines", "windows"))
    base = docs.select(*[F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)], F.coalesce(F.col(text), F.lit("")).alias(t))
    kept = [f"__keep{i}" for i in range(len(keep))]
    split = base.select(
        *kept, t,
        F.array_remove(F.split(t, f"{SPACE}+"), "").alias(words),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias(lines),
    )
    n = F.size(words)
    hashed = F.transform(
        F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(F.col(words), i + k) for k in range(WINDOW)])
    )
    counted = split.select(
        *kept,
        n.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.length(F.regexp_replace(t, r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        F.length(F.regexp_replace(t, r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace(t, r"[^!]+", "")).cast("long").alias("n_exclaims"),
        F.when(n >= WINDOW, hashed).otherwise(F.array().cast("array<bigint>")).alias(windows),
    )
    measured = counted.select(
        *kept, *[c for c in counted.columns if c not in (*kept, windows)], _repeat_words(F.col(windows)).alias("n_repeat_words")
    )
    fails = {
        "min_words": F.col("n_words") < MIN_WORDS,
        "repeated_windows": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
        "symbols": 10 * F.col("n_symbols") > 3 * F.col("n_words"),
        "repeated_lines": (10 * F.col("n_dup_lines") > 5 * F.col("n_lines")),
        "word_length": (F.col("n_words") > 0) & ((2 * F.col("word_chars") < 3 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))),
        "capitals": 10 * F.col("n_capitals") > 6 * F.col("n_letters"),
        "exclaims": 10 * F.col("n_exclaims") > 6 * F.col("n_words"),
    }
    bits = sum((F.when(fails[r], F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(RULES)), F.lit(0)).cast("long")
    out = measured.withColumn("fail_bits", bits)
    names = [c for c in out.columns if c not in kept]
    # a kept column wins its name; a measurement of that name gets a leading underscore
    new = fresh(docs.select(*keep), *names)
    return out.select(*[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)], *[F.col(a).alias(b) for a, b in zip(names, new, strict=True)])


def passes(bits: Column, version: str = CURRENT) -> Column:
    return bits.bitwiseAND(F.lit(mask(version)).cast("long")) == 0


def keep_passing(docs: DataFrame, version: str = CURRENT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with the columns of ``docs``."""
    bits, row = fresh(docs, "fail_bits", "row")
    judged = ledger(docs, docs.columns, text)
    if row in judged.columns:
        row = fresh(judged, row)[0]
    # a condition on the measurements would be moved below them, each copy measuring anew; one on a row number stays above
    judged = judged.withColumn(row, F.monotonically_increasing_id())
    return judged.where(passes(F.col(bits), version) & (F.col(row) >= 0)).select(*docs.columns)


def ablation(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents that fail it, fail it alone, and would be kept without it.

    One pass over the ledger: bits are summed per distinct mask (at most 2**rules groups), then expanded.
    """
    policy = mask(version)
    masks = book.groupBy(F.col("fail_bits").bitwiseAND(F.lit(policy).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in POLICIES[version]]))
    each = masks.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_failed_alone"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.lit(policy).cast("long") - F.col("bit")) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
