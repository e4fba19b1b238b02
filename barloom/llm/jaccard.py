"""Similarity self-join on word shingles by a token-group matrix, and its connected components.

Texts with equal shingle sets are one class, whose shingles are 64-bit hashes in ascending order.  Two sets that reach the
threshold share ``n - ceil(t n) + 1`` shingles less than all at most, so one of the first that many of each is in both: these
are a class's tokens, and the matrix has a row for each (token, class).  ``ROOM`` more of a set pay for tokens of more
than ``MANY`` classes, such as those of a passage that documents share: a class that has r such tokens among the first
p + r is *rich* and shares one that isn't among them with every rich class that is similar, so rows of such tokens are
only kept for classes that have too many of them (*poor*: mostly made of a passage, or in a large group of copies),
and only pairs with a poor class are looked at there.

1. Partition: each class is compared with the class that shares most of its tokens (its hub); linked classes form groups.
2. What stands apart from the hub of a token is compared with it, once for each pair.
3. What still stands apart in a token's row is bounded against groups: a group keeps the union of its members' sets, and
   their intersection, folded into parity bits; a query opens only groups that it doesn't differ from by more than the
   threshold allows, and in them only members whose own bits leave it open.  The frequent tokens of one hub are one row, so that
   copies, which share most of their tokens, meet once.  Long rows are dealt out as pairs of blocks of ``BLOCK`` members: the
   poor ones, or those outside the row's largest component if these are fewer, against all.  In a first round a class meets
   others in the longest of its rows only, and in ``BAND`` blocks of it; there it opens the ``NEAREST`` of a block by these bits,
   and those sets are compared and joined.  In the next rounds it meets them in all rows, then in those where a class has opened
   as many as it may, in all blocks, and opens eight times as many each time.

Nothing is capped: the last round has no class that opened as many as it might, so every pair that reaches the threshold
is compared or already joined through others.  Equality of
shingles and sets is judged by 64-bit hashes.

Defined results: null and blank texts have empty sets and are components of their own; repeated rows are equal
texts; rows of one doc_id with different texts are told apart; the component id is the smallest doc_id; an empty table
gives an empty result; extra columns are ignored; a long text needs about 40 bytes a byte in the task that reads it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.components import components
from barloom.llm.scratch import drop, fresh, release, stash
from barloom.llm.words import Words, groups, mix, shingles

_U = np.uint64
BLOCK, BITS, CELLS = 1024, 2048, 1 << 15  # CELLS: pairs that are bounded in one operation
MANY, ROOM = 32, 10  # classes of an ordinary token; a set's share (one in ROOM) that may replace others
SAMPLE, HOT, SALTS = 64, 4096, 64  # tokens of more than a HOT-th of one in SAMPLE classes are dealt to SALTS tasks
PASSES = 2  # shares of the tokens that are shuffled one after the other
BROADCAST_ROWS = 500_000  # rows of two or three numbers that are sent to all tasks; more are joined by a shuffle
NEAREST = 8  # open pairs of a class in a block, in the first round
BAND = 4  # blocks of a row that a class meets in the first round
MEMBERS = 512  # sets that are compared with one other in a task


def lengths(n: int, num: int, den: int) -> tuple[int, int]:
    """How many tokens a set of ``n`` has, and how many with those that may replace them."""
    first = n + num * n // -den + 1
    return first, min(n, first + 4 + n // ROOM)


def set_key(h: np.ndarray) -> int:
    """One number for a set, as a signed 64-bit integer."""
    whole = int(mix(h + _U(0x8EBC6AF09C88C6E3)).sum(dtype=np.uint64)) + len(h) * 0x589965CC75374CC3
    return int(mix(np.array([whole % (1 << 64)], np.uint64)).view(np.int64)[0])


def parity(h: np.ndarray) -> bytes:
    """For each of ``BITS`` parts of the hash range whether it holds an odd number: sets differ by as many shingles at least
    as these bits differ."""
    return np.packbits((np.bincount((h >> _U(65 - BITS.bit_length())).astype(np.int64), minlength=BITS) & 1).astype(np.uint8)).tobytes()


def _sets(k: int, num: int, den: int):
    """doc_id, mark, n, key and, for the first of its class in the task, the tokens, how many of them are the first, and parity bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for first, texts in groups(batch.column(2)):
                rows = []
                for h in shingles(Words(texts), k):
                    key = set_key(h) if len(h) else None
                    if key is None or key in seen:
                        rows.append((len(h), key, None, None, None))
                        continue
                    seen.add(key)
                    p, most = lengths(len(h), num, den)
                    rows.append((len(h), key, h[:most].view(np.int64), p, parity(h)))
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary())
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                ids = [batch.column(c).slice(first, len(texts)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*ids, *cols], names=["doc_id", "mark", "n", "key", "tokens", "p", "bits"])

    return run


def _runs(many: int):
    """Rows (token, salt, key, place) sorted so -> distinct rows of tokens of two classes or more, with the classes c.

    c is exact up to ``many`` and one more beyond; rows with a salt are parts of longer ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        told = False  # the held row is the last of a long run, and has been given out

        def out(rows: list[np.ndarray], c: np.ndarray, give: np.ndarray) -> Iterator[pa.RecordBatch]:
            if give.any():
                cols = [*(x[give] for x in (rows[0], rows[2], rows[3])), c[give]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in cols], names=["token", "key", "place", "c"])

        for batch in batches:
            rows = [np.concatenate((h, batch.column(j).to_numpy(zero_copy_only=False))) for j, h in enumerate(held)]
            if not len(rows[0]):
                continue
            new = np.ones(len(rows[0]), bool)
            new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1]) | (rows[2][1:] != rows[2][:-1])
            token, salt = rows[0][new], rows[1][new]
            rows = [token, salt, rows[2][new], rows[3][new]]
            start = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (salt[1:] != salt[:-1]))))
            size = np.diff(np.append(start, len(token)))
            long = (size > many) | (salt[start] >= 0)
            long[0] |= told
            give = np.repeat(long | (size > 1), size)
            give[0] &= not told
            last = int(start[-1])
            if long[-1]:
                told, held = True, [x[-1:] for x in rows]
            else:
                give[last:] = False
                told, held = False, [x[last:] for x in rows]
            yield from out(rows, np.repeat(np.where(long, many + 1, size), size).astype(np.int32), give)
        n = len(held[0])
        if n > 1 and not told:
            yield from out(held, np.full(n, n, np.int32), np.ones(n, bool))

    return run


def _hashes(k: int):
    """Rows (want, v, part, u, text) -> (v, part, u, h): the sorted hashes of a text's set; texts with another set than wanted go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text, own, h = None, None, np.zeros(0, np.uint64)
        for batch in batches:
            for first, texts in groups(batch.column(4)):
                new = [t for j, t in enumerate(texts) if t != (texts[j - 1] if j else text)]  # a text's rows are side by side
                found = iter(shingles(Words(new), k)) if new else iter(())
                place, sets = [], []
                for j, (t, want) in enumerate(zip(texts, batch.column(0).slice(first, len(texts)).to_pylist(), strict=True)):
                    if t != text or own is None:
                        text, h = t, next(found)
                        own = set_key(h) if len(h) else 0
                    if own == want:
                        place.append(first + j)
                        sets.append(h.tobytes())
                rows = batch.take(pa.array(place, pa.int64()))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in (1, 2, 3)), pa.array(sets, pa.binary())], names=["v", "part", "u", "h"])

    return run


def _may_link(n: np.ndarray, bits: np.ndarray, m: np.ndarray, others: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of these sizes and parity bits can reach the threshold."""
    apart = np.bitwise_count(bits ^ others).sum(-1, dtype=np.int64)
    fits = den * np.minimum(n, m) >= num * np.maximum(n, m)
    return fits & (apart * (den + num) <= (n + m) * (den - num))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _alike(num: int, den: int):
    """Rows (v, u, h) sorted so that v's own set, without a u, is before those of its partners -> pairs that reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            us, vs = [], []
            for v, u, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                h = np.frombuffer(x.as_buffer(), np.uint64)
                if u is None:
                    name, own = v, h.copy()
                    continue
                if v != name:
                    raise ValueError("a pair came without its second set")
                if den * min(len(h), len(own)) >= num * max(len(h), len(own)):
                    n = _common(h, own)
                    if den * n >= num * (len(h) + len(own) - n):
                        us.append(u)
                        vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _near(num: int, den: int):
    """Pairs with sizes and parity bits -> those that may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("nu", "nv"))
            bits, others = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, BITS // 64) for c in ("bu", "bv"))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["u", "v"]).filter(pa.array(_may_link(n, bits, m, others, num, den)))

    return run


def _sent(table: DataFrame) -> DataFrame:
    """A stashed table, to be broadcast if its size allows it."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _bounded(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that sizes and parity bits leave open."""
    left, right = classes.select("key", "n", "bits").toDF("ku", "nu", "bu"), classes.select("key", "n", "bits").toDF("kv", "nv", "bv")
    full = pairs.join(left, F.col("u") == F.col("ku")).join(right, F.col("v") == F.col("kv"))
    return full.select("u", "v", "nu", "nv", "bu", "bv").mapInArrow(_near(num, den), "u long, v long")


def _verify(pairs: DataFrame, classes: DataFrame, source: DataFrame, k: int, num: int, den: int, label: str) -> DataFrame:
    """The open pairs that reach the threshold, stashed.

    Partners of v go where v's set is, ``MEMBERS`` of them to a task's stretch, so a set moves once for each of its pairs and
    v's once for each stretch. Sets are made from the texts of the pairs' classes, and never stored.
    """
    pairs = stash(pairs, f"{label}-open", let_go=True)
    often = pairs.groupBy(F.col("v").alias("ov")).agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("stretches"))
    part = F.pmod(F.xxhash64("u"), F.col("stretches")).cast("int")
    dealt = pairs.join(often, F.col("v") == F.col("ov")).select("v", part.alias("part"), "u")
    both = dealt.withColumn("want", F.col("u")).union(dealt.select("v", "part", F.lit(None).cast("long").alias("u"), F.col("v").alias("want")).distinct())
    roles = stash(both.join(classes.select("key", "rep"), F.col("want") == F.col("key")).drop("key"), f"{label}-roles")
    texts = source.join(_sent(roles), source["doc_id"].eqNullSafe(roles["rep"])).select("want", "v", "part", "u", "text")
    sets = texts.mapInArrow(_hashes(k), "v long, part int, u long, h binary")
    parts = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = sets.repartition(parts, "v", "part").sortWithinPartitions("v", "part", F.col("u").asc_nulls_first())
    found = stash(dealt.select("v", "u", "h").mapInArrow(_alike(num, den), "u long, v long"), label, let_go=True)
    drop(pairs, roles)
    return found


def _least(i: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` smallest x of each i, which ascends; earlier places first where they are equal."""
    order = np.lexsort((x, i))
    return np.sort(order[np.arange(len(i)) - np.searchsorted(i, i) < most])


def _opened(
    key: np.ndarray, comp: np.ndarray, n: np.ndarray, bits: np.ndarray, side: np.ndarray, num: int, den: int, nearest: int | None = None
) -> list[tuple[np.ndarray, np.ndarray]]:
    """A block pair of a token's row: the pairs of different components that the bounds leave open, or the ``nearest`` closest of each left member.

    Members of one component are a group, bounded by the bits that are set in all or in some of them.  Sides: 0 left, 1 right,
    2 right and also left (here or in another block pair): two such members are a pair of the smaller key's only.
    """
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side > 0)
    one = not len(right)
    right = left if one else right
    if not len(left):
        return []
    right = right[np.lexsort((key[right], comp[right]))]
    key2, m, bits2, either = key[right], n[right], bits[right], one | (side[right] == 2)
    names, start, group = np.unique(comp[right], return_index=True, return_inverse=True)
    every, some = np.bitwise_and.reduceat(bits2, start), np.bitwise_or.reduceat(bits2, start)
    least, most = np.minimum.reduceat(m, start), np.maximum.reduceat(m, start)
    step, out = max(1, CELLS // len(right)), []
    for a in range(0, len(left), step):
        own = left[a : a + step]
        mine, size = bits[own][:, None, :], n[own][:, None]
        # bits that differ from those of every member of a group
        apart = np.bitwise_count((mine & ~some) | (~mine & every)).sum(-1, dtype=np.int64)
        opened = (names != comp[own][:, None]) & (den * size >= num * least) & (den * most >= num * size) & (apart * (den + num) <= (size + most) * (den - num))
        i, j = np.nonzero(opened[:, group] & (~either | (key2 > key[own][:, None])))
        near = _may_link(n[own[i]], bits[own[i]], m[j], bits2[j], num, den)
        i, j = i[near], j[near]
        if nearest is not None and len(i) > nearest:
            far = np.bitwise_count(bits[own[i]] ^ bits2[j]).sum(-1, dtype=np.int64) / (n[own[i]] + m[j])
            kept = _least(i, far, nearest)
            i, j = i[kept], j[kept]
        out.append((key[own[i]], key2[j]))
    return out


def _open_groups(num: int, den: int, most: int = NEAREST):
    """Rows (token, a, b, side, key, comp, n, bits) sorted by block pair -> open pairs (u, v, cut), smaller key first.

    Each left row opens ``most`` pairs at most; cut is its token where it has opened as many, so that there may be more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held = ("token", "a", "b", "side", "key", "comp", "n"), None

        def out(cols: list[np.ndarray], bits: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
            found = []
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                for u, v in _opened(cols[4][s:e], cols[5][s:e], cols[6][s:e], bits[s:e], cols[3][s:e], num, den, most):
                    _, at, count = np.unique(u, return_inverse=True, return_counts=True)
                    found.append((u, v, np.full(len(u), cols[0][s]), count[at] >= most))
            u, v, token, full = (np.concatenate([x[k] for x in found] + [np.zeros(0, bool if k == 3 else np.int64)]) for k in range(4))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v)), pa.array(token, mask=~full)], names=["u", "v", "cut"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]
            bits = np.frombuffer(b"".join(batch.column("bits").to_pylist()), np.uint64).reshape(-1, BITS // 64)
            if held:
                cols, bits = [np.concatenate(x) for x in zip(held[0], cols, strict=True)], np.concatenate((held[1], bits))
            new = np.flatnonzero((cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1]) | (cols[2][1:] != cols[2][:-1])) + 1
            last = int(new[-1]) if len(new) else 0
            if last:
                yield out(cols, bits, np.concatenate(([0], new)))
            held = [c[last:].copy() for c in cols], bits[last:].copy()
        if held:
            yield out(*held, np.array([0, len(held[1])]))

    return run


def _matrix(base: DataFrame, parts: int) -> list[DataFrame]:
    """Rows (token, key, place, c) of tokens of two classes or more; place: rank from the last of the first tokens, and room.

    A table for each of ``PASSES`` shares of the tokens, one after the other, since the rows of all tokens are the most that is shuffled at once.
    """
    place = F.shiftleft((F.col("pos") - F.col("p")).cast("long"), 32) + (F.col("t") - F.col("p"))
    rows = base.where("tokens is not null").select("key", "p", F.size("tokens").alias("t"), F.posexplode("tokens").alias("pos", "token")).select("token", "key", place.alias("place"))
    # one in SAMPLE classes tells which tokens are so frequent that their rows are dealt to several tasks: at most HOT times a class's tokens
    some = base.where(F.col("tokens").isNotNull() & (F.pmod(F.xxhash64("key"), F.lit(SAMPLE)) == 0))
    classes = some.agg(F.count_distinct("key")).first()[0]
    seen = some.select("key", F.explode("tokens").alias("hot")).groupBy("hot").agg(F.count_distinct("key").alias("s"))
    hot = F.broadcast(stash(seen.where(F.col("s") > max(16, classes // HOT)).select("hot"), "hot"))
    salt = F.when(F.col("hot").isNotNull(), F.pmod(F.xxhash64("key"), F.lit(SALTS))).otherwise(F.lit(-1))
    salted = rows.join(hot, F.col("token") == F.col("hot"), "left").select("token", salt.cast("long").alias("salt"), "key", "place")
    out = []
    for share in range(PASSES):
        dealt = salted.where(F.pmod("token", F.lit(PASSES)) == share).repartition(parts, "token", "salt").sortWithinPartitions("token", "salt", "key")
        out.append(stash(dealt.mapInArrow(_runs(MANY), "token long, key long, place long, c int"), "matrix", let_go=True))
    return out


def _kept(matrix: DataFrame) -> DataFrame:
    """Rows (token, key, heavy, poor, hub, hub_poor) of the pairs that must be looked at."""
    rank, room, heavy = F.shiftright("place", 32), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)), F.col("c") > MANY
    found = matrix.groupBy("key").agg(F.sum("c").alias("w"), F.array_sort(F.collect_list(F.when(heavy, rank))).alias("ranks"), F.max(room).alias("room"))
    # the least r such that no more than r of the first p + r tokens are heavy
    at = F.array_position(F.transform("ranks", lambda x, i: x >= i), F.lit(True))
    reach = F.when(at > 0, at - 1).otherwise(F.size("ranks"))
    info = found.select(F.col("key").alias("i_key"), "w", reach.alias("reach"), (reach > F.col("room")).alias("poor"))
    rows = matrix.select("token", "key", heavy.alias("heavy"), rank.alias("rank")).join(info, F.col("key") == F.col("i_key"))
    rows = rows.where(F.col("rank") < F.when(F.col("heavy") | F.col("poor"), 0).otherwise(F.col("reach"))).select("token", "key", "heavy", "poor", "w")
    rows = stash(rows, "rows", let_go=True)
    hubs = rows.groupBy("token").agg(F.max(F.struct("poor", "w", "key")).alias("hub"), F.count(F.lit(1)).alias("c"), F.max("heavy").alias("h"))
    hubs = hubs.where((F.col("c") > 1) & (~F.col("h") | F.col("hub.poor"))).select(F.col("token").alias("t"), F.col("hub.key").alias("hub"), F.col("hub.poor").alias("hub_poor"))
    kept = stash(rows.join(hubs, F.col("token") == F.col("t")).select("token", "key", "heavy", "poor", "hub", "hub_poor"), "kept", let_go=True)
    drop(rows)
    return kept


def _apart(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of tokens whose classes are in two components or more, with theirs (comp) and the hub's."""
    placed = rows.join(roots, F.col("key") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "key")).drop("node", "root")
    split = placed.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.max(F.when(F.col("key") == F.col("hub"), F.col("comp"))).alias("hub_comp"))
    return placed.join(split.where("x <> y").select(F.col("token").alias("t"), "hub_comp"), F.col("token") == F.col("t")).drop("t")


def _longest(rows: DataFrame) -> DataFrame:
    """Of each class the row of the token that has the most."""
    size = rows.groupBy("token").agg(F.count(F.lit(1)).alias("c")).withColumnRenamed("token", "t")
    best = rows.join(size, F.col("token") == F.col("t")).groupBy("key").agg(F.max(F.struct("c", "t")).alias("b")).select(F.col("key").alias("b_key"), F.col("b.t").alias("b_token"))
    return rows.join(best, (F.col("key") == F.col("b_key")) & (F.col("token") == F.col("b_token")), "left_semi")


def _merged(rows: DataFrame) -> DataFrame:
    """The heavy tokens of one hub as one row of all their classes, where that makes no more pairs; the others as they are."""
    heavy, pairs = rows.where("heavy"), F.count(F.lit(1)) * F.count_if("poor")
    apiece = heavy.groupBy("hub", "token").agg(pairs.alias("pairs")).groupBy("hub").agg(F.sum("pairs").alias("pairs"), F.min("token").alias("one"))
    whole = heavy.select("hub", "key", "poor").distinct().groupBy(F.col("hub").alias("w_hub")).agg(pairs.alias("w_pairs"))
    fewer = apiece.join(whole, F.col("hub") == F.col("w_hub")).where("w_pairs <= pairs").select("w_hub", "one")
    named = rows.join(fewer, F.col("heavy") & (F.col("hub") == F.col("w_hub")), "left").withColumn("token", F.coalesce("one", "token"))
    return named.select("token", "key", "heavy", "poor", "hub", "comp").distinct()


def _blocks(left: DataFrame, classes: DataFrame, parts: int, band: int | None = None) -> DataFrame:
    """Rows of tokens as pairs of blocks, sorted: one block for an ordinary token, a few classes against all for a heavy one.

    The few are the poor ones, or those outside the row's largest component: every pair that counts has one of either.  Each block
    of them meets ``band`` blocks, so that a row is dealt in proportion to its size, or all.
    """
    shape = [F.count(F.lit(1)).alias("c"), F.bit_xor(F.xxhash64("key")).alias("x"), F.sum(F.xxhash64(F.lit(7), "key").bitwiseAND(F.lit((1 << 40) - 1))).alias("s")]
    same = left.groupBy("token", "comp").agg(*shape, F.max("heavy").alias("h"), F.count_if("poor").alias("poor_size"))
    largest = F.max(F.struct("c", "comp")).alias("largest")
    same = same.groupBy("token").agg(largest, F.sum("c").alias("c"), F.bit_xor("x").alias("x"), F.sum("s").alias("s"), F.max("h").alias("h"), F.sum("poor_size").alias("poor_size"))
    once = same.groupBy("c", "x", "s", "h").agg(F.min(F.struct("token", "poor_size", "largest")).alias("o")).select(F.col("o.token").alias("t"), "h", F.col("c").alias("row_size"), "o.poor_size", "o.largest")
    outside = F.col("row_size") - F.col("largest.c")
    once = once.select("t", "h", "row_size", F.least("poor_size", outside).alias("few_size"), F.when(outside < F.col("poor_size"), F.col("largest.comp")).alias("most_comp"))
    once = once.where("not h or few_size > 0").drop("h")
    few = F.when(F.col("most_comp").isNull(), F.col("poor")).otherwise(F.col("comp") != F.col("most_comp"))
    rows = stash(left.join(once, F.col("token") == F.col("t")).withColumn("few", few).drop("t", "most_comp"), "apart")
    l_blocks, r_blocks = (F.ceil(F.col(c) / BLOCK).cast("int") for c in ("few_size", "row_size"))
    own_l, own_r = F.pmod(F.xxhash64(F.lit(11), "key"), l_blocks).cast("int"), F.pmod(F.xxhash64(F.lit(13), "key"), r_blocks).cast("int")
    wide = F.least(r_blocks, F.lit(band)) if band else r_blocks
    first = lambda a: F.floor(a * r_blocks / l_blocks).cast("int")
    met = F.transform(F.sequence(F.lit(0), wide - 1), lambda j: F.pmod(first(own_l) + j, r_blocks))
    meeting = F.filter(F.sequence(F.lit(0), l_blocks - 1), lambda a: F.pmod(own_r - first(a), r_blocks) < wide)
    zero = F.lit(0)
    dealt = rows.where("not heavy").select("token", zero.alias("a"), zero.alias("b"), zero.alias("side"), "key", "comp")
    dealt = dealt.union(rows.where("heavy and few").select("token", own_l.alias("a"), F.explode(met).alias("b"), zero.alias("side"), "key", "comp"))
    dealt = dealt.union(rows.where("heavy").select("token", F.explode(meeting).alias("a"), own_r.alias("b"), F.when(F.col("few"), 2).otherwise(1).alias("side"), "key", "comp"))
    filled = dealt.join(classes.select(F.col("key").alias("s_key"), "n", "bits"), F.col("key") == F.col("s_key"))
    filled = filled.repartition(parts, "token", "a", "b").sortWithinPartitions("token", "a", "b")
    out = filled.select("token", "a", "b", "side", "key", "comp", "n", "bits")
    out._barloom_path = rows._barloom_path
    return out


def _judged(docs: DataFrame, k: int, num: int, den: int, text: str) -> DataFrame:
    """One row per document: doc_id, mark (a hash of the text), root (a class of its component), n_shingles, component_id."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), F.col(text).alias("text"))
    whole = stash(source.mapInArrow(_sets(k, num, den), "doc_id long, mark long, n long, key long, tokens array<long>, p int, bits binary"), "sets")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    matrix = _matrix(whole, parts)
    base = stash(whole.select("doc_id", "mark", "n", "key"), "documents")
    named = whole.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("bits").alias("bits"))
    classes = stash(named, "classes")
    drop(whole)
    kept = _kept(reduce(DataFrame.union, matrix))
    drop(*matrix)

    # the partition: each class with the hub of most of its tokens
    pair = (F.col("key") != F.col("hub")) & (~F.col("heavy") | F.col("poor") | F.col("hub_poor"))
    often = kept.where(pair).groupBy("key", "hub").agg(F.count(F.lit(1)).alias("c"))
    tried = stash(often.groupBy("key").agg(F.max(F.struct("c", "hub")).alias("b")).select(F.col("key").alias("u"), F.col("b.hub").alias("v")), "tried")
    links = _verify(_bounded(tried, classes, num, den), classes, source, k, num, den, "links-1")
    roots = components(links)

    # each class that still stands apart with every hub of its tokens
    left = stash(_apart(kept, roots), "left", let_go=True)
    more = left.where(pair & (F.col("comp") != F.col("hub_comp"))).select(F.col("key").alias("u"), F.col("hub").alias("v")).distinct()
    more = more.join(tried.toDF("tu", "tv"), ((F.col("u") == F.col("tu")) & (F.col("v") == F.col("tv"))), "left_anti")
    more = more.where("u < v").union(more.where("u > v").select("v", "u")).distinct()
    found = _verify(_bounded(more, classes, num, den), classes, source, k, num, den, "links-2")
    if not found.isEmpty():
        links = links.union(found)
        drop(roots)
        roots = components(links)

    # members other than the hub that still stand apart, against groups; rows with the same members once
    names = ("token", "key", "heavy", "poor", "hub")
    split = stash(_merged(_apart(left.where("key <> hub").select(*names), roots)), "split", let_go=True)
    drop(kept, tried, left)
    most, rounds = NEAREST, []
    while True:
        # the first round takes a row of each class in heavy tokens; others are short
        blocks = _blocks(split, classes, parts) if rounds else _blocks(_longest(split.where("heavy")), classes, parts, BAND)
        opened = stash(blocks.mapInArrow(_open_groups(num, den, most), "u long, v long, cut long"), "opened", let_go=True)
        drop(blocks)
        new = opened.select("u", "v").distinct()
        for known in rounds:  # a class's nearest come again
            new = new.join(known.select(F.col("u").alias("tu"), F.col("v").alias("tv")), (F.col("u") == F.col("tu")) & (F.col("v") == F.col("tv")), "left_anti")
        found = _verify(new, classes, source, k, num, den, f"links-{3 + len(rounds)}")
        if not found.isEmpty():
            links = links.union(found)
            drop(roots)
            roots = components(links)
        rounds.append(opened)
        again = split.select(*names)
        if len(rounds) > 1:
            cut = opened.where("cut is not null").select(F.col("cut").alias("t")).distinct()
            if cut.isEmpty():
                break
            again = again.join(cut, F.col("token") == F.col("t"), "left_semi")
        most *= 8
        after = stash(_apart(again, roots), "split", let_go=True)
        drop(split)
        split = after
    drop(split, *rounds)

    # every class with its component's smallest doc_id
    named = classes.join(roots, F.col("key") == F.col("node"), "left").select("key", "rep", F.coalesce("root", "key").alias("root"))
    small = named.groupBy("root").agg(F.min("rep").alias("component_id")).withColumnRenamed("root", "r")
    ids = stash(named.join(small, F.col("root") == F.col("r")).select(F.col("key").alias("c_key"), "root", "component_id"), "components")
    drop(roots, classes)
    release(docs.sparkSession)
    out = base.join(ids, F.col("key") == F.col("c_key"), "left")
    return out.select("doc_id", "mark", "root", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def link(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id. Documents link when den * common >= num * union."""
    return _judged(docs, k, num, den, text).drop("mark", "root")


def keep_one(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each component one row with the smallest doc_id stays.

    Rows of that doc_id with several texts in one component: the one whose text has the smallest hash. Documents without words,
    and those without a doc_id, all stay.
    """
    judged = _judged(docs, k, num, den, text).where("n_shingles > 0 and doc_id is not null")
    each = judged.groupBy("doc_id", "mark", "root", "component_id").agg(F.count(F.lit(1)).alias("times"))
    best = each.where("doc_id = component_id").groupBy(F.col("root").alias("b_root")).agg(F.min("mark").alias("b_mark"))
    stays = (F.col("doc_id") == F.col("component_id")) & (F.col("mark") == F.col("b_mark"))
    told = each.join(best, F.col("root") == F.col("b_root")).select("doc_id", "mark", stays.alias("stays"), "times")
    own = fresh(docs, "kept_id", "kept_mark", "kept_stays", "kept_times")
    told = stash(told.where("not stays or times > 1").toDF(*own), "near-duplicates", let_go=True)
    same = (docs["doc_id"].cast("long") == F.col(own[0])) & (F.xxhash64(docs[text]) == F.col(own[1]))
    joined = docs.join(_sent(told), same, "left")
    alone = joined.where(F.col(own[0]).isNull()).select(*docs.columns)
    repeated = joined.where(F.col(own[2])).select(*docs.columns).dropDuplicates(["doc_id", text])
    return alone.unionByName(repeated)
