"""Items that appear together: counts, ratio to chance and significance of all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut

GIANTS = 1024
HOT_PARTS = 64
FLUSH = 2_000_000
PIECE = 1024
STRIPES = "a long, part int, b array<long>, n array<long>"


def _stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stripes of the sets in `x` (pairs within) or between `x` and `y` where y is not null, merged within the
    task: for each item a the array of its partners b > a and their counts, in rows of at most PIECE partners. Ids
    are even, hot items' are odd: their stripes are cut in HOT_PARTS by partner, so that no reducer gets a whole
    one."""
    held: list[np.ndarray] = []
    size = 0

    def merged() -> Iterator[pa.RecordBatch]:
        code, n = np.unique(np.concatenate(held), return_counts=True)
        a, b = code >> 32, code & 0xFFFFFFFF
        part = np.where(a & 1, (b >> 1) % HOT_PARTS, 0)
        if (a & 1).any():
            order = np.lexsort((b, part, a))
            a, b, n, part = a[order], b[order], n[order], part[order]
        starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (part[1:] != part[:-1])])
        inside = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)]))
        starts = np.flatnonzero(inside % PIECE == 0)
        ends = np.r_[starts, len(a)].astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int64))) for v in (b, n)]
        yield pa.RecordBatch.from_arrays([pa.array(a[starts]), pa.array(part[starts].astype(np.int32)), *lists], ["a", "part", "b", "n"])

    for batch in batches:
        xs, ys = batch.column("x"), batch.column("y")
        x_at, x = np.asarray(xs.offsets), np.asarray(xs.values)
        y_at, y = np.asarray(ys.offsets), np.asarray(ys.values)
        within = np.asarray(ys.is_null())
        lengths = np.diff(x_at)
        # sets of one length together: one matrix, its pairs by column numbers
        for size_x in np.unique(lengths[within]):
            rows = x_at[:-1][within & (lengths == size_x)]
            i, j = np.triu_indices(size_x, 1)
            step = max(1, FLUSH // max(1, len(i)))
            for k in range(0, len(rows), step):
                m = np.sort(x[rows[k : k + step, None] + np.arange(size_x)], axis=1)
                held.append(((m[:, i] << 32) | m[:, j]).ravel())
                size += len(held[-1])
                if size >= FLUSH:
                    yield from merged()
                    held, size = [], 0
        for r in np.flatnonzero(~within):
            p, q = x[x_at[r] : x_at[r + 1]], y[y_at[r] : y_at[r + 1]]
            held.append(((np.minimum.outer(p, q) << 32) | np.maximum.outer(p, q)).ravel())
            size += len(held[-1])
            if size >= FLUSH:
                yield from merged()
                held, size = [], 0
    if size:
        yield from merged()


def _added(least: int):
    """Stripes sorted by item and part, those of one item and part added up to one: rows a, b, n of at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 4

        def total(a: np.ndarray, part: np.ndarray, b: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
            order = np.lexsort((b, part, a))
            a, part, b, n = a[order], part[order], b[order], n[order]
            starts = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (a[1:] != a[:-1])]) if len(a) else order
            return [a[starts], part[starts], b[starts], np.add.reduceat(n, starts) if len(a) else n]

        def out(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            keep = n >= least
            return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (a, b, n)], ["a", "b", "n"])

        for batch in batches:
            each = np.diff(np.asarray(batch.column("b").offsets))
            new = [np.repeat(np.asarray(batch.column(c)).astype(np.int64), each) for c in ("a", "part")]
            new += [np.asarray(batch.column(c).flatten()) for c in ("b", "n")]
            a, part, b, n = total(*(np.concatenate([x, y]) for x, y in zip(held, new)))
            # the last item and part may go on in the next batch
            done = len(a) if not len(a) else int(np.flatnonzero((a != a[-1]) | (part != part[-1]))[-1:].sum() + ((a != a[-1]) | (part != part[-1])).any())
            yield out(a[:done], b[:done], n[:done])
            held = [x[done:] for x in (a, part, b, n)]
        if len(held[0]):
            yield out(held[0], held[2], held[3])

    return run


def _entropy(*counts: Column) -> Column:
    total = sum(counts[1:], counts[0])
    part = lambda k: F.when(k > 0, k * F.log(k / total)).otherwise(0.0)
    return sum((part(k) for k in counts[1:]), part(counts[0]))


def log_likelihood_ratio(n: Column, a: Column, b: Column, total: Column) -> Column:
    """G squared of the 2 x 2 table of two events: both n times, singly a and b times, of total cases."""
    k = [x.cast("double") for x in (n, a - n, b - n, total - a - b + n)]
    rows, cols = _entropy(k[0] + k[1], k[2] + k[3]), _entropy(k[0] + k[2], k[1] + k[3])
    return F.greatest(F.lit(0.0), 2 * (_entropy(*k) - rows - cols))


def items_together(
    df: DataFrame,
    basket: str,
    item: str,
    *,
    min_together: int = 1,
    min_ratio: float = 0.0,
    min_cosine2: float = 0.0,
    min_llr: float = 0.0,
    block: int = 256,
    hot_baskets: int = 100_000,
) -> DataFrame:
    """`item_a` < `item_b`, `n` baskets with both, `n_a`, `n_b` with each, `baskets` in all, `ratio` of n to what
    chance gives (n_a n_b / baskets) and the log-likelihood ratio `llr`, for every pair that is together in at
    least min_together baskets, has at least min_ratio, n squared of at least min_cosine2 n_a n_b, and an llr of at
    least min_llr (chi squared of one degree of freedom: 7.88 is the 0.5 % level).

    An item counts once in a basket; rows with null basket or item are left out; an item alone in its baskets
    and an empty table give no pair. Other columns are ignored. Item identifiers of any sortable type.

    Method: stripes. Each task turns baskets into arrays of partners by item and merges them; the merged arrays
    go to the reducers by item (a hot item's in parts, by partner) and are added up there, array by array. The bounds prune
    items before: n <= min(n_a, n_b), so an item in under min_together or over baskets / min_ratio baskets has no
    pair. Baskets of more than `block` items are cut in blocks, and the block pairs spread over the tasks. Of
    these the GIANTS largest never list their pairs where min_together > 1: a pair must be together in another
    basket, or both its items be in min_together giants; the former take the number of common giants from their
    lists of giants (at most GIANTS long), only the latter are listed. The result is exact either way.
    """
    rows = df.select(F.col(basket).alias("s"), F.col(item).alias("i")).where("s IS NOT NULL AND i IS NOT NULL").distinct()
    rows = cut(rows)
    total = rows.agg(F.count_distinct("s")).first()[0]
    items = rows.groupBy("i").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_together)
    if min_ratio > 0:
        items = items.where(F.col("n") * F.lit(float(min_ratio)) <= F.lit(total))
    items = cut(items)
    # contiguous ids: rows before a partition, one number for each partition, and the place within
    pid, place = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r[0]: r[1] for r in items.groupBy(pid.alias("p")).count().collect()}
    before = np.cumsum([0] + [sizes.get(p, 0) for p in range(max(sizes, default=0) + 1)])
    if before[-1] >= 1 << 31:
        raise ValueError("more than 2^31 frequent items")
    ahead = F.element_at(F.array(*[F.lit(int(x)) for x in before]), pid + 1)
    items = items.select("i", "n", ((ahead + place) * 2 + (F.col("n") > hot_baskets).cast("long")).alias("id"))

    lean = rows.join(items.select("i", "id"), "i").select("s", "id")
    sizes_of = lean.groupBy("s").agg(F.count(F.lit(1)).alias("size"))
    long = cut(sizes_of.where(F.col("size") > block))
    lists = lambda r, *by: r.groupBy(*by).agg(F.collect_list("id").alias("x"))
    nothing = F.lit(None).cast("array<long>").alias("y")
    parts = [lists(lean.join(long, "s", "left_anti"), "s").where("size(x) > 1").select("x", nothing)]
    giants, dense = None, None
    if not long.isEmpty():
        listed = lean.join(long, "s")
        if min_together > 1:
            top = long.orderBy(F.col("size").desc(), "s").limit(GIANTS)
            top = top.select("s", (F.row_number().over(Window.orderBy("s")) - 1).alias("giant"))  # at most GIANTS rows
            listed = cut(listed.join(F.broadcast(top), "s", "left"))
            words = -(-GIANTS // 64)
            bit = F.expr("shiftleft(1L, CAST(giant % 64 AS INT))")
            bits = [F.coalesce(F.bit_or(F.when(F.floor(F.col("giant") / 64) == w, bit)), F.lit(0).cast("long")) for w in range(words)]
            giants = cut(listed.where("giant IS NOT NULL").groupBy("id").agg(F.array(*bits).alias("g")))
            held_by = sum((F.bit_count(F.col("g")[w]) for w in range(1, words)), F.bit_count(F.col("g")[0]))
            dense = giants.where(held_by >= min_together).select("id", F.lit(True).alias("dense"))
            listed = listed.where("giant IS NULL").unionByName(listed.where("giant IS NOT NULL").join(dense, "id", "left_semi"))
        many = F.ceil(F.col("size") / F.lit(block)).cast("long")
        blocks = cut(lists(listed.withColumn("k", F.pmod(F.xxhash64("id"), many)), "s", "k"))
        parts.append(blocks.select("x", nothing))
        other = blocks.select("s", F.col("k").alias("k2"), F.col("x").alias("y"))
        parts.append(blocks.join(other, "s").where("k < k2").select("x", "y"))
    sets = parts[0]
    for p in parts[1:]:
        sets = sets.unionAll(p)
    stripes = sets.mapInArrow(_stripes, STRIPES).repartition("a", "part").sortWithinPartitions("a", "part")
    pairs = stripes.mapInArrow(_added(min_together if giants is None else 1), "a long, b long, n long")
    if giants is not None:
        for side in "ab":
            of = giants.join(dense, "id", "left").select(F.col("id").alias(side), F.col("g").alias(f"g{side}"), F.col("dense").alias(f"d{side}"))
            pairs = pairs.join(of, side, "left")
        words = [F.bit_count(F.col("ga")[w].bitwiseAND(F.col("gb")[w])) for w in range(-(-GIANTS // 64))]
        common = F.coalesce(sum(words[1:], words[0]), F.lit(0))
        pairs = pairs.withColumn("n", F.col("n") + F.when(F.col("da") & F.col("db"), 0).otherwise(common))
    pairs = pairs.where(F.col("n") >= min_together).select("a", "b", "n")
    for side in "ab":
        pairs = pairs.join(items.select(F.col("id").alias(side), F.col("i").alias(f"i{side}"), F.col("n").alias(f"n{side}")), side)
    swap = F.col("ia") > F.col("ib")
    out = pairs.select(
        F.when(swap, F.col("ib")).otherwise(F.col("ia")).alias("item_a"),
        F.when(swap, F.col("ia")).otherwise(F.col("ib")).alias("item_b"),
        "n",
        F.when(swap, F.col("nb")).otherwise(F.col("na")).alias("n_a"),
        F.when(swap, F.col("na")).otherwise(F.col("nb")).alias("n_b"),
        F.lit(total).cast("long").alias("baskets"),
    )
    product = F.col("n_a") * F.col("n_b")
    out = out.where((F.col("n") * F.col("baskets") >= F.lit(float(min_ratio)) * product) & (F.col("n") * F.col("n") >= F.lit(float(min_cosine2)) * product))
    out = out.withColumns({
        "ratio": F.col("n") * F.col("baskets") / product,
        "llr": log_likelihood_ratio(F.col("n"), F.col("n_a"), F.col("n_b"), F.col("baskets")),
    })
    return out.where(F.col("llr") >= min_llr)
