"""Candidate generators: (query_id, item_id, score) from an event log, and their union.

Sums of decayed weights are taken by whole days and added in the order of the days, so that equal items have equal
scores on any partitioning; ties fall by item. Nothing is rounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ranking import best
from millrace.operators.timeline import history as history
from millrace.session import cut

DAY_US = 86_400_000_000
BUCKETS = 1024


def until(log: DataFrame, cutoff: str, window_days: int | None = None) -> DataFrame:
    """Rows up to the cutoff, of the last window_days before it where given."""
    end = F.lit(cutoff).cast("timestamp")
    known = log.where(F.col("ts") <= end)
    return known if window_days is None else known.where(F.unix_micros("ts") >= F.unix_micros(end) - window_days * DAY_US)


def summed(df: DataFrame, keys: Sequence[str], day: str, n: str, weight: Callable[[Column], Column]) -> DataFrame:
    """keys, w: the sum of n times the weight of the day, in the order of the days, of which a key has few."""
    by_day = df.groupBy(*keys, day).agg(F.sum(n).alias("__n"))
    days = by_day.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(day).alias("d"), F.col("__n").alias("n")))).alias("x"))
    return days.select(*keys, F.aggregate("x", F.lit(0.0), lambda s, x: s + x["n"] * weight(x["d"])).alias("w"))


def popularity(log: DataFrame, cutoff: str, decay_days: float = 30, window_days: int | None = None) -> DataFrame:
    """item_id and score: the sum of exp(-age / decay) of its events up to the cutoff, where age is whole days to the
    last of these events."""
    known = until(log, cutoff, window_days).where("item_id IS NOT NULL AND ts IS NOT NULL").select("item_id", F.unix_micros("ts").alias("us"))
    last = known.agg(F.max("us")).scalar()
    aged = known.select("item_id", F.floor((last - F.col("us")) / DAY_US).alias("age"), F.lit(1).alias("n"))
    return summed(aged, ["item_id"], "age", "n", lambda d: F.exp(-d / F.lit(float(decay_days)))).withColumnRenamed("w", "score")


def top_for_all(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """The k best items for every query: the k rows, at most, travel as one array beside each query."""
    top = items.orderBy(F.col("score").desc(), "item_id").limit(k).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "item_id")))).scalar()
    return queries.select("query_id", F.explode(top).alias("x")).select("query_id", "x.item_id", (-F.col("x.s")).alias("score"))


def paired(rows: DataFrame, scope: str, values: Sequence[str], block: int = 512) -> DataFrame:
    """Every unordered pair of rows of one scope: each value as {value}_a and {value}_b. Scopes of more than `block`
    rows are cut in blocks that meet in different tasks."""
    rows = cut(rows.where(F.col(scope).isNotNull()).select(F.col(scope).alias("s"), *values).withColumn("r", F.monotonically_increasing_id()))
    long = rows.groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block).select("s", F.ceil(F.col("n") / block).cast("long").alias("m"))
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    rows = rows.join(long, "s", "left").withColumn("m", F.coalesce("m", one)).withColumn("k", F.pmod(F.xxhash64("r"), F.col("m")))
    a = rows.select("s", F.col("r").alias("ra"), *[F.col(v).alias(f"{v}_a") for v in values], F.col("k").alias("ka"), F.explode(F.sequence("k", F.col("m") - 1)).alias("kb"))
    b = rows.select("s", F.col("r").alias("rb"), *[F.col(v).alias(f"{v}_b") for v in values], F.explode(F.sequence(zero, F.col("k"))).alias("ka"), F.col("k").alias("kb"))
    return a.join(b, ["s", "ka", "kb"]).where("ka < kb OR ra < rb").drop("s", "ka", "kb", "ra", "rb")


def both_ways(edges: DataFrame) -> DataFrame:
    turned = edges.select(*[F.col({"item_i": "item_j", "item_j": "item_i"}.get(c, c)).alias(c) for c in edges.columns])
    return edges.unionByName(turned.where("item_i <> item_j"))


def covisit_edges(log: DataFrame, cutoff: str, scope: str = "session_id", alpha: float = 0.05, min_weight: float = 1.0, neighbours: int | None = 200, window_days: int | None = 30) -> DataFrame:
    """item_i, item_j, w: every two events of one scope within the window before the cutoff link their items by
    exp(-alpha days), days being the whole days between the two; sums of under min_weight are left out, and each item
    keeps its best `neighbours` (None: all). Symmetric before that; two events of one item link it with itself, both
    ways at once."""
    rows = until(log, cutoff, window_days).where("item_id IS NOT NULL AND ts IS NOT NULL").select(scope, "item_id", F.unix_micros("ts").alias("us"))
    pairs = paired(rows, scope, ["item_id", "us"])
    gap = F.floor(F.abs(F.col("us_a") - F.col("us_b")) / DAY_US)
    twice = F.when(F.col("item_id_a") == F.col("item_id_b"), 2).otherwise(1)
    links = pairs.select(F.least("item_id_a", "item_id_b").alias("item_i"), F.greatest("item_id_a", "item_id_b").alias("item_j"), gap.alias("gap"), twice.alias("n"))
    edges = summed(links, ["item_i", "item_j"], "gap", "n", lambda d: F.exp(-alpha * d)).where(F.col("w") >= min_weight)
    edges = both_ways(cut(edges))
    return edges if neighbours is None else best(edges, "item_i", "w", "item_j", neighbours).drop("rank")


def covisit_candidates(hist: DataFrame, edges: DataFrame, decay: float = 0.9) -> DataFrame:
    """Sum over the history of decay^pos times the edge weight, in the order of pos."""
    part = F.struct("pos", (F.pow(F.lit(decay), "pos") * F.col("w")).alias("x"))
    met = hist.join(edges, hist.item_id == edges.item_i).groupBy("query_id", F.col("item_j").alias("item_id")).agg(F.sort_array(F.collect_list(part)).alias("x"))
    return met.select("query_id", "item_id", F.aggregate("x", F.lit(0.0), lambda s, x: s + x["x"]).alias("score"))


def ngram_transitions(log: DataFrame, cutoff: str, max_n: int = 3, scope: str = "user_id", order: Sequence[str] = ("line", "item_id")) -> DataFrame:
    """prefix (array of up to max_n items), next, p: shares of the items that follow a prefix in a scope's events."""
    known = until(log, cutoff).where(F.col(scope).isNotNull() & F.col("item_id").isNotNull())
    w = Window.partitionBy(scope).orderBy("ts", *order)
    before = known.withColumns({f"b{n}": F.lag("item_id", n).over(w) for n in range(1, max_n + 1)})
    prefixes = F.array(*[F.when(F.col(f"b{n}").isNotNull(), F.array(*[F.col(f"b{k}") for k in range(n, 0, -1)])) for n in range(1, max_n + 1)])
    counts = before.select(F.explode(F.array_compact(prefixes)).alias("prefix"), F.col("item_id").alias("next")).groupBy("prefix", "next").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("prefix").agg(F.sum("n").alias("total"))
    return counts.join(totals, "prefix").select("prefix", "next", (F.col("n") / F.col("total")).alias("p"))


def ngram_candidates(hist: DataFrame, transitions: DataFrame, max_n: int = 3, decay: float = 0.9) -> DataFrame:
    """Back-off sum over the prefixes that end a query's history: decay^(n-1) times the share."""
    seq = hist.groupBy("query_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("pos")).alias("k"), "item_id"))), lambda x: x["item_id"]).alias("items"))
    tails = F.array_compact(F.array(*[F.when(F.size("items") >= n, F.slice("items", -n, n)) for n in range(1, max_n + 1)]))
    asked = seq.select("query_id", F.explode(tails).alias("prefix"))
    hits = asked.join(transitions, "prefix")
    return hits.groupBy("query_id", F.col("next").alias("item_id")).agg(F.sum(F.pow(F.lit(decay), F.size("prefix") - 1) * F.col("p")).alias("score"))


def links_of(log: DataFrame, cutoff: str, scope: str = "session_id") -> DataFrame:
    """item_i < item_j: the distinct items that share a scope up to the cutoff."""
    pairs = paired(until(log, cutoff).where("item_id IS NOT NULL").select(scope, "item_id").distinct(), scope, ["item_id"])
    return pairs.select(F.least("item_id_a", "item_id_b").alias("item_i"), F.greatest("item_id_a", "item_id_b").alias("item_j")).distinct()


def neighbour_jaccard(links: DataFrame) -> DataFrame:
    """item_i, item_j, jaccard of the sets of neighbours of every two linked items (links: item_i < item_j, once
    each), both ways. Common neighbours are triangles: each is found once, from its corner of least degree, so that an
    item linked with most others is never joined with all pairs of its neighbours."""
    links = cut(links)
    size = cut(both_ways(links).groupBy("item_i").agg(F.count(F.lit(1)).alias("n")))
    of = lambda side: size.select(F.col("item_i").alias(f"item_{side}"), F.col("n").alias(f"n{side}"))
    e = cut(links.join(of("i"), "item_i").join(of("j"), "item_j"))
    low = F.struct("ni", "item_i") < F.struct("nj", "item_j")
    up = cut(e.select(F.when(low, F.col("item_i")).otherwise(F.col("item_j")).alias("u"), F.when(low, F.struct("nj", F.col("item_j").alias("id"))).otherwise(F.struct(F.col("ni").alias("nj"), F.col("item_i").alias("id"))).alias("v")))
    wedges = up.join(up.select("u", F.col("v").alias("w")), "u").where("v < w").select("u", F.col("v.id").alias("v"), F.col("w.id").alias("w"))
    corners = wedges.join(up.select(F.col("u").alias("v"), F.col("v.id").alias("w")), ["v", "w"])
    sides = F.array(*[F.struct(F.least(x, y).alias("item_i"), F.greatest(x, y).alias("item_j")) for x, y in (("u", "v"), ("u", "w"), ("v", "w"))])
    common = corners.select(F.explode(sides).alias("e")).groupBy("e.item_i", "e.item_j").agg(F.count(F.lit(1)).alias("c"))
    c = F.coalesce("c", F.lit(0))
    both = e.join(common, ["item_i", "item_j"], "left").select("item_i", "item_j", (c / (F.col("ni") + F.col("nj") - c)).alias("jaccard"))
    return both_ways(both)


def jaccard_candidates(hist: DataFrame, jaccard: DataFrame) -> DataFrame:
    """Sum over the history of the similarity of its items' neighbours, in the order of pos."""
    met = hist.join(jaccard, hist.item_id == jaccard.item_i).groupBy("query_id", F.col("item_j").alias("item_id")).agg(F.sort_array(F.collect_list(F.struct("pos", "jaccard"))).alias("x"))
    return met.select("query_id", "item_id", F.aggregate("x", F.lit(0.0), lambda s, x: s + x["jaccard"]).alias("score"))


MAX_LINKS = 4_000_000
CELLS = 8_000_000
GATHERED = 200_000
TASK_LINKS = 1_000_000_000


def personalised_rank(edges: DataFrame, seeds: DataFrame, restart: float = 0.15, rounds: int = 10, k: int | None = None, apart: float = 0.0) -> DataFrame:
    """query_id, item_id, score: random walks with restart from each query's seed items along edge weights; a seed
    that is named twice counts twice; walks that come to an item without edges end there. With k, items may be left
    out that are not among a query's best k, ties by item, scores of at most `apart` between them being taken for
    ties; walks beside the graph so give few rows more than k a query instead of all items that they reach.

    A graph of at most MAX_LINKS edges, counted before, is broadcast (16 bytes each beside the items), and every task
    walks from the queries of its own, some at a time, without an exchange. A larger graph is walked in rounds of
    joins, each materialised."""
    edges = edges.where("w > 0")
    total = edges.groupBy("item_i").agg(F.sum("w").alias("t"))
    step = cut(edges.join(total, "item_i").select("item_i", "item_j", (F.col("w") / F.col("t")).alias("p")))
    n = seeds.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    start = seeds.join(n, "query_id").groupBy("query_id", "item_id").agg(F.sum(1 / F.col("n")).alias("s"))
    if step.count() <= MAX_LINKS:
        return _walked(step, start, restart, rounds, k, apart)
    start = cut(start)
    now = start
    for _ in range(rounds):
        moved = now.join(step, now.item_id == step.item_i).select("query_id", F.col("item_j").alias("item_id"), ((1 - restart) * F.col("s") * F.col("p")).alias("s"))
        back = start.withColumn("s", restart * F.col("s"))
        now = cut(moved.unionByName(back).groupBy("query_id", "item_id").agg(F.sum("s").alias("s")))
    return now.withColumnRenamed("s", "score")


def _leading(scores: np.ndarray, k: int | None, apart: float) -> np.ndarray:
    """Places of the scores above 0: with k, of those that can be among the k best, ties by place."""
    if k is None or len(scores) <= k:
        return np.flatnonzero(scores)
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    at = np.flatnonzero((scores > 0) & (scores >= least - apart))
    at = at[np.argsort(-scores[at], kind="stable")]
    new = np.r_[True, scores[at][1:] != scores[at][:-1]]
    run = np.arange(len(at)) - np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    return at[run < k]


def _walked(step: DataFrame, start: DataFrame, restart: float, rounds: int, k: int | None, apart: float) -> DataFrame:
    links = step.toArrow()
    ends = [links[c].to_numpy() for c in ("item_i", "item_j")]
    items, place = np.unique(np.concatenate(ends), return_inverse=True)
    source, target = place[: len(links)].astype(np.int32), place[len(links) :].astype(np.int32)
    order = np.argsort(target, kind="stable")
    source, target, p = source[order], target[order], (1 - restart) * links["p"].to_numpy()[order]
    starts = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.empty(0, np.int64)
    held = step.sparkSession.sparkContext.broadcast((items, source, target[starts] if len(starts) else target, starts, p))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items, source, target, starts, p = held.value
        number = pd.Series(np.arange(len(items)), index=items)
        wide = max(1, min(512, CELLS // max(1, len(items))))
        # items with as many links are one product: links by item, gathered some at a time
        degree = np.diff(np.r_[starts, len(source)])
        groups = []
        for d in np.unique(degree):
            at = np.flatnonzero(degree == d)
            link = starts[at][:, None] + np.arange(d)
            groups.append((target[at], source[link], p[link][:, None, :]))

        def moved(now: np.ndarray) -> np.ndarray:
            new = np.zeros_like(now)
            across = max(1, GATHERED // now.shape[1])
            for at, link, weight in groups:
                many = max(1, across // link.shape[1])
                for a in range(0, len(at), many):
                    for b in range(0, link.shape[1], across):
                        part = slice(a, a + many), slice(b, b + across)
                        new[at[a : a + many]] += np.matmul(weight[part[0], :, part[1]], now.take(link[part], axis=0, mode="clip"))[:, 0]
            return new

        for batch in batches:
            for first in range(0, len(batch), wide):
                part = batch.iloc[first : first + wide]
                row = np.repeat(np.arange(len(part)), part["seeds"].map(len))
                seeds, mass = (np.concatenate([np.asarray([x[f] for x in own]) for own in part["seeds"]]) for f in ("item_id", "s"))
                at = number.reindex(seeds).fillna(-1).to_numpy(np.int64)
                known = at >= 0
                now = np.zeros((len(items), len(part)))
                np.add.at(now, (at[known], row[known]), mass[known])
                for _ in range(rounds):
                    now = moved(now)
                    np.add.at(now, (at[known], row[known]), restart * mass[known])
                ids = part["query_id"].to_numpy()
                for a in range(0, len(part), 64):
                    own = np.ascontiguousarray(now[:, a : a + 64].T)
                    found = [_leading(x, k, apart) for x in own]
                    q, i = np.repeat(np.arange(len(own)), [len(x) for x in found]), np.concatenate(found)
                    yield pd.DataFrame({"query_id": ids[a + q], "item_id": items[i], "score": own[q, i]})
                # seeds without any link only restart
                lone = np.flatnonzero(~known)
                yield pd.DataFrame({"query_id": ids[row[lone]], "item_id": seeds[lone], "score": mass[lone] * (restart if rounds else 1.0)})

    kinds = dict(start.dtypes)
    rows = cut(start.groupBy("query_id").agg(F.collect_list(F.struct("item_id", "s")).alias("seeds")))
    # a query's walks take about as long as there are links: tasks of like work, however few bytes they read
    rows = rows.repartition(rows.count() * max(1, len(p)) // TASK_LINKS + 1)
    return rows.mapInPandas(walk, f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, score double")


def merged(sources: Mapping[str, DataFrame], quotas: Mapping[str, int], weights: Mapping[str, float], k: int) -> DataFrame:
    """query_id, item_id, sources, score, rank: of each source its best by quota, scores brought to 0..1 over the
    source (constant: 1), weighted, the greatest per item, the best k."""
    parts = []
    for name, df in sources.items():
        top = best(df, "query_id", "score", "item_id", quotas[name])
        lo, hi = top.agg(F.min("score")).scalar(), top.agg(F.max("score")).scalar()
        norm = F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(1.0)
        parts.append(top.select("query_id", "item_id", F.lit(name).alias("source"), (norm * weights[name]).alias("score")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    one = both.groupBy("query_id", "item_id").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.max("score").alias("score"))
    return best(one, "query_id", "score", "item_id", k)


def sampled_negatives(positives: DataFrame, items: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """query_id, item_id of n items for each query that are not its positives (all of these, where they are fewer),
    drawn from all items without replacement by weight. Items without weight are never drawn.

    Method: a draw is a seeded position on the running sums of the weights, which are sums over hash buckets and
    within them. It meets its item by the cell of an even grid with as many cells as items, so that a draw meets
    two items on average, whatever the weights. Positives and repeats are dropped, and queries that lack items
    draw again, four times as often; as soon as that is no less than all items, they meet every item that they
    lack, with exponential keys, which is the same draw."""
    inside = Window.partitionBy("b").orderBy("item_id")
    it = items.where("item_id IS NOT NULL AND weight > 0").select("item_id", F.col("weight").cast("double").alias("weight"), F.pmod(F.xxhash64("item_id", F.lit(seed)), F.lit(BUCKETS)).alias("b"))
    it = cut(it.withColumn("upto", F.sum("weight").over(inside.rowsBetween(Window.unboundedPreceding, 0))))
    per = it.groupBy("b").agg(F.max("upto").alias("t"), F.count(F.lit(1)).alias("items"))
    ahead = cut(per.withColumn("ahead", F.coalesce(F.sum("t").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))))
    size, mass = ahead.agg(F.coalesce(F.sum("items"), F.lit(0)), F.max(F.col("ahead") + F.col("t"))).first()
    line = it.withColumn("lo", F.coalesce(F.lag("upto").over(inside), F.lit(0.0))).join(F.broadcast(ahead), "b")
    line = line.select("item_id", "weight", (F.col("ahead") + F.col("lo")).alias("lo"), (F.col("ahead") + F.col("upto")).alias("hi"))
    own = cut(positives.where("query_id IS NOT NULL AND item_id IS NOT NULL").select("query_id", "item_id").distinct())
    short = cut(positives.where("query_id IS NOT NULL").select("query_id").distinct().withColumn("lack", F.lit(n)))

    def uniform(*by: str | Column) -> Column:
        return F.pmod(F.xxhash64(*by), F.lit(1 << 52)) / F.lit(float(1 << 52))

    def first(drawn: DataFrame, order: str) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(order, "item_id")
        fresh = drawn.join(own, ["query_id", "item_id"], "left_anti")
        return cut(fresh.withColumn("k", F.row_number().over(w)).where("k <= lack").select("query_id", "item_id"))

    found, done, m = [], 0, 4 * n
    while m < size and not short.isEmpty():
        cell = lambda x: F.floor(x / F.lit(mass / size))
        cells = line.select("item_id", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
        draws = short.select("query_id", "lack", F.explode(F.sequence(F.lit(done), F.lit(done + m - 1))).alias("draw"))
        draws = draws.withColumn("at", uniform("query_id", "draw", F.lit(seed + 1)) * F.lit(mass)).withColumn("cell", cell(F.col("at")))
        hits = draws.join(cells, "cell").where("lo <= at AND at < hi").groupBy("query_id", "lack", "item_id").agg(F.min("draw").alias("draw"))
        found.append(first(hits, "draw"))
        own = own.unionByName(found[-1])
        got = found[-1].groupBy("query_id").agg(F.count(F.lit(1)).alias("got"))
        short = cut(short.join(got, "query_id", "left").select("query_id", (F.col("lack") - F.coalesce("got", F.lit(0))).cast("int").alias("lack")).where("lack > 0"))
        done, m = done + m, 4 * m
    if not found or not short.isEmpty():
        every = short.crossJoin(line.select("item_id", "weight"))
        u = uniform("query_id", "item_id", F.lit(seed + 2)) + F.lit(1 / (1 << 52))
        found.append(first(every.withColumn("key", -F.log(u) / F.col("weight")), "key"))
    return reduce(DataFrame.unionByName, found)
