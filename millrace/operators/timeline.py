"""Operators over event logs in time: query sets, time splits, folds, lags, trailing windows, as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.quality import quantiles
from millrace.session import cut

DAY_US = 86_400_000_000


def latest(df: DataFrame, scope: str, ts: str = "ts") -> DataFrame:
    """One query for each scope (user or session): its last moment as ts_query. Null scopes are left out."""
    return df.where(F.col(scope).isNotNull()).groupBy(scope).agg(F.max(ts).alias("ts_query"))


def time_split(ts: Column, train_until: Column, val_until: Column, embargo_us: int = 0) -> Column:
    """train up to train_until, val from train_until + embargo up to val_until, test from val_until + embargo;
    null in between. At a common bound the later split holds."""
    us, a, b = F.unix_micros(ts), F.unix_micros(train_until), F.unix_micros(val_until)
    return F.when(us >= b + embargo_us, F.when(us > b, "test").otherwise(F.when(F.lit(embargo_us == 0), "test"))).when(
        (us >= a + embargo_us) & (us <= b), "val"
    ).when(us <= a, "train")


def hashed_fold(key: Column, n: int, seed: int = 0) -> Column:
    """Fold of a group, the same for all its rows: 28 bits of its MD5, on any engine."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}"))), 1, 7), 16, 10).cast("long"), F.lit(n)).cast("int")


def stratified_fold(df: DataFrame, label: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """df with `fold`: rows of each label dealt evenly, in the order of a hash. The place in the label is a sum
    over hash buckets and within them, so that a label of most rows is not one task."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")))
    rows = df.withColumns({"__h": h, "__b": F.substring(h, 1, 2)})
    per = rows.groupBy(label, "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(label).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ahead = per.select(F.col(label).alias("__l"), F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__a"))
    inside = F.row_number().over(Window.partitionBy(label, "__b").orderBy("__h", key)) - 1
    joined = rows.withColumn("__i", inside).join(ahead, F.col(label).eqNullSafe(F.col("__l")) & (F.col("__b") == F.col("__c")))
    return joined.withColumn("fold", F.pmod(F.col("__a") + F.col("__i"), F.lit(n)).cast("int")).drop("__h", "__b", "__c", "__l", "__a", "__i")


def time_blocks(df: DataFrame, us: str, n: int) -> DataFrame:
    """df with `fold`: n blocks of time holding about equally many rows; bounds are exact quantiles of the
    moments, so equal moments share a block."""
    bounds = quantiles(df, us, [i / n for i in range(1, n)])
    fold = sum(((F.col(us) >= F.lit(b)).cast("int") for b in bounds), F.lit(0))
    return df.withColumn("fold", fold.cast("int"))


def lags(df: DataFrame, group: str, order: Sequence[str], value: str, steps: Sequence[int]) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumns({f"{value}_lag{k}": F.lag(value, k).over(w) for k in steps})


STATS = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max, "sum": F.sum}


def trailing_rows(df: DataFrame, group: str, order: Sequence[str], value: str, rows: int, stats: Sequence[str]) -> DataFrame:
    """Statistics of the last `rows` rows before each row, the row itself left out."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(-rows, -1)
    return df.withColumns({f"{value}_{s}_last{rows}": STATS[s](value).over(w) for s in stats})


def trailing_time(df: DataFrame, group: str, us: str, value: str, period_us: int, stats: Sequence[str], name: str) -> DataFrame:
    """Statistics of the rows in [t - period, t) of each row's group."""
    w = Window.partitionBy(group).orderBy(us).rangeBetween(-period_us, -1)
    return df.withColumns({f"{value}_{s}_{name}": STATS[s](value).over(w) for s in stats})


def fold_history(df: DataFrame, group: str, us: str, key: str, value: str, fold: str, folds: int, embargo_us: int = 0) -> DataFrame:
    """df with {value}_n, {value}_mean and {value}_last over the rows of the group in other folds whose moment is before
    the row's own less the embargo: null, and n 0, without one. Sums are those of all folds less the own fold's, in two
    range frames; the last row of each of the folds (0 to folds - 1) is carried along the first."""
    until = -(embargo_us + 1)
    w = Window.partitionBy(group).orderBy(us).rangeBetween(Window.unboundedPreceding, until)
    own = Window.partitionBy(group, fold).orderBy(us).rangeBetween(Window.unboundedPreceding, until)
    n, s = (f(value).over(w) - F.coalesce(f(value).over(own), F.lit(0)) for f in (F.count, F.sum))
    last = {k: F.max(F.when(F.col(fold) == k, F.struct(us, key, value))).over(w) for k in range(folds)}
    out = df.withColumns({f"{value}_n": n, f"{value}_mean": F.when(n > 0, s / n)} | {f"__l{k}": x for k, x in last.items()})
    others = [F.when(F.col(fold) != k, F.col(f"__l{k}")) for k in range(folds)]
    return out.withColumn(f"{value}_last", F.greatest(*others)[value] if folds > 1 else F.lit(None)).drop(*[f"__l{k}" for k in range(folds)])


def running_counters(df: DataFrame, actor: str, item: str, order: Sequence[str], us: str) -> DataFrame:
    """df with so_far (the actor's rows before), gap_days since its last row, and seen (rows of actor and item before)."""
    w, pair = Window.partitionBy(actor).orderBy(*order), Window.partitionBy(actor, item).orderBy(*order)
    return df.withColumns({"so_far": F.row_number().over(w).cast("long") - 1, "gap_days": (F.col(us) - F.lag(us).over(w)) / DAY_US, "seen": F.row_number().over(pair).cast("long") - 1})


def ewm_mean(df: DataFrame, group: str, order: Sequence[str], value: str, span: float) -> DataFrame:
    """Exponentially weighted mean with alpha 2 / (span + 1), not adjusted, the row itself included, in the order of the
    columns named. A recursion over a whole group: one group must fit a worker; nulls keep the last mean."""
    alpha = 2 / (span + 1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(order))
        return pdf.assign(ewm=pdf[value].ewm(alpha=alpha, adjust=False).mean())

    narrow = df.select(group, *order, value)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema)
    return narrow.groupBy(group).applyInPandas(run, f"{kinds}, ewm double")


def asof_join(left: DataFrame, right: DataFrame, by: str, on: str, values: Sequence[str], strict: bool = False, slot: int = DAY_US) -> DataFrame:
    """left with the values of the last right row of the same `by` whose `on`, a whole number, is not after (strict:
    before) its own. Of several right rows at one moment the greatest values, in their order, hold; rows with null by
    or on get nulls. Union and carry forward within slots of `on`; each slot takes the last row of those before it, so
    that no task holds more than a slot of a key, however frequent it is."""
    keep, seen = F.struct(*[F.col(c) for c in left.columns]), F.struct(F.col(on).alias("__on"), *[F.col(c) for c in values])
    ltype, rtype = left.select(keep.alias("s")).schema["s"].dataType, right.select(seen.alias("s")).schema["s"].dataType
    a = left.select(F.col(by).alias("__by"), F.col(on).alias("__on"), F.lit(0 if strict else 1).alias("__side"), keep.alias("__l"), F.lit(None).cast(rtype).alias("__r"))
    b = right.where(F.col(by).isNotNull() & F.col(on).isNotNull()).select(F.col(by).alias("__by"), F.col(on).alias("__on"), F.lit(1 if strict else 0).alias("__side"), F.lit(None).cast(ltype).alias("__l"), seen.alias("__r"))
    both = a.unionAll(b).withColumn("__slot", F.floor(F.col("__on") / slot))
    before = Window.partitionBy("__by").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
    ahead = both.groupBy("__by", "__slot").agg(F.max("__r").alias("m")).select(F.col("__by").alias("__b"), F.col("__slot").alias("__s"), F.max("m").over(before).alias("__a"))
    w = Window.partitionBy("__by", "__slot").orderBy("__on", "__side").rowsBetween(Window.unboundedPreceding, 0)
    run = both.withColumn("__r", F.max("__r").over(w)).where("__l IS NOT NULL")
    met = run.join(ahead, (F.col("__by") == F.col("__b")) & (F.col("__slot") == F.col("__s")), "left").withColumn("__r", F.coalesce("__r", "__a"))
    ok = F.col("__by").isNotNull() & F.col("__on").isNotNull()
    return met.select("__l.*", *[F.when(ok, F.col(f"__r.{c}")).alias(f"{c}_asof") for c in values])


def daily_cumulative(df: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """key, day, n of the day and n up to the day: the table that answers windowed counts by two as-of lookups."""
    days = df.groupBy(key, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return days.withColumn("cum", F.sum("n").over(Window.partitionBy(key).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def counts_before(queries: DataFrame, events: DataFrame, key: str, query_day: str, days: Sequence[int]) -> DataFrame:
    """queries with n_{w}d for every w: events of the key in the w whole days before the query's day. Union of
    daily counts and queries, then sums over day ranges: cost by days, not by events."""
    daily = events.groupBy(key, F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    keep = F.struct(*[F.col(c) for c in queries.columns])
    a = queries.select(F.col(key).alias("__k"), F.unix_date(query_day).alias("__d"), F.lit(0).cast("long").alias("__n"), keep.alias("__q"))
    b = daily.select(F.col(key), F.unix_date("day"), "n", F.lit(None).cast(a.schema["__q"].dataType))
    both = a.unionAll(b)
    w = Window.partitionBy("__k").orderBy("__d")
    out = both.withColumns({f"n_{d}d": F.coalesce(F.sum("__n").over(w.rangeBetween(-d, -1)), F.lit(0)) for d in days})
    return out.where("__q IS NOT NULL").select("__q.*", *[f"n_{d}d" for d in days])


def totals_at(probes: DataFrame, events: DataFrame, key: str, us: str, values: Sequence[str], last: str | None = None) -> DataFrame:
    """probes with, for each value column, the sum of events' values of the same key at moments not after their own,
    0 where there is none, and in the column `last` the latest of those events' moments that have `last` true.

    Sums up to a day (in a window over the days of a key) and within a key's day: no task holds more than a day of a
    key, however frequent it is. Probes with null key or moment keep their row, with zeros and null."""
    day = lambda c: F.floor(F.col(c) / DAY_US)
    mark = F.when(F.col(last), F.col(us)) if last else F.lit(None).cast("long")
    keep = F.struct(*[F.col(c) for c in probes.columns])
    ev = events.where(F.col(key).isNotNull() & F.col(us).isNotNull()).select(F.col(key).alias("__k"), F.col(us).alias("__t"), F.lit(0).alias("__side"), *[F.col(v).cast("long").alias(f"__{v}") for v in values], mark.alias("__last"))
    asked = probes.select(F.col(key).alias("__k"), F.col(us).alias("__t"), F.lit(1).alias("__side"), *[F.lit(0).cast("long").alias(f"__{v}") for v in values], F.lit(None).cast("long").alias("__last"), keep.alias("__p"))
    both = ev.withColumn("__p", F.lit(None).cast(asked.schema["__p"].dataType)).unionByName(asked).withColumn("__d", day("__t"))
    by_day = both.groupBy("__k", "__d").agg(*[F.sum(f"__{v}").alias(f"__{v}") for v in values], F.max("__last").alias("__last"))
    before = Window.partitionBy("__k").orderBy("__d").rowsBetween(Window.unboundedPreceding, -1)
    ahead = by_day.select(F.col("__k").alias("__k2"), F.col("__d").alias("__d2"), *[F.coalesce(F.sum(f"__{v}").over(before), F.lit(0)).alias(f"__a_{v}") for v in values], F.max("__last").over(before).alias("__a_last"))
    inside = Window.partitionBy("__k", "__d").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    run = both.withColumns({f"__{v}": F.sum(f"__{v}").over(inside) for v in values} | {"__last": F.max("__last").over(inside)}).where("__side = 1")
    met = run.join(ahead, (F.col("__k") == F.col("__k2")) & (F.col("__d") == F.col("__d2")), "left")
    known = F.col("__k").isNotNull() & F.col("__t").isNotNull()
    out = [F.when(known, F.col(f"__{v}") + F.col(f"__a_{v}")).otherwise(F.lit(0)).alias(v) for v in values]
    if last:
        out.append(F.when(known, F.coalesce("__last", "__a_last")).alias(last))
    return met.select("__p.*", *out)


def _windowed(pairs: DataFrame, events: DataFrame, key: str, windows: Sequence[int], distinct: str | None = None) -> DataFrame:
    """pairs (with `q`) and for each window of days count_{d} and, of a column, distinct_{d}, and `last`, of the events
    (key, t) of their key in [q - d days, q]. A window's count is the difference of two sums; a distinct value is
    in the window of d days from each of its events on for d days, taken together where these overlap."""
    ev = events.select(key, "t", F.lit(1).alias("n"), F.lit(True).alias("last"), *[F.lit(0).alias(f"u{d}") for d in windows])
    if distinct:
        w = Window.partitionBy(key, distinct).orderBy("t")
        near = events.where(F.col(distinct).isNotNull()).select(key, distinct, "t").distinct()
        near = near.withColumns({"b": F.col("t") - F.lag("t").over(w), "a": F.lead("t").over(w) - F.col("t")})

        def at(t: Column, d: int, x: int) -> Column:
            return F.struct(t.alias("t"), *[F.lit(x if d == e else 0).alias(f"u{e}") for e in windows])

        steps = []
        for d in windows:
            steps.append(F.when(F.coalesce(F.col("b") > d * DAY_US, F.lit(True)), at(F.col("t"), d, 1)))
            steps.append(F.when(F.coalesce(F.col("a") > d * DAY_US, F.lit(True)), at(F.col("t") + (d * DAY_US + 1), d, -1)))
        moved = near.select(key, F.explode(F.array_compact(F.array(*steps))).alias("x")).select(key, "x.t", F.lit(0).alias("n"), F.lit(False).alias("last"), *[f"x.u{d}" for d in windows])
        ev = ev.unionByName(moved)
    asked = pairs.select(key, "q").distinct()
    at = F.array(F.struct(F.lit(0).alias("d"), F.col("q").alias("t")), *[F.struct(F.lit(d).alias("d"), (F.col("q") - (d * DAY_US + 1)).alias("t")) for d in windows])
    probes = asked.select(key, "q", F.explode(at).alias("x")).select(key, "q", "x.d", "x.t")
    got = totals_at(probes, ev, key, "t", ["n", *[f"u{d}" for d in windows]], "last")
    now = lambda c: F.max(F.when(F.col("d") == 0, F.col(c)))
    counts = [(now("n") - F.max(F.when(F.col("d") == d, F.col("n")))).alias(f"count_{d}") for d in windows]
    kinds = [now(f"u{d}").alias(f"distinct_{d}") for d in windows] if distinct else []
    per = got.groupBy(key, "q").agg(now("last").alias("last"), *counts, *kinds)
    return pairs.join(per, [key, "q"], "left")


def pair_features(pairs: DataFrame, log: DataFrame, windows: Sequence[int] = (7, 30, 90)) -> DataFrame:
    """Features of (query_id, user_id, item_id, ts_query) from log rows with ts <= ts_query only: hours since the
    user's and the item's last event, seen_before, and for each window of days the user's and item's counts and
    the user's distinct items. Linear in pairs and events: see totals_at. Repeated pairs are one."""
    p = pairs.select("query_id", "user_id", "item_id", F.unix_micros("ts_query").alias("q")).distinct()
    ev = log.where("ts IS NOT NULL").select("user_id", "item_id", F.unix_micros("ts").alias("t"))
    hours = lambda c: F.round((F.col("q") - F.col(c)) / 3.6e9, 6)
    own = _windowed(p, ev.where("user_id IS NOT NULL"), "user_id", windows, "item_id")
    own = own.select("query_id", "user_id", "item_id", "q", hours("last").alias("recency_user_h"), *[F.col(f"count_{d}").alias(f"user_count_{d}d") for d in windows], *[F.col(f"distinct_{d}").alias(f"user_items_{d}d") for d in windows])
    item = _windowed(p.select("item_id", "q").distinct(), ev.where("item_id IS NOT NULL"), "item_id", windows)
    item = item.select("item_id", "q", hours("last").alias("recency_item_h"), *[F.col(f"count_{d}").alias(f"item_count_{d}d") for d in windows])
    first = ev.where("user_id IS NOT NULL AND item_id IS NOT NULL").groupBy("user_id", "item_id").agg(F.min("t").alias("first"))
    out = own.join(first, ["user_id", "item_id"], "left").withColumn("seen_before", F.coalesce((F.col("first") <= F.col("q")).cast("int"), F.lit(0))).drop("first")
    out = out.join(item, ["item_id", "q"], "left")
    counts = [c for c in out.columns if "_count_" in c or "_items_" in c]
    return out.fillna(0, counts).drop("q")


def last_events(log: DataFrame, last: int, scope: str = "user_id", order: Sequence[str] = ("line", "item_id")) -> DataFrame:
    """query_id, item_id, pos as in history, of one query for each scope, named as it, at the scope's last moment: a
    window that keeps `last` rows of a scope, before and after its one exchange. An event without item has its
    place in the order, and no row."""
    w = Window.partitionBy(scope).orderBy(F.col("ts").desc(), *[F.col(c).desc() for c in order])
    kept = log.where(F.col(scope).isNotNull() & F.col("ts").isNotNull()).select(*dict.fromkeys([scope, "ts", *order, "item_id"])).withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= last)
    return kept.where("item_id IS NOT NULL").select(F.col(scope).alias("query_id"), "item_id", (F.col("pos") - 1).alias("pos"))


def history(log: DataFrame, queries: DataFrame, last: int, scope: str = "user_id", order: Sequence[str] = ("line", "item_id")) -> DataFrame:
    """query_id, item_id, t, pos: the last events of each query's scope up to ts_query, repeats included, pos 0 the
    latest; events of one moment in the order of the columns named. Events and queries are united and numbered along
    each scope; a query then meets its events by scope and number, so that any number of queries of one scope each
    bring `last` rows and no more."""
    ev = log.where(F.col(scope).isNotNull() & F.col("ts").isNotNull() & F.col("item_id").isNotNull())
    ev = ev.select(F.col(scope).alias("s"), F.unix_micros("ts").alias("us"), F.lit(0).alias("side"), *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], "item_id")
    kinds = dict(ev.dtypes)
    empty = [F.lit(None).cast(kinds[c]).alias(c) for c in ev.columns[3:]]
    asked = queries.where(F.col(scope).isNotNull() & F.col("ts_query").isNotNull()).select(F.col(scope).cast(kinds["s"]).alias("s"), F.unix_micros("ts_query").alias("us"), F.lit(1).alias("side"), *empty, "query_id")
    both = ev.withColumn("query_id", F.lit(None).cast(dict(asked.dtypes)["query_id"])).unionByName(asked)
    w = Window.partitionBy("s").orderBy("us", "side", *[f"o{i}" for i in range(len(order))]).rowsBetween(Window.unboundedPreceding, 0)
    numbered = cut(both.withColumn("k", F.sum(1 - F.col("side")).over(w)).select("s", "side", "k", F.col("us").alias("t"), "item_id", "query_id"))
    back = numbered.where("side = 1 AND k > 0").select("s", "query_id", F.posexplode(F.sequence("k", F.greatest(F.col("k") - last + 1, F.lit(1)), F.lit(-1).cast("long"))).alias("pos", "k"))
    return back.join(numbered.where("side = 0").select("s", "k", "t", "item_id"), ["s", "k"]).select("query_id", "item_id", "t", "pos")


def sequence_features(queries: DataFrame, log: DataFrame, max_len: int = 100, last_k: int = 20) -> DataFrame:
    """Of the last max_len events of each query's user up to ts_query (see history): seq_len, mean and sample deviation
    of the gaps in seconds, and the distinct items of the last last_k; gaps are 0 where there is none."""
    q = queries.select("query_id", "user_id", "ts_query")
    back = history(log, q, max_len).withColumn("k", F.col("pos") + 1)
    w = Window.partitionBy("query_id").orderBy("pos")
    gaps = back.withColumn("gap", (F.lag("t").over(w) - F.col("t")) / 1e6)
    out = gaps.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("seq_len"), F.round(F.coalesce(F.avg("gap"), F.lit(0.0)), 3).alias("gap_mean_s"),
        F.round(F.coalesce(F.stddev_samp("gap"), F.lit(0.0)), 3).alias("gap_std_s"), F.count_distinct(F.when(F.col("k") <= last_k, F.col("item_id"))).alias("last_items"),
    )
    return q.select("query_id").join(out, "query_id", "left").fillna(0)


def capped_sessions(df: DataFrame, actor: str, us: str, key: str, gap_us: int = 1_800_000_000, most: int = 200) -> DataFrame:
    """actor, no (the session, from 0), piece (from 0), start_us, n: sessions by gaps of over gap_us, cut after every
    `most` events in the order of time, then key."""
    w = Window.partitionBy(actor).orderBy(us, key)
    new = F.when(F.col(us) - F.lag(us).over(w) > gap_us, 1).otherwise(0)
    s = df.where(F.col(actor).isNotNull() & F.col(us).isNotNull()).withColumn("__new", new).withColumn("no", F.sum("__new").over(w))
    piece = F.floor((F.row_number().over(Window.partitionBy(actor, "no").orderBy(us, key)) - 1) / most)
    return s.withColumn("piece", piece).groupBy(actor, "no", "piece").agg(F.min(us).alias("start_us"), F.count(F.lit(1)).alias("n"))


def session_lengths(df: DataFrame, session: str) -> DataFrame:
    """sessions, p50, p90 and longest of the rows of each session that is not null."""
    n = df.where(F.col(session).isNotNull()).groupBy(session).agg(F.count(F.lit(1)).alias("n"))
    p50, p90 = quantiles(n, "n", [0.5, 0.9]) or (None, None)
    return n.agg(F.count(F.lit(1)).alias("sessions"), F.lit(p50).cast("double").alias("p50"), F.lit(p90).cast("double").alias("p90"), F.max("n").alias("longest"))


def coverage(df: DataFrame, ts: str, recent: Sequence[int] = (7, 30)) -> DataFrame:
    """span_days from first to last day, missing_days without a row, busiest day's rows, and recent_{d}, the share of rows
    in the d days up to the last."""
    x = df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    last = x.agg(F.max("day")).scalar()
    shares = [(F.sum(F.when(F.col("day") > F.date_sub(F.col("last"), d), F.col("n")).otherwise(0)) / F.sum("n")).alias(f"recent_{d}") for d in recent]
    s = x.withColumn("last", last).agg((F.datediff(F.max("day"), F.min("day")) + 1).cast("long").alias("span_days"), F.count(F.lit(1)).alias("days"), F.max("n").alias("busiest"), *shares)
    return s.select("span_days", (F.col("span_days") - F.col("days")).alias("missing_days"), "busiest", *[f"recent_{d}" for d in recent])


def date_parts(ts: Column) -> dict[str, Column]:
    """year to minute, weekday (0 Monday), day of year, ISO week, quarter, weekend, first and last day of a month, part of
    day (0 from midnight, by six hours), and sine and cosine of month, weekday and hour as turns of a circle."""
    hour, month, day = F.hour(ts), F.month(ts), F.weekday(ts)
    plain = {"year": F.year(ts), "month": month, "day": F.dayofmonth(ts), "hour": hour, "minute": F.minute(ts), "weekday": day, "day_of_year": F.dayofyear(ts), "week": F.weekofyear(ts), "quarter": F.quarter(ts)}
    flags = {"weekend": (day >= 5).cast("int"), "month_start": (F.dayofmonth(ts) == 1).cast("int"), "month_end": (F.last_day(ts) == F.to_date(ts)).cast("int"), "part_of_day": F.floor(hour / 6).cast("int")}
    turns = {"month": (month - 1, 12), "weekday": (day, 7), "hour": (hour, 24)}
    circle = {f"{k}_{n}": f(2 * F.pi() * x / size) for k, (x, size) in turns.items() for n, f in (("sin", F.sin), ("cos", F.cos))}
    return plain | flags | circle
