"""Totals and averages over trailing periods, quiet days included."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import materialised

DAY_US = 86_400_000_000


def day_number(micros: Column) -> Column:
    """Days since 1970 of UTC microseconds."""
    return F.floor(micros / F.lit(DAY_US)).cast("int")


def trailing_totals(
    events: DataFrame, entity: str, day: str, actor: str, periods: Sequence[int] = (7, 30)
) -> DataFrame:
    """For each entity and each day from its first to its last event day, quiet days included: `events` of the
    day and, for each period p, `events_p` and `users_p` (distinct actors) of the p days that end that day, and
    the daily averages `avg_events_p` (events_p / p) and `avg_users_p` (mean of the p daily distinct actors).

    events: one row per event; `day` counts days since 1970. Days before an entity's first count as quiet, so
    averages always divide by p. Rows with null entity or day are left out; a null actor counts as an event but
    as no actor. Any other columns are ignored; an empty table gives an empty result.

    Method: aggregate daily, densify by a join of the entities with the calendar, then window sums over the p
    preceding rows, the day's own among them. The join meets by blocks of 32 days, so that an entity meets the days of
    its own span, not all; the calendar, a row for each day between the first and last event of all (of the years 1
    to 9999 under 3.7 million), is broadcast. Distinct actors of a period are no sum of daily ones: each actor adds
    +1 on a day with no own activity in the p days before, and -1 p days after the last one, and these are summed up
    to the day. A frequent entity is split by actor and day and summed before each exchange; the only windows by
    entity alone run over days, not events.
    """
    periods = sorted(periods)
    src = events.select(F.col(entity).alias("e"), F.col(day).cast("int").alias("d"), F.col(actor).cast("string").alias("a"))
    by_actor = src.where("e IS NOT NULL AND d IS NOT NULL").groupBy("e", "a", "d").agg(F.count(F.lit(1)).alias("n"))
    # rows without an actor are one group of an entity, of at most a row for each day
    w = Window.partitionBy("e", "a").orderBy("d")
    by_actor = by_actor.withColumns({"before": F.col("d") - F.lag("d").over(w), "after": F.lead("d").over(w) - F.col("d")})
    names = ["n", "u", *[f"u{p}" for p in periods]]
    known, gap_before, gap_after = F.col("a").isNotNull(), F.col("before"), F.col("after")

    def at(shift: int, **values: Column) -> Column:
        zero = F.lit(0).cast("long")
        return F.struct((F.col("d") + shift).alias("d"), *[values.get(c, zero).cast("long").alias(c) for c in names])

    enters = {f"u{p}": (known & (gap_before.isNull() | (gap_before >= p))).cast("long") for p in periods}
    deltas = [at(0, n=F.col("n"), u=known.cast("long"), **enters)]
    for p in periods:
        leaves = known & (gap_after.isNull() | (gap_after >= p))
        deltas.append(F.when(leaves, at(p, **{f"u{p}": F.lit(-1)})))
    daily = by_actor.select("e", F.explode(F.array_compact(F.array(*deltas))).alias("x")).select("e", "x.*").groupBy("e", "d")
    daily = materialised(daily.agg(*[F.sum(c).alias(c) for c in names]), "daily")

    spans = daily.where("n > 0").groupBy("e").agg(F.min("d").alias("first"), F.max("d").alias("last"))
    spark = events.sparkSession
    ends = daily.where("n > 0").agg(F.min("d").alias("a"), F.max("d").alias("b")).first()
    days = spark.range(ends.a or 0, (ends.b + 1) if ends.b is not None else 0)
    calendar = days.select(F.shiftright("id", 5).cast("int").alias("block"), F.col("id").cast("int").alias("d"))
    block = F.explode(F.sequence(F.shiftright("first", 5), F.shiftright("last", 5))).alias("block")
    own = spans.select("e", "first", "last", block).join(F.broadcast(calendar), "block").where("d >= first AND d <= last")
    zero = [F.lit(0).cast("long").alias(c) for c in names]
    both = own.select("e", "d", F.lit(True).alias("own"), *zero).unionAll(daily.select("e", "d", F.lit(False), *names))
    # days after the last event, where only actors leave, are not the entity's own
    dense = both.repartition("e").groupBy("e", "d").agg(F.max("own").alias("own"), *[F.sum(c).alias(c) for c in names]).where("own")

    by_day = Window.partitionBy("e").orderBy("d")
    out = [F.col("e").alias(entity), F.col("d").alias("day"), F.col("n").alias("events")]
    for p in periods:
        trailing = by_day.rowsBetween(1 - p, 0)
        events_p = F.sum("n").over(trailing)
        out += [
            events_p.alias(f"events_{p}"),
            F.sum(f"u{p}").over(by_day.rowsBetween(Window.unboundedPreceding, 0)).alias(f"users_{p}"),
            (events_p / F.lit(p)).alias(f"avg_events_{p}"),
            (F.sum("u").over(trailing) / F.lit(p)).alias(f"avg_users_{p}"),
        ]
    return dense.select(*out)
