"""Attributes as they were known at the time of an event."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOT_ENTITIES = 4096


def attributes_as_known(
    events: DataFrame,
    versions: DataFrame,
    *,
    entity: str,
    moment: str,
    keep: Sequence[str],
    valid_from: str,
    known_at: str,
    version_id: str,
    attributes: Sequence[str] = (),
    hot_counts: DataFrame | None = None,
    slice_us: int = 86_400_000_000,
    hot_rows: int = 200_000,
) -> DataFrame:
    """`keep` columns and entity of every event with the version in force and already known at its moment:
    of the versions whose valid_from and known_at are both not after the moment, the one of the latest
    valid_from, then latest known_at, then largest version_id. Adds version_id and the attributes, all null
    where no version qualifies. Moments are microseconds.

    Events with null entity or moment keep their row, with nulls. Versions with null entity, valid_from or
    known_at are never used; a null version_id loses against any other. Exact copies of versions change
    nothing; copies of events stay. Columns of the two tables may share names: only those named are read.

    Method: events and versions are united and sorted by entity and availability, the later of valid_from and
    known_at, versions before events at one moment, and the last known version by the rule above is carried
    forward. Entities of more than hot_rows rows (counted in `hot_counts`, a table with the entity column whose
    rows outnumber the events'; default: the events) are cut in slices of slice_us, each beginning with the
    version carried in. At most HOT_ENTITIES entities can have more than 1/HOT_ENTITIES of all rows, the least
    share of a hot one, so that the table of hot entities has a proven bound and is broadcast.
    """
    attrs = [f"x{i}" for i in range(len(attributes))]
    order = F.struct(
        F.col(valid_from).cast("long").alias("vf"),
        F.col(known_at).cast("long").alias("ka"),
        F.col(version_id).alias("id"),
        *[F.col(c).alias(a) for c, a in zip(attributes, attrs)],
    )
    v = versions.select(F.col(entity).alias("e"), order.alias("v")).where("e IS NOT NULL AND v.vf IS NOT NULL AND v.ka IS NOT NULL")
    v = v.withColumn("t", F.greatest("v.vf", "v.ka"))
    counted = (events if hot_counts is None else hot_counts).select(F.col(entity).alias("e")).where("e IS NOT NULL")
    counts = counted.unionAll(v.select("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n"))
    least = F.greatest(F.lit(hot_rows), counts.agg((F.sum("n") / HOT_ENTITIES).cast("long")).scalar())
    hot = counts.where(F.col("n") > least).select("e", F.lit(True).alias("hot"))

    cut = F.when(F.col("hot"), F.expr(f"t - pmod(t, {int(slice_us)}L)"))
    ev = events.select(F.col(entity).alias("e"), F.col(moment).cast("long").alias("t"), F.struct(*keep).alias("k"))
    ev = ev.join(F.broadcast(hot), "e", "left").withColumn("s", cut)
    v = v.join(F.broadcast(hot), "e", "left").withColumn("s", cut)
    # Of hot entities: the best version up to each slice, carried to the slices after it, one row for each up to
    # the last slice with a version; later slices take the entity's final version from the broadcast table.
    per_slice = v.where("hot").groupBy("e", "s").agg(F.max("v").alias("v"))
    w = Window.partitionBy("e").orderBy("s")
    best = per_slice.select("e", "s", F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("v"), F.lead("s").over(w).alias("next"))
    step = int(slice_us)
    carried = best.where("next IS NOT NULL").select("e", F.explode(F.expr(f"sequence(s + {step}L, next, {step}L)")).alias("s"), "v")
    final = best.where("next IS NULL").select("e", F.col("s").alias("last"), F.col("v").alias("final"))
    none = F.lit(None)
    vtype = v.schema["v"].dataType
    ktype = ev.schema["k"].dataType
    united = (
        ev.where("e IS NOT NULL AND t IS NOT NULL")
        .select("e", "s", "t", F.lit(1).alias("side"), "k", none.cast(vtype).alias("v"))
        .unionAll(v.select("e", "s", "t", F.lit(0).alias("side"), none.cast(ktype).alias("k"), "v"))
        .unionAll(carried.select("e", "s", F.col("s").alias("t"), F.lit(-1).alias("side"), none.cast(ktype).alias("k"), "v"))
    )
    w = Window.partitionBy("e", "s").orderBy("t", "side").rowsBetween(Window.unboundedPreceding, 0)
    known = united.withColumn("v", F.max("v").over(w)).where("side = 1")
    known = known.join(F.broadcast(final), "e", "left").withColumn(
        "v", F.coalesce("v", F.when(F.col("s") > F.col("last"), F.col("final")))
    )
    lost = ev.where("e IS NULL OR t IS NULL").select("e", "k", none.cast(vtype).alias("v"))
    return (
        known.select("e", "k", "v")
        .unionAll(lost)
        .select(
            F.col("e").alias(entity),
            "k.*",
            F.col("v.id").alias(version_id),
            *[F.col(f"v.{a}").alias(c) for c, a in zip(attributes, attrs)],
        )
    )
