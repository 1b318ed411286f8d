"""Sessions separated by inactivity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gap_sessions(events: DataFrame, actor: str, micros: str, gap_us: int = 1_800_000_000) -> DataFrame:
    """`actor`, `session_no` (from 0), `start_us`, `end_us`, `duration_us`, `events` of each session of an actor.

    A new session starts only when more than gap_us pass without an event; a pause of exactly gap_us does not
    split. Rows with null actor or moment are left out. Every row is an event: repeated ones are to be removed
    before. Other columns are ignored; an empty table gives an empty result.

    Method: sweep line. +1 at the first moment of a piece, -1 at its last moment plus the gap, +1 first among
    equals; where the running sum returns to zero, the session closes. Pieces are the events of one actor in
    one slot of gap_us, always of one session, and are aggregated before the exchange: even an actor with a
    third of all rows brings at most two rows for each slot of the calendar to the window.
    """
    gap = F.lit(gap_us).cast("long")
    src = events.select(F.col(actor).alias("a"), F.col(micros).cast("long").alias("t")).where("a IS NOT NULL AND t IS NOT NULL")
    slot = (F.col("t") - F.pmod("t", gap)).alias("slot")
    pieces = src.groupBy("a", slot).agg(F.min("t").alias("s"), F.max("t").alias("e"), F.count(F.lit(1)).alias("n"))
    sweep = pieces.select(
        "a",
        F.explode(
            F.array(
                F.struct(F.col("s").alias("t"), F.lit(1).alias("step"), F.col("n").alias("n")),
                F.struct((F.col("e") + gap).alias("t"), F.lit(-1).alias("step"), F.lit(0).cast("long").alias("n")),
            )
        ).alias("x"),
    ).select("a", "x.*")
    w = Window.partitionBy("a").orderBy(F.col("t"), F.col("step").desc()).rowsBetween(Window.unboundedPreceding, 0)
    active = sweep.withColumn("active", F.sum("step").over(w))
    closes = F.when(F.col("active") == 0, 1).otherwise(0)
    numbered = active.withColumn("no", F.sum(closes).over(w) - closes)
    return (
        numbered.groupBy("a", "no")
        .agg(
            F.min("t").alias("start_us"),
            (F.max("t") - gap).alias("end_us"),
            F.sum("n").alias("events"),
        )
        .select(
            F.col("a").alias(actor),
            F.col("no").alias("session_no"),
            "start_us",
            "end_us",
            (F.col("end_us") - F.col("start_us")).alias("duration_us"),
            "events",
        )
    )
