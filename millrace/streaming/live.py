"""The event operators over streams: session windows, daily and sliding counts, late copies, running counters."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.session import named_folder


def sessions(stream: DataFrame, actor: str, ts: str, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """actor, start, end (last event plus the gap), events; a pause of exactly the gap does not split."""
    s = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), actor).agg(F.count(F.lit(1)).alias("events"))
    return s.select(actor, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def windowed_counts(stream: DataFrame, key: str, ts: str, length: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """key, start, n of tumbling or (with slide) sliding windows. Rows later than `late` behind the latest moment are
    dropped once their window is closed; an append-mode sink gets a window when it closes, once."""
    s = stream.withWatermark(ts, late).groupBy(F.window(ts, length, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return s.select(key, F.col("w.start").alias("start"), "n")


def without_copies(stream: DataFrame, key: str, ts: str, late: str = "1 day") -> DataFrame:
    """The first of the rows of one key that come within `late` of each other; keys are forgotten after that."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def running_counters(stream: DataFrame, actor: str, ts: str, forget: str = "365 days") -> DataFrame:
    """actor, n: after each batch, the events of every actor in it so far. State is one number for each actor and goes
    when the watermark passes the actor's last event by `forget`; later events of the actor count from 1 again."""
    ms = int(pd.Timedelta(forget) / pd.Timedelta("1ms"))

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, last = state.get if state.exists else (0, 0)
        for b in batches:
            n += len(b)
            last = max(last, int(b["__ms"].max()))
        state.update((n, last))
        state.setTimeoutTimestamp(max(last + ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({actor: [key[0]], "n": [n]})

    kind = dict(stream.dtypes)[actor]
    timed = stream.where(F.col(ts).isNotNull()).withWatermark(ts, "0 seconds").withColumn("__ms", F.unix_millis(ts)).select(actor, ts, "__ms")
    return timed.groupBy(actor).applyInPandasWithState(step, f"{actor} {kind}, n long", "n long, last long", "update", GroupStateTimeout.EventTimeTimeout)


def run_available(spark: SparkSession, df: DataFrame, mode: str = "append", path: str | None = None) -> DataFrame:
    """Run a stream over what is there, write each batch's rows as parquet under a path (a new folder of the shared one
    by default) and read them: all batches, or the last one of a complete-mode stream. A batch that is run again
    after a failure replaces its files."""
    path = path or named_folder(spark, "stream")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    rows = spark.read.schema(T.StructType([*df.schema, T.StructField("batch", T.IntegerType())])).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    return (rows.where(F.col("batch") == rows.agg(F.max("batch")).scalar()) if mode == "complete" else rows).drop("batch")
