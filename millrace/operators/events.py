"""Events with one moment, each counted once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.timestamps import utc_micros


def distinct_events(
    df: DataFrame, key: str, columns: dict[str, Column | str], *, ts: Column | str, tz: Column | str | None = None
) -> DataFrame:
    """One row for each key: `key`, the columns asked for, and `utc_us`, the moment.

    Rows with null key or an unreadable ts are left out. Rows of one key are copies of one event; should they
    disagree, the least (moment, columns...) in that order holds, so that the result is the same on any
    partitioning. Other columns of df, whatever their names, play no part. Exchanges only the columns asked for.
    """
    picked = df.select(
        F.col(key).alias("k"),
        utc_micros(ts, tz).alias("t"),
        *[(F.col(c) if isinstance(c, str) else c).alias(f"c{i}") for i, c in enumerate(columns.values())],
    )
    row = F.struct("t", *[f"c{i}" for i in range(len(columns))])
    one = picked.where("k IS NOT NULL AND t IS NOT NULL").groupBy("k").agg(F.min(row).alias("r"))
    return one.select(
        F.col("k").alias(key),
        *[F.col(f"r.c{i}").alias(name) for i, name in enumerate(columns)],
        F.col("r.t").alias("utc_us"),
    )
