"""Reading, adapting and writing tables: name maps, required columns, moments, copies, cutoffs, sinks."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.tables import table


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet, CSV with header, JSON lines or ORC, by the ending of the path; another ending is an error."""
    kind = PurePosixPath(path).suffix.lstrip(".").lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if kind == "csv":
        return reader.option("header", True).option("inferSchema", schema is None).csv(path)
    if kind in ("parquet", "orc"):
        return reader.format(kind).load(path)
    if kind in ("jsonl", "json"):
        return reader.json(path)
    raise ValueError(f"cannot read {path}: unknown ending {kind!r}")


def renamed(df: DataFrame, canonical: Mapping[str, str]) -> DataFrame:
    """Rename source columns to canonical ones, given canonical -> source; only those that exist."""
    return df.withColumnsRenamed({s: c for c, s in canonical.items() if s in df.columns})


def required(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def epoch_or_text(column: Column, kind: T.DataType) -> Column:
    """UTC timestamp of a column: numbers under 1e11 are seconds since 1970, others milliseconds; texts are parsed."""
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return column.cast("timestamp")
    if isinstance(kind, T.NumericType):
        n = column.cast("double")
        return F.when(F.abs(n) < 1e11, F.timestamp_micros((n * 1e6).cast("long"))).otherwise(F.timestamp_micros((n * 1e3).cast("long")))
    return F.try_to_timestamp(column)


def adapt_interactions(df: DataFrame, canonical: Mapping[str, str], cutoff: str | None = None) -> DataFrame:
    """Canonical names, required columns, UTC moments, whole-row copies removed, rows up to the cutoff."""
    df = required(renamed(df, canonical), ["user_id", "item_id", "ts"])
    df = df.withColumn("ts", epoch_or_text(F.col("ts"), df.schema["ts"].dataType)).dropDuplicates()
    return df if cutoff is None else df.where(F.col("ts") <= F.lit(cutoff).cast("timestamp"))


def write_ranked_lists(df: DataFrame, path: str, query: str, item: str, rank: str, fmt: str = "json") -> None:
    """One line for each query with its items in order: JSON lines, or CSV with a space-separated list."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(rank, item))), lambda x: x[item])
    lists = df.groupBy(query).agg(items.alias("items"))
    if fmt == "csv":
        lists.select(query, F.concat_ws(" ", F.transform("items", lambda x: x.cast("string"))).alias("items")).write.mode("overwrite").option("header", True).csv(path)
    else:
        lists.write.mode("overwrite").json(path)


def write_feature_set(df: DataFrame, path: str, keys: Sequence[str], meta: Mapping[str, object] | None = None) -> None:
    """A feature matrix as parquet with its columns and notes beside it."""
    required(df, keys).write.mode("overwrite").parquet(f"{path}/matrix.parquet")
    notes = {"columns": df.columns, "keys": list(keys), "meta": dict(meta or {})}
    df.sparkSession.createDataFrame([(json.dumps(notes, sort_keys=True),)], "notes string").coalesce(1).write.mode("overwrite").text(f"{path}/columns.json")


def interactions(spark: SparkSession, d: str) -> DataFrame:
    """The order lines as an event log: user_id, item_id, session_id, ts, weight, event, line."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("timestamp").alias("ts"))
    lines = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("weight"), F.col("l_returnflag").alias("event"), F.col("l_linenumber").alias("line")
    )
    return lines.join(orders, "session_id").select("user_id", "item_id", "session_id", "ts", "weight", "event", "line")


INTER = """inter AS (SELECT o_custkey AS user_id, l_partkey AS item_id, o_orderkey AS session_id, CAST(o_orderdate AS TIMESTAMP) AS ts,
 l_quantity AS weight, l_returnflag AS event, l_linenumber AS line FROM orders JOIN lineitem ON l_orderkey = o_orderkey)"""


def clicks(spark: SparkSession, d: str) -> DataFrame:
    """The event stream: event_id, user_id, ts, us, event, value, item_id (from the JSON props)."""
    ev = table(spark, d, "events")
    return ev.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("event_type").alias("event"), "value", F.get_json_object("props", "$.k").cast("long").alias("item_id"))


CLICKS = """clicks AS (SELECT event_id, user_id, CAST(ts AS TIMESTAMP) AS ts, epoch_us(ts) AS us, event_type AS event, value,
 CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id FROM events)"""
