"""Queries of the general training-data problems (1, 2, 5, 7) with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.timestamps import utc_micros
from millrace.operators.asof import attributes_as_known
from millrace.operators.rolling import day_number, trailing_totals
from millrace.operators.sessions import gap_sessions
from millrace.plans.moments import events, events_sql, moment_sql
from millrace.sources.tables import table

CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{6}Z\z"


def _trailing(spark: SparkSession, d: str) -> DataFrame:
    ev = events(spark, d, {"item_id": "item_id", "user_id": "user_id"}, F.col("item_id").isNotNull())
    days = ev.select("item_id", "user_id", day_number(F.col("utc_us")).alias("day"))
    totals = trailing_totals(days, "item_id", "day", "user_id")
    return totals.withColumn("day_utc", F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd")).drop("day")


def p1_rolling(spark: SparkSession, d: str) -> DataFrame:
    return _trailing(spark, d)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    # the first and last day of an item always have events, so a quiet day lies strictly between them
    quiet = _trailing(spark, d).where("events = 0 AND events_7 >= 4 AND 30 * events_7 >= 14 * events_30 AND users_7 >= 3")
    return quiet.select("item_id", "day_utc")


def _moments(spark: SparkSession, d: str) -> DataFrame:
    def of(name: str, key: str) -> DataFrame:
        return table(spark, d, name).select(F.lit(name).alias("src"), F.col(key).cast("string").alias("rec_id"), "ts", "tz")

    rows = of("tiny_interactions", "event_id").unionAll(of("tiny_queries", "query_id"))
    return rows.withColumn("utc_us", utc_micros("ts", "tz"))


def p2_normalized(spark: SparkSession, d: str) -> DataFrame:
    return _moments(spark, d)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = _moments(spark, d).where(
        F.col("rec_id").isNotNull() & ~F.col("ts").rlike(CANONICAL) & F.col("utc_us").isNotNull()
    )
    return found.select("src", "rec_id", "utc_us").distinct()


def _cases(spark: SparkSession, d: str) -> DataFrame:
    pairs = (
        table(spark, d, "tiny_pairs_train")
        .where("ts_query IS NOT NULL AND query_id IS NOT NULL AND item_id IS NOT NULL")
        .select(F.lit("pair").alias("src"), F.col("query_id").alias("rec_id"), "item_id", F.unix_micros("ts_query").alias("utc_us"))
        .distinct()
    )
    bought = (F.col("event") == "purchase") & F.col("item_id").isNotNull()
    purchases = events(spark, d, {"item_id": "item_id"}, bought)
    return pairs.unionAll(
        purchases.select(F.lit("event").alias("src"), F.col("event_id").cast("string").alias("rec_id"), "item_id", "utc_us")
    )


def _known(spark: SparkSession, d: str) -> DataFrame:
    history = table(spark, d, "item_history").select(
        "item_id", "version_id", "price", "category", F.unix_micros("valid_from").alias("valid_from"), F.unix_micros("known_at").alias("known_at")
    )
    return attributes_as_known(
        _cases(spark, d), history, entity="item_id", moment="utc_us", keep=["src", "rec_id", "utc_us"], valid_from="valid_from",
        known_at="known_at", version_id="version_id", attributes=["price", "category"],
        hot_counts=table(spark, d, "tiny_interactions").where("event = 'purchase'").select("item_id").unionAll(table(spark, d, "tiny_pairs_train").select("item_id")),
    )


def p5_asof(spark: SparkSession, d: str) -> DataFrame:
    return _known(spark, d).select("src", "rec_id", "item_id", "utc_us", "version_id", "price", "category")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _known(spark, d).where("version_id IS NOT NULL").select("src", "rec_id", "item_id", "version_id").distinct()


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return gap_sessions(events(spark, d, {"user_id": "user_id"}, F.col("user_id").isNotNull()), "user_id", "utc_us")


def p7_sessions(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).drop("session_no")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _sessions(spark, d).where("events >= 2").select("user_id", "start_us", "end_us")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_rolling, p2_found, p2_normalized, p5_found, p5_asof, p7_found, p7_sessions)}


_DAYS = f"""WITH {events_sql("item_id, user_id")},
 e AS (SELECT item_id, user_id, CAST(floor(utc_us / 86400000000) AS INT) AS day FROM ev WHERE item_id IS NOT NULL),
 c AS (SELECT item_id, unnest(generate_series(min(day), max(day))) AS day FROM e GROUP BY item_id),
 du AS (SELECT item_id, day, count(*) AS n, count(DISTINCT user_id) AS u FROM e GROUP BY ALL),
 s AS (SELECT c.item_id, c.day, coalesce(sum(n) FILTER (du.day = c.day), 0)::BIGINT AS events,
   coalesce(sum(n) FILTER (du.day > c.day - 7), 0)::BIGINT AS events_7, coalesce(sum(n), 0)::BIGINT AS events_30,
   coalesce(sum(u) FILTER (du.day > c.day - 7), 0)::BIGINT AS s7, coalesce(sum(u), 0)::BIGINT AS s30
   FROM c LEFT JOIN du ON du.item_id = c.item_id AND du.day BETWEEN c.day - 29 AND c.day GROUP BY ALL),
 x AS (SELECT c.item_id, c.day, count(DISTINCT user_id) FILTER (e.day > c.day - 7)::BIGINT AS users_7, count(DISTINCT user_id)::BIGINT AS users_30
   FROM c LEFT JOIN e ON e.item_id = c.item_id AND e.day BETWEEN c.day - 29 AND c.day GROUP BY ALL),
 r AS (SELECT s.*, x.users_7, x.users_30 FROM s JOIN x USING (item_id, day))"""
_DAY = "strftime(DATE '1970-01-01' + CAST(day AS INT), '%Y-%m-%d') AS day_utc"
_CASES = f"""WITH {events_sql("item_id, event")},
 cases AS (SELECT DISTINCT 'pair' AS src, query_id AS rec_id, item_id, epoch_us(ts_query) AS utc_us FROM tiny_pairs_train
   WHERE ts_query IS NOT NULL AND query_id IS NOT NULL AND item_id IS NOT NULL
   UNION ALL SELECT 'event', CAST(event_id AS VARCHAR), item_id, utc_us FROM ev WHERE event = 'purchase' AND item_id IS NOT NULL),
 j AS (SELECT c.*, h.version_id, h.price, h.category, row_number() OVER (PARTITION BY c.src, c.rec_id, c.item_id, c.utc_us
     ORDER BY h.valid_from DESC, h.known_at DESC, h.version_id DESC) AS k
   FROM cases c LEFT JOIN item_history h ON h.item_id = c.item_id AND epoch_us(h.valid_from) <= c.utc_us AND epoch_us(h.known_at) <= c.utc_us)"""
_BOTH = f"""WITH a AS ({moment_sql("tiny_interactions", "'tiny_interactions' AS src, CAST(event_id AS VARCHAR) AS rec_id, ts, tz")}),
 b AS ({moment_sql("tiny_queries", "'tiny_queries' AS src, query_id AS rec_id, ts, tz")}),
 m AS (SELECT * FROM a UNION ALL SELECT * FROM b)"""
_GAPS = f"""WITH {events_sql("user_id")},
 l AS (SELECT *, CASE WHEN utc_us - lag(utc_us) OVER w > 1800000000 THEN 1 ELSE 0 END AS new FROM ev WHERE user_id IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY utc_us, event_id)),
 n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY utc_us, event_id) AS no FROM l),
 s AS (SELECT user_id, min(utc_us) AS start_us, max(utc_us) AS end_us, max(utc_us) - min(utc_us) AS duration_us, count(*) AS events FROM n GROUP BY user_id, no)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_rolling": f"{_DAYS} SELECT item_id, events, events_7, users_7, events_7 / 7 AS avg_events_7, s7 / 7 AS avg_users_7, events_30, users_30, events_30 / 30 AS avg_events_30, s30 / 30 AS avg_users_30, {_DAY} FROM r",
        "p1_found": f"{_DAYS} SELECT item_id, {_DAY} FROM r WHERE events = 0 AND events_7 >= 4 AND 30 * events_7 >= 14 * events_30 AND users_7 >= 3",
        "p2_normalized": f"{_BOTH} SELECT src, rec_id, ts, tz, utc_us FROM m",
        "p2_found": rf"{_BOTH} SELECT DISTINCT src, rec_id, utc_us FROM m WHERE rec_id IS NOT NULL AND utc_us IS NOT NULL AND NOT regexp_full_match(ts, '\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{{6}}Z')",
        "p5_asof": f"{_CASES} SELECT src, rec_id, item_id, utc_us, version_id, price, category FROM j WHERE k = 1",
        "p5_found": f"{_CASES} SELECT DISTINCT src, rec_id, item_id, version_id FROM j WHERE k = 1 AND version_id IS NOT NULL",
        "p7_sessions": f"{_GAPS} SELECT * FROM s",
        "p7_found": f"{_GAPS} SELECT user_id, start_us, end_us FROM s WHERE events >= 2",
    }
