"""Queries over event logs in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import timeline as T
from millrace.plans.registry import Registry
from millrace.sources.frames import CLICKS, INTER, adapt_interactions, clicks, interactions
from millrace.sources.tables import table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
DAY = T.DAY_US
CUT = "TIMESTAMP '1999-01-01'"


@R.add(f"WITH {CLICKS} SELECT DISTINCT user_id, item_id, event, us FROM clicks WHERE ts <= TIMESTAMP '2024-01-20'")
def a2_adapt(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "events").select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("ts").alias("at"), "event_type")
    df = adapt_interactions(raw, {"item_id": "k", "ts": "at", "event": "event_type"}, "2024-01-20")
    return df.select("user_id", "item_id", "event", F.unix_micros("ts").alias("us"))


@R.add(f"WITH {CLICKS} SELECT user_id, epoch_us(max(ts)) AS ts_query FROM clicks GROUP BY user_id")
def d1_queries(spark: SparkSession, d: str) -> DataFrame:
    return T.latest(clicks(spark, d), "user_id").select("user_id", F.unix_micros("ts_query").alias("ts_query"))


@R.add(f"WITH {CLICKS}, x AS (SELECT CASE WHEN us >= epoch_us(TIMESTAMP '2024-01-24') + 86400000000 THEN 'test' WHEN us >= epoch_us(TIMESTAMP '2024-01-18') + 86400000000 AND us <= epoch_us(TIMESTAMP '2024-01-24') THEN 'val' WHEN us <= epoch_us(TIMESTAMP '2024-01-18') THEN 'train' END AS split FROM clicks) SELECT split, count(*) AS n FROM x GROUP BY split")
def e18_time_split(spark: SparkSession, d: str) -> DataFrame:
    at = lambda x: F.lit(x).cast("timestamp")
    return clicks(spark, d).groupBy(T.time_split(F.col("ts"), at("2024-01-18"), at("2024-01-24"), DAY).alias("split")).agg(F.count(F.lit(1)).alias("n"))


@R.add("WITH f AS (SELECT c_custkey, CAST(('0x' || substr(md5(CAST(c_custkey AS VARCHAR) || '#0'), 1, 7))::BIGINT % 5 AS INT) AS fold FROM customer) SELECT * FROM f")
def e22_group_folds(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", T.hashed_fold(F.col("c_custkey"), 5).alias("fold"))


@R.add("SELECT c_custkey, CAST((row_number() OVER (PARTITION BY c_mktsegment ORDER BY substr(md5(CAST(c_custkey AS VARCHAR) || '#0'), 1, 2), md5(CAST(c_custkey AS VARCHAR) || '#0'), c_custkey) - 1) % 5 AS INT) AS fold FROM customer")
def e22_stratified_folds(spark: SparkSession, d: str) -> DataFrame:
    return T.stratified_fold(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 5).select("c_custkey", "fold")


@R.add(f"WITH {CLICKS}, b AS (SELECT quantile_cont(us, [0.2, 0.4, 0.6, 0.8]) AS q FROM clicks) SELECT event_id, CAST(len(list_filter(q, lambda x: x <= us)) AS INT) AS fold FROM clicks, b")
def e22_time_folds(spark: SparkSession, d: str) -> DataFrame:
    return T.time_blocks(clicks(spark, d), "us", 5).select("event_id", "fold")


@R.add(f"WITH {CLICKS}, l AS (SELECT *, CASE WHEN us - lag(us) OVER w > 1800000000 THEN 1 ELSE 0 END AS new FROM clicks WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS no FROM l), k AS (SELECT *, (row_number() OVER (PARTITION BY user_id, no ORDER BY us, event_id) - 1) // 5 AS piece FROM s) SELECT user_id, CAST(no AS BIGINT) AS no, CAST(piece AS BIGINT) AS piece, min(us) AS start_us, count(*) AS n FROM k GROUP BY ALL")
def e2_capped_sessions(spark: SparkSession, d: str) -> DataFrame:
    return T.capped_sessions(clicks(spark, d), "user_id", "us", "event_id", most=5)


@R.add(f"WITH {INTER}, n AS (SELECT session_id, count(*) AS n FROM inter GROUP BY 1) SELECT count(*) AS sessions, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, max(n) AS longest FROM n")
def d22_session_lengths(spark: SparkSession, d: str) -> DataFrame:
    return T.session_lengths(interactions(spark, d), "session_id")


@R.add(f"WITH {CLICKS} SELECT event_id, lag(value, 1) OVER w AS value_lag1, lag(value, 7) OVER w AS value_lag7 FROM clicks WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)")
def e3_lags(spark: SparkSession, d: str) -> DataFrame:
    return T.lags(clicks(spark, d), "user_id", ["us", "event_id"], "value", [1, 7]).select("event_id", "value_lag1", "value_lag7")


@R.add(f"WITH {CLICKS} SELECT event_id, round(avg(value) OVER w, 6) AS mean, round(stddev_samp(value) OVER w, 6) AS std, min(value) OVER w AS low, max(value) OVER w AS high, round(sum(value) OVER w, 6) AS total FROM clicks WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)")
def e4_last_rows(spark: SparkSession, d: str) -> DataFrame:
    df = T.trailing_rows(clicks(spark, d), "user_id", ["us", "event_id"], "value", 7, ["mean", "std", "min", "max", "sum"])
    c = lambda s: F.col(f"value_{s}_last7")
    return df.select("event_id", F.round(c("mean"), 6).alias("mean"), F.round(c("std"), 6).alias("std"), c("min").alias("low"), c("max").alias("high"), F.round(c("sum"), 6).alias("total"))


@R.add(f"WITH {CLICKS} SELECT event_id, round(avg(value) OVER w, 6) AS mean, round(sum(value) OVER w, 6) AS total FROM clicks WINDOW w AS (PARTITION BY user_id ORDER BY us RANGE BETWEEN 604800000000 PRECEDING AND 1 PRECEDING)")
def e5_last_7_days(spark: SparkSession, d: str) -> DataFrame:
    df = T.trailing_time(clicks(spark, d), "user_id", "us", "value", 7 * DAY, ["mean", "sum"], "7d")
    return df.select("event_id", F.round("value_mean_7d", 6).alias("mean"), F.round("value_sum_7d", 6).alias("total"))


@R.add(f"WITH RECURSIVE {CLICKS}, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS k FROM clicks), r AS (SELECT event_id, user_id, k, value AS e FROM o WHERE k = 1 UNION ALL SELECT o.event_id, o.user_id, o.k, CAST(2 AS DOUBLE) / 7 * o.value + CAST(5 AS DOUBLE) / 7 * r.e FROM r JOIN o ON o.user_id = r.user_id AND o.k = r.k + 1) SELECT event_id, round(e, 6) AS ewm FROM r")
def e6_ewm(spark: SparkSession, d: str) -> DataFrame:
    # alpha 2 / 7 is no finite decimal: no mean lies on the bound of two rounded values
    return T.ewm_mean(clicks(spark, d), "user_id", ["us", "event_id"], "value", 6).select("event_id", F.round("ewm", 6).alias("ewm"))


@R.add(f"WITH {CLICKS}, a AS (SELECT event_id, user_id, us FROM clicks WHERE event = 'purchase'), b AS (SELECT user_id, us, max(value) AS value FROM clicks WHERE event = 'view' GROUP BY ALL) SELECT a.event_id, b.value AS value_asof FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.us >= b.us")
def c8_asof(spark: SparkSession, d: str) -> DataFrame:
    c = clicks(spark, d)
    out = T.asof_join(c.where("event = 'purchase'").select("event_id", "user_id", "us"), c.where("event = 'view'").select("user_id", "us", "value"), "user_id", "us", ["value"])
    return out.select("event_id", "value_asof")


@R.add(f"WITH {INTER}, n AS (SELECT item_id, CAST(ts AS DATE) AS day, count(*) AS n FROM inter GROUP BY ALL) SELECT item_id, strftime(day, '%Y-%m-%d') AS day, n, CAST(sum(n) OVER (PARTITION BY item_id ORDER BY day) AS BIGINT) AS cum FROM n")
def d12_daily_cumulative(spark: SparkSession, d: str) -> DataFrame:
    return T.daily_cumulative(interactions(spark, d), "item_id").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@R.add(f"WITH {INTER}, q AS (SELECT DISTINCT session_id, item_id, CAST(ts AS DATE) AS day FROM inter), n AS (SELECT item_id, CAST(ts AS DATE) AS day, count(*) AS n FROM inter GROUP BY ALL) SELECT q.session_id, q.item_id, coalesce(sum(n.n) FILTER (n.day >= q.day - 30), 0)::BIGINT AS n_30d, coalesce(sum(n.n), 0)::BIGINT AS n_90d FROM q LEFT JOIN n ON n.item_id = q.item_id AND n.day < q.day AND n.day >= q.day - 90 GROUP BY ALL")
def c9_counts_before(spark: SparkSession, d: str) -> DataFrame:
    i = interactions(spark, d)
    q = i.select("session_id", "item_id", F.to_date("ts").alias("day")).distinct()
    return T.counts_before(q, i, "item_id", "day", [30, 90]).select("session_id", "item_id", "n_30d", "n_90d")


_PAIRS = f"""WITH {INTER}, last AS (SELECT user_id, max(ts) AS ts_query FROM inter WHERE ts <= {CUT} GROUP BY 1),
 p AS (SELECT DISTINCT l.user_id AS query_id, l.user_id, i.item_id, l.ts_query FROM last l JOIN inter i ON i.user_id = l.user_id AND i.ts >= l.ts_query),
 u AS (SELECT p.query_id, p.item_id, round((epoch_us(p.ts_query) - epoch_us(max(i.ts))) / 3.6e9, 6) AS recency_user_h, max(CASE WHEN i.item_id = p.item_id THEN 1 ELSE 0 END) AS seen_before,
  count(*) FILTER (i.ts >= p.ts_query - INTERVAL 30 DAY) AS user_count_30d, count(*) FILTER (i.ts >= p.ts_query - INTERVAL 365 DAY) AS user_count_365d,
  count(DISTINCT i.item_id) FILTER (i.ts >= p.ts_query - INTERVAL 30 DAY) AS user_items_30d, count(DISTINCT i.item_id) FILTER (i.ts >= p.ts_query - INTERVAL 365 DAY) AS user_items_365d
  FROM p JOIN inter i ON i.user_id = p.user_id AND i.ts <= p.ts_query GROUP BY p.query_id, p.item_id, p.ts_query),
 t AS (SELECT p.query_id, p.item_id, round((epoch_us(p.ts_query) - epoch_us(max(i.ts))) / 3.6e9, 6) AS recency_item_h, count(*) FILTER (i.ts >= p.ts_query - INTERVAL 30 DAY) AS item_count_30d,
  count(*) FILTER (i.ts >= p.ts_query - INTERVAL 365 DAY) AS item_count_365d FROM p JOIN inter i ON i.item_id = p.item_id AND i.ts <= p.ts_query GROUP BY p.query_id, p.item_id, p.ts_query)"""


@R.add(f"{_PAIRS} SELECT p.query_id, p.user_id, p.item_id, recency_user_h, coalesce(seen_before, 0) AS seen_before, coalesce(user_count_30d, 0) AS user_count_30d, coalesce(user_count_365d, 0) AS user_count_365d, coalesce(user_items_30d, 0) AS user_items_30d, coalesce(user_items_365d, 0) AS user_items_365d, recency_item_h, coalesce(item_count_30d, 0) AS item_count_30d, coalesce(item_count_365d, 0) AS item_count_365d FROM p LEFT JOIN u USING (query_id, item_id) LEFT JOIN t USING (query_id, item_id)")
def r1_pair_features(spark: SparkSession, d: str) -> DataFrame:
    i = interactions(spark, d)
    last = T.latest(i.where(f"ts <= {CUT}"), "user_id")
    p = last.join(i, "user_id").where("ts >= ts_query").select(F.col("user_id").alias("query_id"), "user_id", "item_id", "ts_query")
    return T.pair_features(p, i, [30, 365])


@R.add(f"WITH {INTER}, q AS (SELECT user_id AS query_id, user_id, max(ts) AS q FROM inter WHERE ts <= {CUT} GROUP BY ALL), b AS (SELECT q.query_id, i.item_id, i.ts, row_number() OVER w AS k, (epoch_us(lag(i.ts) OVER w) - epoch_us(i.ts)) / 1e6 AS gap FROM q JOIN inter i ON i.user_id = q.user_id AND i.ts <= q.q WINDOW w AS (PARTITION BY q.query_id ORDER BY i.ts DESC, i.line DESC, i.item_id DESC)) SELECT query_id, count(*) AS seq_len, round(coalesce(avg(gap), 0), 3) AS gap_mean_s, round(coalesce(stddev_samp(gap), 0), 3) AS gap_std_s, count(DISTINCT item_id) FILTER (k <= 20) AS last_items FROM b WHERE k <= 100 GROUP BY query_id")
def r4_sequence(spark: SparkSession, d: str) -> DataFrame:
    i = interactions(spark, d)
    q = T.latest(i.where(f"ts <= {CUT}"), "user_id").select(F.col("user_id").alias("query_id"), "user_id", "ts_query")
    return T.sequence_features(q, i)


@R.add(f"WITH {CLICKS}, x AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM clicks GROUP BY 1), c AS (SELECT unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM x) SELECT (SELECT count(*) FROM c) AS span_days, (SELECT count(*) FROM c ANTI JOIN x USING (day)) AS missing_days, (SELECT max(n) FROM x) AS busiest, (SELECT round(sum(n) FILTER (day > (SELECT max(day) FROM x) - 7) / sum(n), 9) FROM x) AS recent_7")
def e21_coverage(spark: SparkSession, d: str) -> DataFrame:
    return T.coverage(clicks(spark, d), "ts", [7]).withColumn("recent_7", F.round("recent_7", 9))


_PARTS = "year(ts) AS year, month(ts) AS month, day(ts) AS day, hour(ts) AS hour, minute(ts) AS minute, isodow(ts) - 1 AS weekday, dayofyear(ts) AS day_of_year, week(ts) AS week, quarter(ts) AS quarter"
_TURNS = ", ".join(f"round({f}(2 * pi() * {x} / {n}), 6) AS {k}_{f}" for k, x, n in (("month", "(month(ts) - 1)", 12), ("weekday", "(isodow(ts) - 1)", 7), ("hour", "hour(ts)", 24)) for f in ("sin", "cos"))


@R.add(f"WITH {CLICKS} SELECT event_id, {_PARTS}, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS weekend, CASE WHEN day(ts) = 1 THEN 1 ELSE 0 END AS month_start, CASE WHEN last_day(ts) = CAST(ts AS DATE) THEN 1 ELSE 0 END AS month_end, CAST(hour(ts) // 6 AS INT) AS part_of_day, {_TURNS} FROM clicks")
def h11_date_parts(spark: SparkSession, d: str) -> DataFrame:
    parts = T.date_parts(F.col("ts"))
    whole = ["year", "month", "day", "hour", "minute", "weekday", "day_of_year", "week", "quarter"]
    return clicks(spark, d).select("event_id", *[F.round(c, 6).alias(k) if k.endswith(("_sin", "_cos")) else c.cast("long").alias(k) if k in whole else c.alias(k) for k, c in parts.items()])
