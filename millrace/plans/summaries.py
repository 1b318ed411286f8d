"""Queries of reports and small derived columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import candidates as C
from millrace.operators import summaries as U
from millrace.operators import timeline as T
from millrace.plans.blends import _S, scores
from millrace.plans.features import r6
from millrace.plans.recommend import _MERGE, _merged, _truth
from millrace.plans.registry import Registry
from millrace.sources import sets
from millrace.sources.frames import CLICKS, clicks, interactions
from millrace.sources.tables import table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


@R.add(f"WITH {CLICKS}, x AS (SELECT CASE WHEN us <= epoch_us(TIMESTAMP '2024-01-18') THEN 'train' WHEN us <= epoch_us(TIMESTAMP '2024-01-24') THEN 'val' ELSE 'test' END AS split FROM clicks) SELECT split, count(*) AS n, round(count(*) / (SELECT count(*) FROM x), 9) AS share FROM x GROUP BY 1")
def d5_split_report(spark: SparkSession, d: str) -> DataFrame:
    at = lambda x: F.lit(x).cast("timestamp")
    x = clicks(spark, d).withColumn("split", T.time_split(F.col("ts"), at("2024-01-18"), at("2024-01-24")))
    return r6(U.split_report(x, "split"), "share", digits=9)


@R.add("WITH b AS (SELECT query_id, item_id, max(score) AS score FROM tiny_predictions WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM b) SELECT query_id, string_agg(item_id, ' ' ORDER BY rank) AS items FROM k WHERE rank <= 5 GROUP BY 1")
def d10_query_lists(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "tiny_predictions").where("score IS NOT NULL AND NOT isnan(score)").groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    k = F.row_number().over(T.Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id"))
    return U.query_lists(p.withColumn("rank", k), "query_id", "item_id", "rank", 5).select("query_id", F.concat_ws(" ", "items").alias("items"))


@R.add("SELECT 'user_id' AS feature, count(DISTINCT user_id) AS distinct FROM tiny_interactions UNION ALL SELECT 'item_id', count(DISTINCT item_id) FROM tiny_interactions UNION ALL SELECT 'event', count(DISTINCT event) FROM tiny_interactions")
def d11_distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return U.distinct_counts(table(spark, d, "tiny_interactions"), ["user_id", "item_id", "event"])


@R.add(f"WITH {CLICKS}, p AS (SELECT CAST(ts AS DATE) AS day, count(value) AS n, avg(value) AS mean FROM clicks GROUP BY 1) SELECT strftime(day, '%Y-%m-%d') AS day, n, round(mean, 6) AS mean FROM p WHERE day > (SELECT max(day) FROM p) - 10")
def d17_daily_mean(spark: SparkSession, d: str) -> DataFrame:
    out = U.daily_mean(clicks(spark, d), "ts", "value", 10)
    return out.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "n", F.round("mean", 6).alias("mean"))


@R.add("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(stddev_samp(o_totalprice), 4) AS std FROM orders GROUP BY 1")
def d19_target_by(spark: SparkSession, d: str) -> DataFrame:
    return r6(U.target_by(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice"), "mean", "median", "std", digits=4)


_GEO = "g AS (SELECT c_custkey, -60 + (c_custkey * 7919 % 1000) * 0.125 AS la, -170 + (c_custkey * 104729 % 1000) * 0.375 AS lo FROM customer)"
_CELL = "floor(la / (500000 / CAST(111320.0 AS DOUBLE))) AS r, floor(lo / (500000 / CAST(111320.0 AS DOUBLE)) * greatest(cos(radians(floor(la / (500000 / CAST(111320.0 AS DOUBLE))) * (500000 / CAST(111320.0 AS DOUBLE)))), 0.01)) AS c"


def _places(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k, (-60 + (k * 7919 % 1000) * 0.125).alias("la"), (-170 + (k * 104729 % 1000) * 0.375).alias("lo"))


@R.add(f"WITH {_GEO}, x AS (SELECT c_custkey, {_CELL} FROM g) SELECT c_custkey, count(*) OVER (PARTITION BY r, c) AS cell_n, round(count(*) OVER (PARTITION BY r, c) / count(*) OVER (), 9) AS cell_share FROM x")
def i26_grid_counts(spark: SparkSession, d: str) -> DataFrame:
    return U.grid_counts(_places(spark, d), "la", "lo", 500_000).select("c_custkey", "cell_n", F.round("cell_share", 9).alias("cell_share"))


@R.add(f"WITH {_GEO}, v AS (SELECT * FROM g WHERE abs(la) <= 90 AND abs(lo) <= 180) SELECT (SELECT count(*) FROM g) AS rows, 0::BIGINT AS missing, (SELECT count(*) FROM g) - (SELECT count(*) FROM v) AS invalid, (SELECT count(*) FROM v) - (SELECT count(*) FROM (SELECT DISTINCT la, lo FROM v)) AS repeated, (SELECT count(*) FROM (SELECT DISTINCT r, c FROM (SELECT {_CELL} FROM v))) AS cells")
def m27_places(spark: SparkSession, d: str) -> DataFrame:
    return U.place_report(_places(spark, d), "la", "lo", 500_000)


@R.add(f"WITH {_MERGE}, first AS (SELECT query_id, item_id, list_sort(sources)[1] AS source FROM merged WHERE rank <= 10) SELECT source, count(*) AS hits FROM truth LEFT JOIN first USING (query_id, item_id) GROUP BY source")
def d21_source_attribution(spark: SparkSession, d: str) -> DataFrame:
    i = interactions(spark, d)
    found = _merged(i).select("query_id", "item_id", "rank", F.explode("sources").alias("source"))
    return U.source_attribution(found, _truth(i), 10)


@R.add("WITH x AS (SELECT label % 3 AS k, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT k, i, avg(x) AS x FROM x GROUP BY ALL), g AS (SELECT k, i, max(x) AS x FROM x GROUP BY ALL) SELECT m.k, round(sum(m.x * (m.i + 1)), 6) AS mean_sum, round(sum(g.x * (g.i + 1)), 6) AS max_sum FROM m JOIN g ON m.k = g.k AND m.i = g.i GROUP BY m.k")
def d23_vector_aggregate(spark: SparkSession, d: str) -> DataFrame:
    """Element-wise mean and max of vectors by key, told by the sums of their elements times their places."""
    e = table(spark, d, "embeddings").withColumn("k", F.col("label") % 3)
    told = lambda v: F.aggregate(F.transform(v, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    mean, most = (U.vector_aggregate(e, "k", "embedding", how).withColumnRenamed("embedding", how) for how in ("mean", "max"))
    return mean.join(most, "k").select("k", F.round(told("mean"), 6).alias("mean_sum"), F.round(told("max"), 6).alias("max_sum"))


@R.add(f"WITH {_S} SELECT fold, round(avg(CASE WHEN (p1 > 0.5) = (y = 1) THEN 1 ELSE 0 END), 8) AS accuracy, round(sqrt(avg(pow(y - p1, 2))), 8) AS rmse FROM s GROUP BY fold")
def l27_scores_by_fold(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d)
    a, b = U.scores_by_fold(s, "y", "p1", "fold", "accuracy"), U.scores_by_fold(s, "y", "p1", "fold", "rmse")
    return spark.createDataFrame([(k, round(x, 8), round(y, 8)) for (k, x), (_, y) in zip(a, b)], "fold int, accuracy double, rmse double")


@R.add("WITH m AS (SELECT avg(o_totalprice) AS m FROM orders) SELECT (SELECT round(avg(abs(o_totalprice - m)), 4) FROM orders, m) AS mean_mae, (SELECT round(max(n) / sum(n), 8) FROM (SELECT count(*) AS n FROM orders GROUP BY o_totalprice)) AS majority_accuracy")
def l29_baselines(spark: SparkSession, d: str) -> DataFrame:
    return r6(r6(U.baselines(table(spark, d, "orders"), "o_totalprice"), "mean_mae", digits=4), "majority_accuracy", digits=8)


@R.add("WITH x AS (SELECT 'l_quantity' AS feature, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem), q AS (SELECT feature, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM x GROUP BY 1), l AS (SELECT feature, a - 0.5 * (b - a) AS low, b + 0.5 * (b - a) AS high FROM q) SELECT feature, round(low, 6) AS low, round(high, 6) AS high, count(*) FILTER (x < low OR x > high) AS outside, round(count(*) FILTER (x < low OR x > high) / count(*), 9) AS share FROM x JOIN l USING (feature) GROUP BY ALL")
def m9_outliers(spark: SparkSession, d: str) -> DataFrame:
    return r6(r6(U.outlier_tips(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"], 0.5), "low", "high"), "share", digits=9)


@R.add("WITH n AS (SELECT CASE WHEN c_nationkey <> 0 THEN 1 ELSE 0 END + CASE WHEN floor(c_acctbal / 1000) <> 0 THEN 1 ELSE 0 END AS n FROM customer) SELECT count(*) AS rows, CAST(sum(n) AS BIGINT) AS nnz, round(sum(n) / (count(*) * 2), 9) AS density, quantile_cont(n, 0.25) AS p25, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.75) AS p75 FROM n")
def m19_sparse_profile(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("thousands", F.floor(F.col("c_acctbal") / 1000))
    return r6(U.sparse_profile(sets.sparse_rows(c, ["c_custkey"], ["c_nationkey", "thousands"]), 2), "density", digits=9)


@R.add("WITH f AS (SELECT DISTINCT o_orderpriority AS r, o_custkey AS v FROM orders), n AS (SELECT r, count(*) AS n FROM f GROUP BY 1), c AS (SELECT x.r AS a, y.r AS b, count(*) AS c FROM f x JOIN f y ON x.v = y.v AND x.r < y.r GROUP BY ALL) SELECT p.r AS a, q.r AS b, round(coalesce(c, 0) / (p.n + q.n - coalesce(c, 0)), 9) AS jaccard FROM n p JOIN n q ON p.r < q.r LEFT JOIN c ON c.a = p.r AND c.b = q.r")
def m25_set_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return r6(U.set_jaccard(table(spark, d, "orders"), "o_orderpriority", "o_custkey"), "jaccard", digits=9)


@R.add("SELECT 'l_quantity+twice' AS columns")
def g11_repeated_columns(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select("l_quantity", "l_tax", F.col("l_quantity").alias("twice"), (F.col("l_quantity") + 1).alias("more"))
    return spark.createDataFrame([("+".join(g),) for g in U.repeated_columns(x)], "columns string")


@R.add("SELECT 'l_shipdate' AS name, 'time' AS kind UNION ALL SELECT 'l_quantity', 'num' UNION ALL SELECT 'l_returnflag', 'cat'")
def b8_column_kinds(spark: SparkSession, d: str) -> DataFrame:
    kinds = U.column_kinds(table(spark, d, "lineitem").select("l_shipdate", "l_quantity", "l_returnflag"))
    return spark.createDataFrame(list(kinds.items()), "name string, kind string")


@R.add("SELECT l_orderkey, l_linenumber, round(date_diff('second', o_orderdate, l_shipdate) / 86400, 6) AS days, round(date_diff('second', o_orderdate, l_shipdate) / 3600, 6) AS hours FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def h15_spans(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    at = lambda c: F.col(c).cast("timestamp")
    return x.select("l_orderkey", "l_linenumber", F.round(U.span(at("l_shipdate"), at("o_orderdate")), 6).alias("days"), F.round(U.span(at("l_shipdate"), at("o_orderdate"), "h"), 6).alias("hours"))


@R.add(r"SELECT item_id, regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM (SELECT DISTINCT item_id, title FROM tiny_items)")
def h23_plain_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "tiny_items").select("item_id", "title").distinct().select("item_id", U.plain_name(F.col("title")).alias("name"))


@R.add("WITH x AS (SELECT DISTINCT item_id, coalesce(list_filter(list_transform(string_split(description, ' '), lambda v: trim(v)), lambda v: v <> ''), []) AS x FROM tiny_items), s AS (SELECT *, list_transform(list_distinct(x), lambda v: len(list_filter(x, lambda w: w = v)) / len(x)) AS p FROM x) SELECT item_id, CAST(len(x) AS INT) AS n, CAST(len(list_distinct(x)) AS INT) AS distinct, round(coalesce(list_max(p), 0), 9) AS top1, round(coalesce(list_sum(list_transform(p, lambda v: -v * log2(v))), 0), 6) AS entropy FROM s")
def h27_list_statistics(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "tiny_items").select("item_id", "description").distinct()
    s = U.list_statistics(F.col("description"), " ")
    out = x.select("item_id", s["len"].alias("n"), s["distinct"].alias("distinct"), F.round(s["top1_share"], 9).alias("top1"), F.round(s["entropy"], 6).alias("entropy"))
    return out.distinct()


@R.add(f"WITH {CLICKS}, b AS (SELECT CAST(floor(quantile_cont(us, 0.6) / 3600000000) AS BIGINT) * 3600000000 AS a, CAST(floor(quantile_cont(us, 0.8) / 3600000000) AS BIGINT) * 3600000000 AS b FROM clicks) SELECT event_id, CASE WHEN us < a THEN 'train' WHEN us < b THEN 'val' ELSE 'test' END AS split FROM clicks, b")
def e19_fraction_split(spark: SparkSession, d: str) -> DataFrame:
    return U.fraction_split(clicks(spark, d), "us").select("event_id", "split")


@R.add(f"WITH {CLICKS}, m AS (SELECT *, avg(value) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 604800000000 PRECEDING AND CURRENT ROW) AS m FROM clicks) SELECT event_id, round(lag(m) OVER (PARTITION BY user_id ORDER BY us, event_id), 9) AS before FROM m")
def e9_mean_before(spark: SparkSession, d: str) -> DataFrame:
    out = U.trailing_mean_before(clicks(spark, d), "user_id", "us", "event_id", "value", 7 * C.DAY_US)
    return out.select("event_id", F.round("value_before", 9).alias("before"))
