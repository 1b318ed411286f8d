"""Queries of feature blocks, training pairs, loaders, sets and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import blocks as B
from millrace.operators import candidates as C
from millrace.operators import timeline as T
from millrace.plans.registry import Registry
from millrace.plans.timeline import CUT, _PAIRS
from millrace.session import named_folder
from millrace.sources import sets as S
from millrace.sources.frames import INTER, interactions
from millrace.sources.tables import table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


def pairs_until(log: DataFrame, cutoff: str) -> DataFrame:
    """Each user with the items of its last moment up to the cutoff and of all later ones."""
    last = T.latest(log.where(f"ts <= {cutoff}"), "user_id")
    return last.join(log, "user_id").where("ts >= ts_query").select(F.col("user_id").alias("query_id"), "user_id", "item_id", "ts_query").distinct()


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("category"), F.col("p_retailprice").alias("amount"), F.col("p_size").alias("size"))


def _block(spark: SparkSession, d: str, name: str, **params) -> DataFrame:
    log = interactions(spark, d)
    block = B.build_blocks({name: params})[name]
    return block.fit(log, _items(spark, d)).transform(pairs_until(log, CUT))


_U = "coalesce(recency_user_h, 0) AS user_recency_h, coalesce(user_count_30d, 0) AS user_freq_30d, coalesce(user_items_30d, 0) AS user_unique_items_30d"
_CAT = """h20 AS (SELECT q.user_id, p_brand AS c, row_number() OVER (PARTITION BY q.user_id ORDER BY i.ts DESC, i.line DESC, i.item_id DESC) AS k FROM (SELECT DISTINCT user_id, ts_query FROM p) q
  JOIN inter i ON i.user_id = q.user_id AND i.ts <= q.ts_query LEFT JOIN part ON p_partkey = i.item_id), n20 AS (SELECT user_id, count(*) AS n FROM h20 WHERE k <= 20 GROUP BY 1),
 c20 AS (SELECT user_id, c, count(*) AS n FROM h20 WHERE k <= 20 GROUP BY ALL),
 sim AS (SELECT p.query_id, p.item_id, coalesce(c20.n / n20.n, 0) AS cat_match_share FROM p LEFT JOIN part ON p_partkey = p.item_id LEFT JOIN c20 ON c20.user_id = p.user_id AND c20.c = p_brand LEFT JOIN n20 ON n20.user_id = p.user_id)"""


@R.add(f"{_PAIRS} SELECT p.query_id, p.item_id, {_U} FROM p LEFT JOIN u USING (query_id, item_id)")
def r2_user_agg(spark: SparkSession, d: str) -> DataFrame:
    return _block(spark, d, "user_agg").withColumn("user_recency_h", F.round("user_recency_h", 6))


@R.add(f"{_PAIRS} SELECT p.query_id, p.item_id, coalesce(item_count_30d, 0) AS item_pop_30d, coalesce(item_count_365d, 0) AS item_pop_365d FROM p LEFT JOIN t USING (query_id, item_id)")
def r3_item_agg(spark: SparkSession, d: str) -> DataFrame:
    return _block(spark, d, "item_agg", windows=[30, 365])


@R.add(f"{_PAIRS}, {_CAT} SELECT query_id, item_id, round(cat_match_share, 9) AS cat_match_share FROM sim")
def r5_similarity(spark: SparkSession, d: str) -> DataFrame:
    return _block(spark, d, "similarity").withColumn("cat_match_share", F.round("cat_match_share", 9))


@R.add(f"{_PAIRS} SELECT p.query_id, p.item_id, coalesce(p_retailprice, 0) AS amount, CAST(coalesce(p_size, 0) AS DOUBLE) AS size FROM p LEFT JOIN part ON p_partkey = p.item_id")
def r6_attributes(spark: SparkSession, d: str) -> DataFrame:
    return _block(spark, d, "attributes", columns=["amount", "size"])


def _joined_sql(side: str, cutoff: str) -> str:
    return f"SELECT * FROM ({_PAIRS.replace(CUT, cutoff)}, {_CAT} SELECT '{side}' AS side, p.query_id, p.item_id, {_U}, coalesce(item_count_30d, 0) AS item_pop_30d, cat_match_share FROM p LEFT JOIN u USING (query_id, item_id) LEFT JOIN t USING (query_id, item_id) JOIN sim USING (query_id, item_id))"


LATER = "TIMESTAMP '2000-06-01'"
_COLS = ["cat_match_share", "item_pop_30d", "user_freq_30d", "user_recency_h", "user_unique_items_30d"]


@R.add(f"WITH j AS ({_joined_sql('train', CUT)} UNION ALL {_joined_sql('test', LATER)}) SELECT side, query_id, item_id, round(CAST(CAST(user_recency_h AS FLOAT) AS DOUBLE), 4) AS user_recency_h, round(CAST(CAST(cat_match_share AS FLOAT) AS DOUBLE), 6) AS cat_match_share, user_freq_30d, user_unique_items_30d, item_pop_30d FROM j")
def r9_joiner(spark: SparkSession, d: str) -> DataFrame:
    log = interactions(spark, d)
    made = B.build_blocks({"user_agg": {"windows": [7]}, "item_agg": {}, "similarity": {}, "sequence": {"enabled": False}}, {"user_agg": {"windows": [30]}, "item_agg": {"windows": [30]}})
    out = B.FeatureJoiner(made).fit(log, _items(spark, d)).transform(pairs_until(log, CUT), pairs_until(log, LATER))
    if out["columns"] != ["query_id", "item_id", *_COLS]:
        raise AssertionError(f"columns {out['columns']}")
    both = out["train"].withColumn("side", F.lit("train")).unionByName(out["test"].withColumn("side", F.lit("test")))
    return both.withColumns({"user_recency_h": F.round(F.col("user_recency_h").cast("double"), 4), "cat_match_share": F.round(F.col("cat_match_share").cast("double"), 6)})


@R.add("WITH p AS (SELECT DISTINCT query_id, item_id, label FROM tiny_pairs_train) SELECT query_id, count(*) AS size FROM p GROUP BY 1")
def r12_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return B.group_sizes(table(spark, d, "tiny_pairs_train").select("query_id", "item_id", "label").distinct())


@R.add("SELECT count(DISTINCT query_id) AS queries, true AS whole, true AS balanced FROM tiny_pairs_train WHERE query_id IS NOT NULL AND ts_query IS NOT NULL")
def e24_ranker_folds(spark: SparkSession, d: str) -> DataFrame:
    """Folds of queries by time, checked: queries, none in two folds, and folds of like size."""
    p = table(spark, d, "tiny_pairs_train").where("query_id IS NOT NULL AND ts_query IS NOT NULL")
    per = B.ranker_folds(p, 4, "query_id", "ts_query").groupBy("query_id").agg(F.min("fold").alias("a"), F.max("fold").alias("b"))
    sizes = per.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") != F.col("b")).alias("torn"))
    return sizes.agg(F.sum("n").alias("queries"), (F.sum("torn") == 0).alias("whole"), (F.max("n") <= F.min("n") * 1.2 + 2).alias("balanced"))


_POSITIVE = f"{INTER}, q AS (SELECT user_id, max(ts) AS ts_query FROM inter WHERE ts <= {CUT} GROUP BY 1), l AS (SELECT q.user_id AS query_id, i.item_id, row_number() OVER (PARTITION BY q.user_id ORDER BY i.ts DESC, i.line DESC, i.item_id DESC) AS k FROM q JOIN inter i ON i.user_id = q.user_id AND i.ts <= q.ts_query), pos AS (SELECT query_id, item_id FROM l WHERE k = 1)"


def _pairs_made(spark: SparkSession, d: str, mode: str) -> DataFrame:
    """The positives, with their query's negatives counted: repeats, positives among them, and whether all differ."""
    i = interactions(spark, d)
    q = T.latest(i.where(f"ts <= {CUT}"), "user_id").select(F.col("user_id").alias("query_id"), "user_id", "ts_query")
    links = C.covisit_edges(i, "1999-01-01", window_days=365) if mode == "hard" else None
    made = C.cut(B.build_pairs(i, q, 5, mode, links))
    pos = made.where("label = 1").select("query_id", "item_id")
    neg = made.where("label = 0").groupBy("query_id").agg(F.count(F.lit(1)).alias("negatives"), F.count_distinct("item_id").alias("different"))
    hit = made.where("label = 0").join(pos, ["query_id", "item_id"], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("wrong"))
    return pos.join(neg, "query_id", "left").join(hit, "query_id", "left").fillna(0, ["wrong"])


_MADE = f"WITH {_POSITIVE} SELECT query_id, item_id, 5::BIGINT AS negatives, 5::BIGINT AS different, 0::BIGINT AS wrong FROM pos"


@R.add(_MADE)
def g6_pairs_popular(spark: SparkSession, d: str) -> DataFrame:
    return _pairs_made(spark, d, "pop")


@R.add(_MADE)
def g6_pairs_uniform(spark: SparkSession, d: str) -> DataFrame:
    return _pairs_made(spark, d, "uniform")


@R.add(_MADE)
def g6_pairs_hard(spark: SparkSession, d: str) -> DataFrame:
    return _pairs_made(spark, d, "hard")


@R.add(f"WITH {INTER}, q AS (SELECT user_id, max(ts) AS ts_query FROM inter WHERE ts <= {CUT} GROUP BY 1) SELECT i.user_id AS query_id, count(*) AS late FROM inter i JOIN q USING (user_id) WHERE i.ts > ts_query GROUP BY ALL")
def c15_late_rows(spark: SparkSession, d: str) -> DataFrame:
    i = interactions(spark, d)
    q = T.latest(i.where(f"ts <= {CUT}"), "user_id").withColumnRenamed("user_id", "query_id")
    return B.late_rows(i.withColumnRenamed("user_id", "query_id"), q).groupBy("query_id").agg(F.count(F.lit(1)).alias("late"))


@R.add("SELECT event_id, item_id FROM (SELECT event_id, item_id, min(loaded_at) AS t FROM tiny_interactions WHERE item_id IS NOT NULL AND event_id IS NOT NULL GROUP BY ALL) e JOIN (SELECT item_id, max(age_added) AS a FROM tiny_items WHERE age_added IS NOT NULL GROUP BY 1) i USING (item_id) WHERE a > t")
def c16_items_of_the_future(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "tiny_interactions").where("item_id IS NOT NULL AND event_id IS NOT NULL").groupBy("event_id", "item_id").agg(F.min("loaded_at").alias("t"))
    items = table(spark, d, "tiny_items").where("age_added IS NOT NULL AND item_id IS NOT NULL").groupBy("item_id").agg(F.max("age_added").alias("added"))
    return e.join(items, "item_id").where("added > t").select("event_id", "item_id")


@R.add("SELECT 'train' AS side, query_id, item_id, CAST(0 AS INT) AS f1, label FROM tiny_pairs_train UNION ALL SELECT 'test', query_id, item_id, CAST(1 AS INT), 0 FROM tiny_predictions")
def b11_aligned(spark: SparkSession, d: str) -> DataFrame:
    train = table(spark, d, "tiny_pairs_train").select("query_id", "item_id", "label")
    test = table(spark, d, "tiny_predictions").select("item_id", "query_id", F.lit(1).alias("f1"))
    a, b, _ = B.align_columns(train, test)
    return a.withColumn("side", F.lit("train")).unionByName(b.withColumn("side", F.lit("test")))


@R.add("""WITH t AS (SELECT * FROM ranker_x_train) SELECT * FROM (
 SELECT 'score' AS column, 'train' AS side, 'missing' AS problem, NULL::BIGINT AS rows UNION ALL SELECT 'f2', 'test', 'missing', NULL UNION ALL SELECT 'f1', 'train', 'null', count(*) FILTER (f1 IS NULL) FROM t UNION ALL SELECT 'f2', 'train', 'null', count(*) FILTER (f2 IS NULL) FROM t
 UNION ALL SELECT 'f1', 'train', 'not finite', count(*) FILTER (isnan(f1) OR isinf(f1)) FROM t UNION ALL SELECT 'f2', 'train', 'not finite', count(*) FILTER (isnan(f2) OR isinf(f2)) FROM t
 UNION ALL SELECT 'f1', 'test', 'null', count(*) FILTER (score IS NULL) FROM tiny_predictions UNION ALL SELECT 'f1', 'test', 'not finite', count(*) FILTER (isnan(score)) FROM tiny_predictions
 UNION ALL SELECT 'score', 'test', 'null', count(*) FILTER (score IS NULL) FROM tiny_predictions UNION ALL SELECT 'score', 'test', 'not finite', count(*) FILTER (isnan(score)) FROM tiny_predictions) WHERE rows IS NULL OR rows > 0""")
def b12_column_problems(spark: SparkSession, d: str) -> DataFrame:
    test = table(spark, d, "tiny_predictions").select("query_id", "item_id", F.col("score").alias("f1"), "score")
    return B.column_problems(table(spark, d, "ranker_x_train"), test)


@R.add("""WITH r AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS k FROM tiny_predictions), l AS (SELECT query_id, item_id, k + CASE WHEN k > 2 THEN 1 ELSE 0 END AS k FROM r),
 n AS (SELECT query_id, count(*) AS n FROM l GROUP BY 1), d AS (SELECT query_id, item_id FROM l GROUP BY ALL HAVING count(*) > 1)
 SELECT 'gap in ranks' AS problem, count(*) AS n FROM n WHERE n > 2 UNION ALL SELECT 'null id', count(*) FROM l WHERE query_id IS NULL OR item_id IS NULL UNION ALL SELECT 'repeated item', count(*) FROM d""")
def b17_list_problems(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "tiny_predictions")
    w = T.Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
    k = F.row_number().over(w)
    return B.list_problems(p.withColumn("k", k).select("query_id", "item_id", (F.col("k") + (F.col("k") > 2).cast("int")).alias("rank")))


@R.add("""WITH s AS (SELECT DISTINCT query_id FROM tiny_queries), p AS (SELECT query_id, max(f1) AS f1, count(*) AS n FROM ranker_x_train WHERE NOT isnan(f1) GROUP BY 1), r AS (SELECT s.query_id, f1, n FROM s LEFT JOIN p ON p.query_id = s.query_id)
 SELECT 'missing' AS problem, count(*) AS n FROM r WHERE f1 IS NULL UNION ALL SELECT 'repeated', count(*) FROM r WHERE n > 1 UNION ALL SELECT 'outside', count(*) FROM r WHERE f1 < 0 OR f1 > 1 UNION ALL SELECT 'extra', count(*) FROM p WHERE query_id NOT IN (SELECT query_id FROM s WHERE query_id IS NOT NULL) OR query_id IS NULL""")
def b16_submission(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "ranker_x_train").where("f1 IS NOT NULL AND NOT isnan(f1)").select("query_id", "f1")
    return B.submission(p, table(spark, d, "tiny_queries"), "query_id", "f1", 0.0, 1.0)[1]


@R.add(f"WITH {INTER}, u AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS i FROM (SELECT DISTINCT user_id FROM inter)), t AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM (SELECT DISTINCT item_id FROM inter WHERE ts <= {CUT})) SELECT user_id, inter.item_id, session_id, line, u.i AS user_idx, coalesce(t.i, -1) AS item_idx FROM inter JOIN u USING (user_id) LEFT JOIN t ON t.item_id = inter.item_id")
def q6_indexers(spark: SparkSession, d: str) -> DataFrame:
    i = interactions(spark, d).select("user_id", "item_id", "session_id", "line", "ts")
    path = named_folder(spark, "indexers")
    S.Indexers.of({"user_id": i, "item_id": i.where(f"ts <= {CUT}")}).save(path)
    return S.Indexers.load(spark, path, ["user_id", "item_id"]).apply(i).drop("ts")


@R.add("""WITH e AS (SELECT DISTINCT user_id, item_id, session_id, loaded_at AS ts, event FROM tiny_interactions WHERE loaded_at <= TIMESTAMP '2100-01-01') SELECT (SELECT count(*) FROM e) AS interactions, (SELECT count(*) FROM tiny_items) AS items, (SELECT count(*) FROM tiny_queries) AS queries,
 (SELECT count(DISTINCT user_id) FROM e) AS users_indexed, (SELECT count(DISTINCT item_id) FROM tiny_items) AS items_indexed, (SELECT count(DISTINCT session_id) FROM e) AS sessions_indexed""")
def a5_datasets(spark: SparkSession, d: str) -> DataFrame:
    path = named_folder(spark, "datasets")
    log = table(spark, d, "tiny_interactions").select(F.col("user_id").alias("u"), F.col("item_id").alias("i"), "session_id", F.col("loaded_at").alias("at"), "event")
    log.write.parquet(f"{path}/log.parquet")
    schema = S.Schema({"user_id": "u", "item_id": "i", "ts": "at"}, {}, {"user": "user_id"})
    got = S.load_datasets(spark, schema, f"{path}/log.parquet", f"{d}/tiny_items.parquet", f"{d}/tiny_queries.parquet", "2100-01-01", index=True)
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    parts = [n(got.interactions, "interactions"), n(got.items, "items"), n(got.queries, "queries"), *[n(got.indexers.tables[c], f"{c.removesuffix('_id')}s_indexed") for c in ("user_id", "item_id", "session_id")]]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # one row each
    return out


@R.add("SELECT o_orderkey, o_custkey, o_totalprice, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'train' ELSE 'test' END AS side, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN CAST(o_totalprice > 100000 AS INT) END AS y, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '#0'), 1, 7))::BIGINT % 3 AS INT) END AS fold FROM orders")
def a7_sets(spark: SparkSession, d: str) -> DataFrame:
    """A set written and read back: both sides, with target and folds of train."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", (F.col("o_totalprice") > 100000).cast("int").alias("y"), "o_orderdate")
    train, test = o.where("o_orderdate < TIMESTAMP '1998-01-01'").drop("o_orderdate"), o.where("o_orderdate >= TIMESTAMP '1998-01-01'").drop("o_orderdate", "y")
    path = named_folder(spark, "set")
    S.write_set(path, train, test, ["o_orderkey"], "y", train.select("o_orderkey", T.hashed_fold(F.col("o_orderkey"), 3).alias("fold")), {"note": "orders"})
    got = S.read_set(spark, path)
    a = got["train"].join(got["folds"], "o_orderkey").withColumn("side", F.lit("train"))
    return a.unionByName(got["test"].withColumn("side", F.lit("test")), allowMissingColumns=True)


@R.add("SELECT c_custkey, array_to_string(list_filter([0, 1], lambda i: [c_nationkey, floor(c_acctbal / 1000)][i + 1] <> 0), ' ') AS indices FROM customer")
def a10_sparse_rows(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("thousands", F.floor(F.col("c_acctbal") / 1000))
    out = S.sparse_rows(c, ["c_custkey"], ["c_nationkey", "thousands"])
    return out.select("c_custkey", F.array_join(F.transform("indices", lambda i: i.cast("string")), " ").alias("indices"))


@R.add("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def a9_kept(spark: SparkSession, d: str) -> DataFrame:
    """A table kept by its notes: the second call reads what the first has written."""
    folder, made = named_folder(spark, "kept"), []

    def make() -> DataFrame:
        made.append(1)
        return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))

    S.kept(spark, folder, {"what": "priorities", "of": d}, make)
    out = S.kept(spark, folder, {"of": d, "what": "priorities"}, make)
    if len(made) != 1:
        raise AssertionError("made twice")
    return out
