"""Queries of candidate generation, ranking and ranking metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import candidates as C
from millrace.operators import neighbours as N
from millrace.operators import ranking as K
from millrace.operators import timeline as T
from millrace.plans.registry import Registry
from millrace.sources.frames import INTER, interactions
from millrace.sources.tables import table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql
CUT = "2000-01-01"

_Q = f"""{INTER}, known AS (SELECT * FROM inter WHERE ts <= TIMESTAMP '{CUT}'), q AS (SELECT user_id AS query_id, user_id, max(ts) AS ts_query FROM known GROUP BY ALL),
 truth AS (SELECT DISTINCT user_id AS query_id, item_id FROM inter WHERE ts > TIMESTAMP '{CUT}' AND user_id IN (SELECT user_id FROM q))"""
_DAY = 86_400_000_000
_POPS = f"""aged AS (SELECT item_id, floor((max(epoch_us(ts)) OVER () - epoch_us(ts)) / {_DAY}) AS age FROM known), byage AS (SELECT item_id, age, count(*) AS n FROM aged GROUP BY ALL),
 pop AS (SELECT item_id, sum(n * exp(-age / CAST(30 AS DOUBLE)) ORDER BY age) AS score FROM byage GROUP BY 1)"""
_POP = f"{_Q}, {_POPS}"


def _hist(name: str, where: str = "true") -> str:
    return f"""{name} AS (SELECT query_id, item_id, pos FROM (SELECT q.query_id, i.item_id, row_number() OVER (PARTITION BY q.query_id ORDER BY i.ts DESC, i.line DESC, i.item_id DESC) - 1 AS pos
  FROM q JOIN inter i ON i.user_id = q.user_id AND i.ts <= q.ts_query AND {where}) WHERE pos < 10)"""


_RECENT = f"i.ts >= TIMESTAMP '{CUT}' - INTERVAL 30 DAY"
_EDGES = f"""{_Q}, {_hist("hist", _RECENT)}, raw AS (SELECT user_id, item_id, epoch_us(ts) AS us, row_number() OVER () AS r FROM known i WHERE {_RECENT}),
 linked AS (SELECT least(x.item_id, y.item_id) AS a, greatest(x.item_id, y.item_id) AS b, floor(abs(x.us - y.us) / {_DAY}) AS gap, sum(CASE WHEN x.item_id = y.item_id THEN 2 ELSE 1 END) AS n
  FROM raw x JOIN raw y ON x.user_id = y.user_id AND x.r < y.r GROUP BY ALL),
 e0 AS (SELECT a, b, sum(n * exp(-0.05 * gap) ORDER BY gap) AS w FROM linked GROUP BY ALL), e1 AS (SELECT a AS item_i, b AS item_j, w FROM e0 WHERE w >= 1 UNION ALL SELECT b, a, w FROM e0 WHERE w >= 1 AND a <> b)"""
_COVIS = f"""{_EDGES}, edges AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_i ORDER BY w DESC, item_j) AS k FROM e1) WHERE k <= 200),
 covis AS (SELECT h.query_id, e.item_j AS item_id, sum(power(CAST(0.9 AS DOUBLE), pos) * w ORDER BY pos) AS score FROM hist h JOIN edges e ON e.item_i = h.item_id GROUP BY ALL)"""
_NGRAM = f"""{_Q}, {_hist("hist")}, s AS (SELECT item_id, lag(item_id, 1) OVER w AS b1, lag(item_id, 2) OVER w AS b2, lag(item_id, 3) OVER w AS b3 FROM known WINDOW w AS (PARTITION BY user_id ORDER BY ts, line, item_id)),
 p AS (SELECT [b1] AS prefix, item_id FROM s WHERE b1 IS NOT NULL UNION ALL SELECT [b2, b1], item_id FROM s WHERE b2 IS NOT NULL UNION ALL SELECT [b3, b2, b1], item_id FROM s WHERE b3 IS NOT NULL),
 c AS (SELECT prefix, item_id, count(*) AS n FROM p GROUP BY ALL), t AS (SELECT *, n / sum(n) OVER (PARTITION BY prefix) AS p FROM c),
 l AS (SELECT query_id, list(item_id ORDER BY pos DESC) AS items FROM hist GROUP BY 1),
 a AS (SELECT query_id, k.k AS n, list_slice(items, len(items) - k.k + 1, len(items)) AS prefix FROM l, (SELECT unnest([1, 2, 3]) AS k) k WHERE len(items) >= k.k),
 ngram AS (SELECT a.query_id, t.item_id, sum(power(0.9, a.n - 1) * t.p) AS score FROM a JOIN t ON t.prefix = a.prefix GROUP BY ALL)"""


def _queries(i: DataFrame) -> DataFrame:
    return T.latest(i.where(f"ts <= TIMESTAMP '{CUT}'"), "user_id").withColumn("query_id", F.col("user_id"))


def _truth(i: DataFrame) -> DataFrame:
    later = i.where(f"ts > TIMESTAMP '{CUT}'").select(F.col("user_id").alias("query_id"), "item_id").distinct()
    return later.join(_queries(i).select("query_id"), "query_id", "left_semi")


def _members(i: DataFrame) -> DataFrame:
    return C.until(i, CUT).where("session_id IS NOT NULL AND item_id IS NOT NULL").select("session_id", "item_id").distinct()


def _covis(i: DataFrame) -> DataFrame:
    return C.covisit_candidates(C.history(C.until(i, CUT, 30), _queries(i), 10), C.covisit_edges(i, CUT, scope="user_id"))


@R.add(f"WITH {_POP} SELECT item_id, round(score, 6) AS score FROM pop ORDER BY pop.score DESC, item_id LIMIT 20")
def k1_popularity(spark: SparkSession, d: str) -> DataFrame:
    return C.popularity(interactions(spark, d), CUT).orderBy(F.col("score").desc(), "item_id").limit(20).withColumn("score", F.round("score", 6))


@R.add(f"WITH {_POP}, t AS (SELECT item_id, score FROM pop ORDER BY score DESC, item_id LIMIT 10) SELECT query_id, item_id, round(score, 6) AS score FROM q, t")
def c14_top_for_all(spark: SparkSession, d: str) -> DataFrame:
    i = interactions(spark, d)
    return C.top_for_all(_queries(i), C.popularity(i, CUT), 10).withColumn("score", F.round("score", 6))


@R.add(f"WITH {_COVIS} SELECT query_id, item_id, round(score, 6) AS score FROM covis")
def k2_covisit(spark: SparkSession, d: str) -> DataFrame:
    return _covis(interactions(spark, d)).withColumn("score", F.round("score", 6))


@R.add(f"WITH {_NGRAM} SELECT query_id, item_id, round(score, 6) AS score FROM ngram")
def k3_ngram(spark: SparkSession, d: str) -> DataFrame:
    i = interactions(spark, d)
    return C.ngram_candidates(C.history(i, _queries(i), 10), C.ngram_transitions(i, CUT)).withColumn("score", F.round("score", 6))


_JACCARD = """l AS (SELECT DISTINCT x.item_id AS item_i, y.item_id AS item_j FROM known x JOIN known y ON x.session_id = y.session_id AND x.item_id < y.item_id),
 lb AS (SELECT * FROM l UNION ALL SELECT item_j, item_i FROM l), n AS (SELECT item_i, count(*) AS n FROM lb GROUP BY 1),
 c AS (SELECT l.item_i, l.item_j, count(*) AS c FROM l JOIN lb x ON x.item_i = l.item_i JOIN lb y ON y.item_i = l.item_j AND y.item_j = x.item_j GROUP BY ALL),
 s AS (SELECT lb.item_i, lb.item_j, coalesce(c, 0) / (a.n + b.n - coalesce(c, 0)) AS jaccard FROM lb LEFT JOIN c ON c.item_i = least(lb.item_i, lb.item_j) AND c.item_j = greatest(lb.item_i, lb.item_j)
  JOIN n a ON a.item_i = lb.item_i JOIN n b ON b.item_i = lb.item_j)"""


@R.add(f"WITH {_Q}, {_JACCARD}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_i ORDER BY jaccard DESC, item_j) AS INT) AS rank FROM s) SELECT item_i, item_j, rank, round(jaccard, 6) AS jaccard FROM r WHERE rank <= 20")
def k6_neighbour_jaccard(spark: SparkSession, d: str) -> DataFrame:
    i = interactions(spark, d)
    if graph := N.graph_of(_members(i), "session_id"):
        near = N.nearest_neighbours(*graph, dict(i.dtypes)["item_id"], 20)
    else:
        near = K.best(C.neighbour_jaccard(C.links_of(i, CUT)), "item_i", "jaccard", "item_j", 20)
    return near.select("item_i", "item_j", F.round("jaccard", 6).alias("jaccard"), "rank")


@R.add(f"WITH {_Q}, {_JACCARD}, {_hist('hist')} SELECT query_id, item_j AS item_id, round(sum(jaccard ORDER BY pos), 6) AS score FROM hist JOIN s ON s.item_i = hist.item_id WHERE pos < 5 GROUP BY ALL")
def k6_graph(spark: SparkSession, d: str) -> DataFrame:
    i = interactions(spark, d)
    hist = T.last_events(C.until(i, CUT), 5)
    if graph := N.graph_of(_members(i), "session_id"):
        found = N.neighbour_candidates(*graph, dict(i.dtypes)["item_id"], hist)
    else:
        found = C.jaccard_candidates(hist, C.neighbour_jaccard(C.links_of(i, CUT)))
    return found.withColumn("score", F.round("score", 6))


_MERGE = f"""{_COVIS}, {_POPS},
 p10 AS (SELECT item_id, score FROM pop ORDER BY score DESC, item_id LIMIT 20), s AS (SELECT 'covis' AS source, query_id, item_id, score FROM covis UNION ALL SELECT 'pop', query_id, item_id, score FROM q, p10),
 r AS (SELECT *, row_number() OVER (PARTITION BY source, query_id ORDER BY score DESC, item_id) AS k FROM s), f AS (SELECT * FROM r WHERE k <= CASE source WHEN 'covis' THEN 50 ELSE 20 END),
 mm AS (SELECT *, min(score) OVER (PARTITION BY source) AS lo, max(score) OVER (PARTITION BY source) AS hi FROM f),
 g AS (SELECT query_id, item_id, list_sort(list(DISTINCT source)) AS sources, max((score - lo) / (hi - lo) * CASE source WHEN 'covis' THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END) AS score FROM mm GROUP BY ALL),
 merged AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM g) WHERE rank <= 20)"""


def _merged(i: DataFrame) -> DataFrame:
    sources = {"covis": _covis(i), "pop": C.top_for_all(_queries(i), C.popularity(i, CUT), 20)}
    return C.merged(sources, {"covis": 50, "pop": 20}, {"covis": 1.0, "pop": 0.3}, 20)


@R.add(f"WITH {_MERGE} SELECT query_id, item_id, array_to_string(sources, '+') AS sources, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM merged")
def k11_merged(spark: SparkSession, d: str) -> DataFrame:
    return _merged(interactions(spark, d)).select("query_id", "item_id", F.concat_ws("+", "sources").alias("sources"), F.round("score", 6).alias("score"), "rank")


_METRIC = """n AS (SELECT query_id, count(*) AS n FROM truth GROUP BY 1), l AS (SELECT query_id, count(*) AS len FROM lists GROUP BY 1),
 h AS (SELECT p.query_id, p.rank, row_number() OVER (PARTITION BY p.query_id ORDER BY p.rank) AS seen FROM lists p JOIN truth t ON t.query_id = p.query_id AND t.item_id = p.item_id),
 a AS (SELECT query_id, count(*) AS h, sum(1 / log2(rank + 1)) AS dcg, sum(seen / rank) AS ap, min(rank) AS first FROM h GROUP BY 1),
 m AS (SELECT n.query_id, coalesce(h, 0) / n AS recall, CASE WHEN coalesce(h, 0) > 0 THEN 1.0 ELSE 0.0 END AS hit, coalesce(h / len, 0) AS precision,
  coalesce(dcg, 0) / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n.n, 20) + 1) r(i)) AS ndcg, coalesce(ap, 0) / least(n.n, 20) AS ap, coalesce(1 / first, 0) AS rr FROM n LEFT JOIN l USING (query_id) LEFT JOIN a USING (query_id))"""
_NAMES = ["recall", "hit", "precision", "ndcg", "ap", "rr"]
_TOPPOP = f"{_POP}, top20 AS (SELECT item_id, row_number() OVER (ORDER BY score DESC, item_id) AS rank FROM pop ORDER BY rank LIMIT 20), lists AS (SELECT query_id, item_id, rank FROM q, top20)"


def _pop_lists(i: DataFrame) -> DataFrame:
    return K.best(C.top_for_all(_queries(i), C.popularity(i, CUT), 20), "query_id", "score", "item_id", 20)


@R.add(f"WITH {_TOPPOP}, {_METRIC} SELECT query_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in _NAMES) + " FROM m")
def l1_query_metrics(spark: SparkSession, d: str) -> DataFrame:
    i = interactions(spark, d)
    m = K.query_metrics(_truth(i), _pop_lists(i), 20)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in _NAMES])


@R.add(f"WITH {_MERGE}, lists AS (SELECT query_id, item_id, rank FROM merged), {_METRIC} SELECT count(*) AS queries, round(avg(recall), 5) AS recall, round(avg(ndcg), 5) AS ndcg, round(avg(rr), 5) AS mrr FROM m")
def l10_offline(spark: SparkSession, d: str) -> DataFrame:
    i = interactions(spark, d)
    m = K.query_metrics(_truth(i), _merged(i), 20)
    return m.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("recall"), 5).alias("recall"), F.round(F.avg("ndcg"), 5).alias("ndcg"), F.round(F.avg("rr"), 5).alias("mrr"))


@R.add(f"WITH {_TOPPOP}, c AS (SELECT p_partkey AS item_id, p_brand AS category FROM part), n AS (SELECT item_id, count(*) AS pop FROM known GROUP BY 1), x AS (SELECT query_id, count(DISTINCT category) / count(*) AS d, sum(-ln(pop / (SELECT sum(pop) FROM n))) AS s, count(pop) AS c FROM lists LEFT JOIN c USING (item_id) LEFT JOIN n USING (item_id) GROUP BY 1) SELECT round(avg(d), 6) AS diversity, round(sum(s) / sum(c), 6) AS novelty, round((SELECT count(DISTINCT item_id) FROM lists) / (SELECT count(DISTINCT item_id) FROM c), 6) AS coverage FROM x")
def l7_list_metrics(spark: SparkSession, d: str) -> DataFrame:
    i = interactions(spark, d)
    pop = i.where(f"ts <= TIMESTAMP '{CUT}'").groupBy("item_id").agg(F.count(F.lit(1)).alias("pop"))
    items = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("category"))
    return K.list_metrics(_pop_lists(i), items, pop, 20).select(*[F.round(c, 6).alias(c) for c in ("diversity", "novelty", "coverage")])


@R.add(f"WITH {_TOPPOP}, {_METRIC}, s AS (SELECT DISTINCT t.query_id, p_brand AS value FROM truth t JOIN part ON p_partkey = t.item_id) SELECT 'brand' AS slice, value, count(*) AS n, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg FROM m JOIN s USING (query_id) GROUP BY value")
def l12_slices(spark: SparkSession, d: str) -> DataFrame:
    i = interactions(spark, d)
    brands = table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("value"))
    s = _truth(i).join(brands, "item_id").select("query_id", F.lit("brand").alias("slice"), "value")
    return K.metrics_by(K.query_metrics(_truth(i), _pop_lists(i), 20), s, ["recall", "ndcg"]).withColumns({c: F.round(c, 6) for c in ("recall", "ndcg")})


_RUNS = """runs AS (SELECT 'a' AS run, query_id, item_id, max(score) AS score FROM tiny_predictions WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL
 UNION ALL SELECT 'b', query_id, item_id, max(f1) FROM ranker_x_train WHERE f1 IS NOT NULL AND NOT isnan(f1) AND NOT isinf(f1) AND query_id IS NOT NULL GROUP BY ALL)"""


def _runs(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "tiny_predictions").where("score IS NOT NULL AND NOT isnan(score)").groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    b = table(spark, d, "ranker_x_train").where("f1 IS NOT NULL AND NOT isnan(f1) AND abs(f1) < double('infinity') AND query_id IS NOT NULL").groupBy("query_id", "item_id").agg(F.max("f1").alias("score"))
    return a.withColumn("run", F.lit("a")).unionByName(b.withColumn("run", F.lit("b")))


@R.add(f"WITH {_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY run, query_id ORDER BY score DESC, item_id) AS rank FROM runs), l AS (SELECT run, query_id, max(rank) AS n FROM r GROUP BY ALL), i AS (SELECT DISTINCT query_id, item_id FROM runs) SELECT i.query_id, i.item_id, round(sum(1 / (60 + coalesce(r.rank, l.n + 1000))), 9) AS score FROM i JOIN l ON l.query_id = i.query_id LEFT JOIN r ON r.run = l.run AND r.query_id = i.query_id AND r.item_id = i.item_id GROUP BY ALL")
def n10_rrf(spark: SparkSession, d: str) -> DataFrame:
    return K.reciprocal_rank_fusion(_runs(spark, d)).withColumn("score", F.round("score", 9))


@R.add(f"WITH {_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY run, query_id ORDER BY score DESC, item_id) AS rank FROM runs) SELECT query_id, item_id, CAST(sum(11 - rank) AS BIGINT) AS score FROM r WHERE rank <= 10 GROUP BY ALL")
def n11_borda(spark: SparkSession, d: str) -> DataFrame:
    return K.borda(_runs(spark, d), 10)


@R.add(f"WITH {_RUNS}, m AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi FROM runs WINDOW w AS (PARTITION BY run, query_id)), x AS (SELECT *, CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0 END AS x FROM m) SELECT query_id, item_id, round(sum(x), 6) AS comb_sum, round(sum(x) * count(*), 6) AS comb_mnz FROM x GROUP BY ALL")
def n11_comb(spark: SparkSession, d: str) -> DataFrame:
    return K.comb(_runs(spark, d)).withColumns({c: F.round(c, 6) for c in ("comb_sum", "comb_mnz")})


@R.add(f"WITH {_RUNS} SELECT query_id, item_id, round(sum(CASE run WHEN 'a' THEN 0.7 ELSE 0.3 END * score), 6) AS score FROM runs GROUP BY ALL")
def k18_blend(spark: SparkSession, d: str) -> DataFrame:
    return K.linear_blend(_runs(spark, d), {"a": 0.7, "b": 0.3}).withColumn("score", F.round("score", 6))


@R.add(f"WITH {_RUNS}, r AS (SELECT *, row_number() OVER (PARTITION BY run, query_id ORDER BY score DESC, item_id) AS k FROM runs), g AS (SELECT query_id, item_id, max(score) AS score FROM r WHERE k <= CASE run WHEN 'a' THEN 3 ELSE 2 END GROUP BY ALL), x AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INT) AS rank FROM g) SELECT query_id, item_id, rank FROM x WHERE rank <= 4")
def f8_quotas(spark: SparkSession, d: str) -> DataFrame:
    return K.within_quotas(_runs(spark, d), {"a": 3, "b": 2}, 4, "run").select("query_id", "item_id", "rank")


@R.add("WITH p AS (SELECT t.query_id, t.item_id, max(score) AS score, any_value(c) AS c FROM tiny_predictions t JOIN (SELECT item_id, min(lower(trim(category))) AS c FROM tiny_items GROUP BY 1) USING (item_id) WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY query_id, c ORDER BY score DESC, item_id) AS j FROM p), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INT) AS rank FROM k WHERE j <= 1) SELECT query_id, item_id, rank FROM r WHERE rank <= 5")
def k17_category_quota(spark: SparkSession, d: str) -> DataFrame:
    cats = table(spark, d, "tiny_items").groupBy("item_id").agg(F.min(F.lower(F.trim("category"))).alias("c"))
    p = table(spark, d, "tiny_predictions").where("score IS NOT NULL AND NOT isnan(score)").groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    return K.per_category(p.join(cats, "item_id"), "c", 1, 5).select("query_id", "item_id", "rank")


@R.add(f"WITH {_POP}, ranked AS (SELECT item_id, row_number() OVER (ORDER BY score DESC, item_id) AS k FROM pop ORDER BY k LIMIT 10), own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, item_id) AS k FROM (SELECT user_id AS query_id, item_id, count(*) AS n FROM known GROUP BY ALL)) WHERE k <= 5), f AS (SELECT query_id, item_id, 0 AS s, k FROM own UNION ALL SELECT q.query_id, r.item_id, 1, r.k FROM q, ranked r WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.query_id = q.query_id AND o.item_id = r.item_id)), x AS (SELECT query_id, item_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY s, k) AS INT) AS rank FROM f) SELECT * FROM x WHERE rank <= 5")
def f7_padded(spark: SparkSession, d: str) -> DataFrame:
    i = interactions(spark, d)
    own = C.until(i, CUT).groupBy(F.col("user_id").alias("query_id"), "item_id").agg(F.count(F.lit(1)).alias("score"))
    return K.padded(own, _queries(i), C.popularity(i, CUT), 5)


_WITH_CATS = "cats AS (SELECT item_id, min(lower(trim(category))) AS c FROM tiny_items GROUP BY 1), p AS (SELECT query_id, item_id, max(score) AS score FROM tiny_predictions WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL), j AS (SELECT p.*, c FROM p JOIN cats USING (item_id))"


@R.add(f"WITH {_WITH_CATS}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id, c ORDER BY score DESC, item_id) AS k FROM j), g AS (SELECT *, CAST(0.5 AS DOUBLE) * score - CASE WHEN k > 1 THEN CAST(0.5 AS DOUBLE) ELSE 0 END AS gain FROM f), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, score DESC, item_id) AS INT) AS rank FROM g) SELECT query_id, item_id, rank FROM r WHERE rank <= 5")
def k14_mmr(spark: SparkSession, d: str) -> DataFrame:
    cats = table(spark, d, "tiny_items").groupBy("item_id").agg(F.min(F.lower(F.trim("category"))).alias("c"))
    p = table(spark, d, "tiny_predictions").where("score IS NOT NULL AND NOT isnan(score)").groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    return K.mmr_by_category(p.join(cats, "item_id"), "c", 5, 0.5).select("query_id", "item_id", "rank")


def _walk_sql(rounds: int) -> str:
    out = f"""{_Q}, {_hist("hist")}, raw AS (SELECT session_id, item_id, row_number() OVER () AS r FROM known),
 g AS (SELECT x.item_id AS a, y.item_id AS b, count(*) AS n FROM raw x JOIN raw y ON x.session_id = y.session_id AND x.r <> y.r GROUP BY ALL), step AS (SELECT a AS item_i, b AS item_j, n / sum(n) OVER (PARTITION BY a) AS p FROM g),
 s0 AS (SELECT query_id, item_id, sum(1 / n) AS s FROM (SELECT query_id, item_id, count(*) OVER (PARTITION BY query_id) AS n FROM hist WHERE pos < 5) GROUP BY ALL)"""
    for k in range(1, rounds + 1):
        out += f", s{k} AS (SELECT query_id, item_id, sum(s) AS s FROM (SELECT query_id, item_j AS item_id, 0.85 * s * p AS s FROM s{k - 1} JOIN step ON item_i = item_id UNION ALL SELECT query_id, item_id, 0.15 * s FROM s0) GROUP BY ALL)"
    return out


@R.add(f"WITH {_walk_sql(10)}, r AS (SELECT query_id, item_id, round(s, 9) AS score FROM s10), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INT) AS rank FROM r) SELECT query_id, item_id, rank, score FROM k WHERE rank <= 20")
def k6_walks(spark: SparkSession, d: str) -> DataFrame:
    i = interactions(spark, d)
    seeds = C.history(i, _queries(i), 5).select("query_id", "item_id")
    walks = C.personalised_rank(C.covisit_edges(i, CUT, min_weight=0, neighbours=None, window_days=None), seeds, k=20, apart=2e-9)
    return K.best(walks.withColumn("score", F.round("score", 9)), "query_id", "score", "item_id", 20)


@R.add("SELECT count(DISTINCT o_custkey) AS queries, 0::BIGINT AS short, 0::BIGINT AS positives, 0::BIGINT AS repeats FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def g5_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Sampled negatives, counted: queries, those with fewer than five, positives among them, repeats."""
    i = interactions(spark, d)
    items = i.groupBy("item_id").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    own = i.select(F.col("user_id").alias("query_id"), "item_id")
    drawn = C.sampled_negatives(own, items, 5).groupBy("query_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    marked = drawn.join(own.distinct().withColumn("own", F.lit(1)), ["query_id", "item_id"], "left")
    per = marked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count("own").alias("own"), F.count_if(F.col("n") > 1).alias("twice"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("n") < 5).alias("short"), F.sum("own").alias("positives"), F.sum("twice").alias("repeats"))


@R.add(f"WITH {_TOPPOP}, {_METRIC} SELECT round(avg(recall), 6) AS mean, true AS inside, true AS narrow FROM m")
def l11_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    """The mean, whether its 5 to 95 % interval holds it, and whether that is within four standard errors to a side."""
    i = interactions(spark, d)
    m = K.query_metrics(_truth(i), _pop_lists(i), 20)
    low, high = K.bootstrap_interval(m, "recall").first()
    error = 4 * F.stddev_samp("recall") / F.sqrt(F.count(F.lit(1)))
    mean = F.avg("recall")
    return m.agg(F.round(mean, 6).alias("mean"), ((F.lit(low) <= mean) & (mean <= F.lit(high))).alias("inside"), ((mean - low <= error) & (high - mean <= error)).alias("narrow"))
