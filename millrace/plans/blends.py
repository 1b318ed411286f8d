"""Queries of blending, thresholds, calibrators and models; models are checked by properties that must hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import blending as W
from millrace.operators import candidates as C
from millrace.operators import models as M
from millrace.operators import quality as Q
from millrace.operators import timeline as T
from millrace.plans.registry import Registry
from millrace.sources.frames import INTER, interactions
from millrace.sources.tables import table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql

_S = """s AS (SELECT o_orderkey, o_custkey, o_orderpriority AS c, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS y, CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '#0'), 1, 7))::BIGINT % 5 AS INT) AS fold,
 (o_custkey % 97 + CASE WHEN o_totalprice > 250000 THEN 30 ELSE 0 END) / 130 AS p1, (o_orderkey * 7 % 101 + CASE WHEN o_totalprice > 250000 THEN 40 ELSE 0 END) / 150 AS p2, o_orderkey % 13 / 13 AS p3 FROM orders)"""
RUNS = ["p1", "p2", "p3"]
WEIGHTS = {"p1": 0.5, "p2": 0.3, "p3": 0.2}


def scores(spark: SparkSession, d: str) -> DataFrame:
    """Three runs' scores of the orders, the first two better than chance."""
    o, y = table(spark, d, "orders"), (F.col("o_totalprice") > 250000).cast("int")
    p1, p2, p3 = (F.col("o_custkey") % 97 + 30 * F.col("y")) / 130, (F.col("o_orderkey") * 7 % 101 + 40 * F.col("y")) / 150, F.col("o_orderkey") % 13 / 13
    rows = o.select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("c"), y.alias("y"), T.hashed_fold(F.col("o_orderkey"), 5).alias("fold"))
    return rows.withColumns({"p1": p1, "p2": p2, "p3": p3})


def _rank(c: str) -> str:
    return f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2) / count(*) OVER ()"


_LOGIT = lambda c: f"ln(least(greatest({c}, 1e-6), 1 - 1e-6) / (1 - least(greatest({c}, 1e-6), 1 - 1e-6)))"


@R.add(f"WITH {_S}, r AS (SELECT *, {_rank('p1')} AS r1, {_rank('p2')} AS r2, {_rank('p3')} AS r3 FROM s) SELECT o_orderkey, round(0.5 * p1 + 0.3 * p2 + 0.2 * p3, 6) AS proba, round(1 / (1 + exp(-(0.5 * {_LOGIT('p1')} + 0.3 * {_LOGIT('p2')} + 0.2 * {_LOGIT('p3')}))), 6) AS logit, round(0.5 * r1 + 0.3 * r2 + 0.2 * r3, 6) AS rank, round(list_median([p1, p2, p3]), 6) AS median FROM r")
def n7_spaces(spark: SparkSession, d: str) -> DataFrame:
    s = scores(spark, d)
    out = W.median_blend(s, RUNS, "median")
    for space in ("proba", "logit", "rank"):
        out = W.blended(out, WEIGHTS, space, space)
    return out.select("o_orderkey", *[F.round(c, 6).alias(c) for c in ("proba", "logit", "rank", "median")])


SEARCH = [[1 / 3, 1 / 3, 1 / 3], [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [0.5, 0.3, 0.2], [0.25, 0.75, 0.0]]
_W = "w AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, CAST({a!r} AS DOUBLE), CAST({b!r} AS DOUBLE), CAST({c!r} AS DOUBLE))" for i, (a, b, c) in enumerate(SEARCH)) + ") t(candidate, a, b, c3))"
_NDCG = f"""{_S}, {_W}, x AS (SELECT candidate, o_custkey, o_orderkey, y, round(p1 * a + p2 * b + p3 * c3, 9) AS v FROM s, w), r AS (SELECT *, row_number() OVER (PARTITION BY candidate, o_custkey ORDER BY v DESC, o_orderkey) AS k FROM x),
 g AS (SELECT candidate, o_custkey, sum(CASE WHEN k <= 5 AND y > 0 THEN 1 / log2(k + 1) ELSE 0 END) AS dcg, CAST(sum(y) AS BIGINT) AS n FROM r GROUP BY ALL HAVING sum(y) > 0),
 m AS (SELECT candidate, avg(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(g.n, 5) + 1) t(i))) AS ndcg FROM g GROUP BY 1)"""


@R.add(f"WITH {_NDCG} SELECT candidate, round(ndcg, 8) AS ndcg FROM m")
def n6_weight_search(spark: SparkSession, d: str) -> DataFrame:
    return W.search_by_ndcg(scores(spark, d), RUNS, "y", SEARCH, 5, "o_custkey", "o_orderkey").withColumn("ndcg", F.round("ndcg", 8))


@R.add(f"WITH {_NDCG} SELECT candidate, round(ndcg, 8) AS ndcg FROM m ORDER BY m.ndcg DESC, candidate LIMIT 1")
def n19_best_method(spark: SparkSession, d: str) -> DataFrame:
    return W.best_candidate(W.search_by_ndcg(scores(spark, d), RUNS, "y", SEARCH, 5, "o_custkey", "o_orderkey")).withColumn("ndcg", F.round("ndcg", 8))


@R.add("SELECT true AS no_worse_than_given, 21::BIGINT AS tried")
def n17_perturbed_weights(spark: SparkSession, d: str) -> DataFrame:
    around = [0.5, 0.3, 0.2]
    tried = [around, *W.weight_candidates(3, 16, 1, around)]
    found = W.search_by_ndcg(scores(spark, d), RUNS, "y", tried, 5, "o_custkey", "o_orderkey")
    return found.agg((F.max("ndcg") >= F.max(F.when(F.col("candidate") == 0, F.col("ndcg")))).alias("no_worse_than_given"), F.count(F.lit(1)).alias("tried"))


@R.add("SELECT true AS sums_to_one, true AS nonnegative, true AS no_worse_than_equal, true AS free_no_worse")
def n8_weights(spark: SparkSession, d: str) -> DataFrame:
    m = W.moments(scores(spark, d), RUNS, "y")[0]
    w, v = W.convex_weights(m), W.nonnegative_weights(m)
    error = lambda x: W.squared_error(m, [0.0, *x])
    row = (bool(abs(w.sum() - 1) < 1e-9), bool((w >= 0).all() and (v >= 0).all()), bool(error(w) <= error([1 / 3] * 3) + 1e-12), bool(error(v) <= error(w) + 1e-9))
    return spark.createDataFrame([row], "sums_to_one boolean, nonnegative boolean, no_worse_than_equal boolean, free_no_worse boolean")


@R.add(f"WITH {_S} SELECT count(*) AS rows, true AS level2_better, true AS blend_better FROM s")
def n9_second_level(spark: SparkSession, d: str) -> DataFrame:
    """Rows, and whether ridge and convex blends fitted on the other folds err less than the best run alone."""
    s = W.fold_safe_blend(scores(spark, d), RUNS, "y", "fold")
    out, _ = W.second_level(s, RUNS, "y", "fold")
    mse = lambda c: F.avg(F.pow(F.col(c) - F.col("y"), 2))
    best = F.least(*[mse(c) for c in RUNS])
    return out.agg(F.count("level2").alias("rows"), (mse("level2") < best).alias("level2_better"), (mse("blend") < best).alias("blend_better"))


@R.add(f"WITH {_S}, t AS (SELECT *, CASE c WHEN '1-URGENT' THEN 0.4 WHEN '5-LOW' THEN 0.6 ELSE 0.5 END AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY p1 DESC, o_orderkey) AS k FROM s) SELECT o_orderkey, CASE WHEN p1 > t THEN 1 ELSE 0 END AS by_class, CASE WHEN k <= 2 THEN 1 ELSE 0 END AS top2 FROM t")
def n15_decisions(spark: SparkSession, d: str) -> DataFrame:
    s = W.with_threshold(scores(spark, d), "p1", {"1-URGENT": 0.4, "5-LOW": 0.6}, "c").withColumnRenamed("decision", "by_class")
    return W.top_decisions(s, "o_custkey", "p1", "o_orderkey", 2).select("o_orderkey", "by_class", F.col("decision").alias("top2"))


@R.add(f"WITH {_S}, g AS (SELECT unnest(range(41)) AS g), h AS (SELECT g, count(*) FILTER (y = 1 AND ceil(p1 * 40) > g) AS tp, count(*) FILTER (y = 0 AND ceil(p1 * 40) > g) AS fp, count(*) FILTER (y = 1 AND ceil(p1 * 40) <= g) AS fn, count(*) FILTER (y = 0 AND ceil(p1 * 40) <= g) AS tn FROM g, s GROUP BY g) SELECT g / 40 AS threshold, tp, fp, fn, tn, round(2 * tp / (2 * tp + fp + fn), 8) AS f1, round(tp / (tp + fn) - fp / (fp + tn), 8) AS youden FROM h")
def n14_curve(spark: SparkSession, d: str) -> DataFrame:
    return W.threshold_curve(scores(spark, d), "y", "p1", 41).withColumns({c: F.round(c, 8) for c in ("f1", "youden")})


@R.add(f"WITH {_S} SELECT count(*) AS rows, true AS mean_kept, true AS monotone FROM s")
def n13_isotonic(spark: SparkSession, d: str) -> DataFrame:
    out = M.isotonic(scores(spark, d), "y", "p1")
    levels = out.groupBy("p1").agg(F.first("calibrated").alias("q"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
    steps = Q.running_counts(levels.withColumn("up", F.lit(0)), "p1", ["up"])
    falls = steps.select("q", F.lag("q").over(T.Window.orderBy("p1")).alias("before")).where("q < before - 1e-9")  # distinct scores of one small grid
    mean = levels.agg((F.abs(F.sum(F.col("q") * F.col("n")) - F.sum("y")) < 1e-6 * F.sum("n")).alias("mean_kept"), F.sum("n").alias("rows"))
    return mean.withColumn("monotone", F.lit(falls.isEmpty()))


@R.add(f"WITH {_S} SELECT count(*) AS rows, true AS mean_kept, true AS better FROM s")
def n13_platt(spark: SparkSession, d: str) -> DataFrame:
    """Rows, whether the mean is the target's, and whether the scores say more than that mean alone."""
    out = M.platt(scores(spark, d), "y", "p1")
    mean = out.agg(F.avg("y")).first()[0]
    loss = Q.log_loss(F.col("y"), F.col("calibrated")) < Q.log_loss(F.col("y"), F.lit(mean))
    return out.agg(F.count(F.lit(1)).alias("rows"), (F.abs(F.avg("calibrated") - F.avg("y")) < 1e-3).alias("mean_kept"), loss.alias("better"))


def _folds_checked(spark: SparkSession, d: str, model: str) -> DataFrame:
    """Rows, whether each was scored once by the model of the other folds, and whether the scores beat the best run."""
    s = scores(spark, d)
    out = C.cut(M.cross_validated(s, "o_orderkey", RUNS, "y", "fold", 5, model))
    auc = Q.ranking_quality(out, "y", "p").first().auc
    alone = max(Q.ranking_quality(s, "y", c).first().auc for c in ("p1", "p2"))
    per = out.groupBy("o_orderkey").agg(F.count("p").alias("n")).agg(F.count(F.lit(1)).alias("rows"), (F.max("n") == 1).alias("once"))
    return per.withColumn("better", F.lit(auc > alone))


@R.add(f"WITH {_S} SELECT count(*) AS rows, true AS once, true AS better FROM s")
def n1_linear_folds(spark: SparkSession, d: str) -> DataFrame:
    return _folds_checked(spark, d, "linear")


@R.add(f"WITH {_S} SELECT count(*) AS rows, true AS once, true AS better FROM s")
def n2_tree_folds(spark: SparkSession, d: str) -> DataFrame:
    return _folds_checked(spark, d, "trees")


@R.add("SELECT true AS told_apart, true AS alike_not")
def m16_adversarial(spark: SparkSession, d: str) -> DataFrame:
    """A domain classifier tells tables of other prices apart, and not two hashed halves of one."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 97).alias("k"))
    half = T.hashed_fold(F.col("o_orderkey"), 2, 7)
    a, b = o.where(half == 0), o.where(half == 1)
    apart = M.adversarial_auc(a, b.withColumn("o_totalprice", F.col("o_totalprice") * 2 + 100000), "o_orderkey", ["o_totalprice", "k"])
    same = M.adversarial_auc(a, b, "o_orderkey", ["o_totalprice", "k"])
    return spark.createDataFrame([(apart > 0.8, abs(same - 0.5) < 0.1)], "told_apart boolean, alike_not boolean")


@R.add("SELECT count(*) AS rows, true AS tighter FROM embeddings")
def i30_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a cluster, and whether vectors lie closer to their cluster's mean than to that of all."""
    e = table(spark, d, "embeddings")
    found = M.clusters(e, "vec_id", "embedding", 8)
    long = found.join(e, "vec_id").select("vec_id", "cluster", F.posexplode("embedding").alias("i", "x"))
    inner = long.groupBy("cluster", "i").agg(F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("v")).agg(F.sum(F.col("n") * F.col("v")).alias("s")).scalar()
    outer = long.groupBy("i").agg(F.count(F.lit(1)).alias("n"), F.var_pop("x").alias("v")).agg(F.sum(F.col("n") * F.col("v")).alias("s")).scalar()
    return found.agg(F.count("cluster").alias("rows")).withColumn("tighter", inner < outer)


@R.add("SELECT count(*) AS rows, true AS falling, true AS uncorrelated FROM embeddings")
def i31_components(spark: SparkSession, d: str) -> DataFrame:
    pc = M.components(table(spark, d, "embeddings"), "vec_id", "embedding", 4)
    c = [F.col("pc")[i] for i in range(4)]
    falls, flat = F.lit(True), F.lit(True)
    for a, b in zip(c, c[1:]):
        falls = falls & (F.var_pop(a) >= F.var_pop(b))
        flat = flat & (F.abs(F.corr(a, b)) < 1e-6)
    return pc.agg(F.count(F.lit(1)).alias("rows"), falls.alias("falling"), flat.alias("uncorrelated"))


@R.add(f"WITH {INTER} SELECT count(DISTINCT user_id) AS queries, 0::BIGINT AS short, 0::BIGINT AS repeats FROM inter")
def k5_factors(spark: SparkSession, d: str) -> DataFrame:
    """Factor candidates counted: queries, those of fewer than ten items, repeats."""
    i = interactions(spark, d)
    found = M.factor_candidates(i, T.latest(i, "user_id").select("user_id", F.col("user_id").alias("query_id")), 10)
    per = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item_id").alias("d"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("n") < 10).alias("short"), F.sum(F.col("n") - F.col("d")).alias("repeats"))


@R.add(f"WITH {INTER} SELECT count(DISTINCT user_id) AS queries, 0::BIGINT AS short, 0::BIGINT AS repeats FROM inter")
def k4_item_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by the mean vector of the last five items, counted as in k5_factors."""
    i = interactions(spark, d)
    q = T.latest(i, "user_id").withColumn("query_id", F.col("user_id"))
    found = M.vector_candidates(T.history(i, q, 5), M.item_vectors(i, "user_id", size=16), 10)
    per = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item_id").alias("d"))
    return per.agg(F.count(F.lit(1)).alias("queries"), F.count_if(F.col("n") < 10).alias("short"), F.sum(F.col("n") - F.col("d")).alias("repeats"))
