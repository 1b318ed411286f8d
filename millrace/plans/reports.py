"""Queries of profiles, drift, leak probes, agreement of runs and further metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import encoders as E
from millrace.operators import quality as Q
from millrace.operators import timeline as T
from millrace.plans.blends import _S, scores
from millrace.plans.features import _DRIFT, _drift, r6
from millrace.plans.registry import Registry
from millrace.sources.frames import CLICKS, clicks
from millrace.sources.tables import table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql

_COLS = ["l_quantity", "l_extendedprice", "l_tax"]


def _long(columns: list[str], of: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS x, * FROM {of}" for c in columns)


@R.add(f"WITH x AS ({_long(_COLS, 'lineitem')}), n AS (SELECT feature, x, count(*) AS n FROM x GROUP BY ALL), m AS (SELECT feature, max(n) AS most, count(*) AS d FROM n GROUP BY 1) SELECT feature, count(*) AS rows, any_value(d) AS distinct, round(min(x), 6) AS low, round(max(x), 6) AS high, round(skewness(x), 5) AS skew, round(kurtosis(x), 4) AS kurt, round(quantile_cont(x, 0.05), 6) AS p05, round(quantile_cont(x, 0.25), 6) AS p25, round(quantile_cont(x, 0.95), 6) AS p95, any_value(d) <= 1 AS constant, any_value(most) > 0.99 * count(*) AS near_constant FROM x JOIN m USING (feature) GROUP BY feature")
def m13_profile(spark: SparkSession, d: str) -> DataFrame:
    p = Q.profile(table(spark, d, "lineitem"), _COLS)
    out = p.select("feature", "rows", "distinct", F.col("min").alias("low"), F.col("max").alias("high"), "skew", "kurt", "p05", "p25", "p95", "constant", "near_constant")
    return r6(r6(r6(out, "low", "high", "p05", "p25", "p95"), "skew", digits=5), "kurt", digits=4)


@R.add("""WITH x AS (SELECT 'category' AS feature, category AS v FROM tiny_items UNION ALL SELECT 'brand', brand FROM tiny_items), n AS (SELECT feature, v, count(*) AS n FROM x WHERE v IS NOT NULL GROUP BY ALL), t AS (SELECT feature, count(*) AS rows, count(*) FILTER (v IS NULL) AS missing FROM x GROUP BY 1)
 SELECT feature, rows, missing, count(*) AS distinct, count(*) FILTER (n < 5) AS rare, round(coalesce(sum(n / (rows - missing)) FILTER (n < 5), 0), 9) AS rare_share, round(max(n / (rows - missing)), 9) AS top_share, round(sum(-n / (rows - missing) * log2(n / (rows - missing))), 6) AS entropy FROM n JOIN t USING (feature) GROUP BY ALL""")
def m12_categories(spark: SparkSession, d: str) -> DataFrame:
    out = Q.category_profile(table(spark, d, "tiny_items"), ["category", "brand"], 5)
    return r6(r6(out, "rare_share", "top_share", digits=9), "entropy")


_PSI2 = """e AS (SELECT list_distinct(quantile_cont(o_totalprice, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9])) AS q FROM a), n AS (SELECT len(list_filter(q, lambda v: v <= o_totalprice)) AS bin, s FROM (SELECT o_totalprice, 1 AS s FROM a UNION ALL SELECT o_totalprice, 0 FROM b), e),
 c AS (SELECT bin, greatest(sum(s) / (SELECT count(*) FROM a), 1e-12) AS p, greatest(sum(1 - s) / (SELECT count(*) FROM b), 1e-12) AS q FROM n GROUP BY 1)"""


@R.add(f"WITH {_DRIFT}, {_PSI2} SELECT 'o_totalprice' AS feature, round(sum((q - p) * ln(q / p)), 8) AS psi FROM c")
def m2_psi_clipped(spark: SparkSession, d: str) -> DataFrame:
    return r6(Q.stability_indices(*_drift(spark, d), ["o_totalprice"], eps=1e-12, clipped=True), "psi", digits=8)


_SHIFT = ["o_totalprice", "o_custkey"]
_TABLE = f"""{_DRIFT}, l AS (SELECT feature, x, 1 AS a, 0 AS b FROM ({_long(_SHIFT, 'a')}) UNION ALL SELECT feature, x, 0, 1 FROM ({_long(_SHIFT, 'b')})), e AS (SELECT feature, quantile_cont(x, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q FROM l WHERE a = 1 GROUP BY 1),
 bins AS (SELECT feature, len(list_filter(list_distinct(q), lambda v: v < x)) AS bin, sum(a) AS a, sum(b) AS b FROM l JOIN e USING (feature) GROUP BY ALL), tot AS (SELECT feature, sum(a) AS ta, sum(b) AS tb FROM bins GROUP BY 1),
 psi AS (SELECT feature, sum((greatest(b / tb, 1e-6) - greatest(a / ta, 1e-6)) * ln(greatest(b / tb, 1e-6) / greatest(a / ta, 1e-6))) AS psi FROM bins JOIN tot USING (feature) GROUP BY 1),
 v AS (SELECT feature, x, sum(a) AS a, sum(b) AS b FROM l GROUP BY ALL), k AS (SELECT feature, sum(a) OVER w / ta - sum(b) OVER w / tb AS diff FROM v JOIN tot USING (feature) WINDOW w AS (PARTITION BY feature ORDER BY x)), ks AS (SELECT feature, max(abs(diff)) AS ks FROM k GROUP BY 1),
 sh AS (SELECT feature, (avg(x) FILTER (b = 1) - avg(x) FILTER (a = 1)) / stddev_samp(x) FILTER (a = 1) AS ms, (stddev_samp(x) FILTER (b = 1) - stddev_samp(x) FILTER (a = 1)) / stddev_samp(x) FILTER (a = 1) AS ss FROM l GROUP BY 1)"""


@R.add(f"WITH {_TABLE} SELECT feature, round(psi, 8) AS psi, round(ks, 8) AS ks, round(ms, 6) AS mean_shift, round(ss, 6) AS std_shift, psi > 0.0005 AS drop, CAST(row_number() OVER (ORDER BY psi DESC, feature) AS INT) AS psi_rank FROM psi JOIN ks USING (feature) JOIN sh USING (feature)")
def m6_drift_table(spark: SparkSession, d: str) -> DataFrame:
    out = Q.drift_table(*_drift(spark, d), _SHIFT, limit=0.0005)
    return r6(r6(out, "psi", "ks", digits=8), "mean_shift", "std_shift")


_AUC = f"""{_S}, l AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, {c} AS x, y FROM s" for c in ('p1', 'p2', 'p3'))}), n AS (SELECT feature, x, sum(y) AS pos, sum(1 - y) AS neg FROM l GROUP BY ALL),
 c AS (SELECT *, sum(neg) OVER (PARTITION BY feature ORDER BY x) AS cn FROM n), auc AS (SELECT feature, sum(pos * (cn - neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM c GROUP BY 1)"""


@R.add(f"WITH {_AUC} SELECT feature, round(greatest(auc, 1 - auc), 8) AS auc, greatest(auc, 1 - auc) >= 0.6 AS leak FROM auc")
def m15_leak_probes(spark: SparkSession, d: str) -> DataFrame:
    return r6(Q.leak_probes(scores(spark, d), ["p1", "p2", "p3"], "y", 0.6), "auc", digits=8)


@R.add(f"WITH {_TABLE}, g AS (SELECT feature, x, sum(b) AS pos, sum(a) AS neg FROM l GROUP BY ALL), h AS (SELECT *, sum(neg) OVER (PARTITION BY feature ORDER BY x) AS cn FROM g), auc AS (SELECT feature, sum(pos * (cn - neg / 2)) / (sum(pos) * sum(neg)) AS auc FROM h GROUP BY 1), f AS (SELECT feature, psi, greatest(auc, 1 - auc) AS auc FROM psi JOIN auc USING (feature)) SELECT feature, round(psi, 8) AS psi, round(auc, 8) AS auc, CASE WHEN psi >= 0.0005 AND auc >= 0.5 THEN 'psi+auc' WHEN psi >= 0.0005 THEN 'psi' ELSE 'auc' END AS reason FROM f WHERE psi >= 0.0005 OR auc >= 0.5")
def m18_suspicious(spark: SparkSession, d: str) -> DataFrame:
    a, b = _drift(spark, d)
    drift = Q.stability_indices(a, b, _SHIFT)
    return r6(Q.suspicious(drift, Q.leak_probes(Q.domains(a, b), _SHIFT, "domain"), 0.0005, 0.5), "psi", "auc", digits=8)


@R.add("SELECT 1.0::DOUBLE AS same, -1.0::DOUBLE AS turned, 0.0::DOUBLE AS inverted_same, 1.0::DOUBLE AS inverted_turned, true AS enough")
def m24_rank_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of an order with itself and with its reverse, over sampled pairs."""
    x = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderkey").cast("double").alias("a"), (-F.col("o_orderkey").cast("double")).alias("b"))
    same = Q.rank_agreement(x.withColumn("b", F.col("a")), "a", "b").select(F.col("kendall").alias("same"), F.col("inversions").alias("inverted_same"), (F.col("pairs") > 1000).alias("enough"))
    turned = Q.rank_agreement(x, "a", "b").select(F.col("kendall").alias("turned"), F.col("inversions").alias("inverted_turned"))
    return same.crossJoin(turned)  # one row each


@R.add(f"WITH {_S}, r AS (SELECT *, row_number() OVER w AS k, sum(y) OVER (PARTITION BY o_custkey ORDER BY p1 DESC, o_orderkey ROWS UNBOUNDED PRECEDING) AS h FROM s WINDOW w AS (PARTITION BY o_custkey ORDER BY p1 DESC, o_orderkey)), g AS (SELECT sum(CASE WHEN k <= 5 AND y = 1 THEN h / k ELSE 0 END) / sum(y) AS ap FROM r GROUP BY o_custkey HAVING sum(y) > 0) SELECT round(avg(ap), 8) AS map FROM g")
def l25_grouped_map(spark: SparkSession, d: str) -> DataFrame:
    return r6(Q.grouped_average_precision(scores(spark, d), "o_custkey", "y", "p1", "o_orderkey", 5), "map", digits=8)


@R.add(f"WITH {_S}, x AS (SELECT o_orderkey % 3 AS t, [p1, p2, p3] AS v FROM s) SELECT round(avg(CASE WHEN (CASE WHEN v[1] > v[t + 1] OR (v[1] = v[t + 1] AND 0 < t) THEN 1 ELSE 0 END + CASE WHEN v[2] > v[t + 1] OR (v[2] = v[t + 1] AND 1 < t) THEN 1 ELSE 0 END + CASE WHEN v[3] > v[t + 1] OR (v[3] = v[t + 1] AND 2 < t) THEN 1 ELSE 0 END) < 2 THEN 1 ELSE 0 END), 8) AS accuracy FROM x")
def l24_top_k_accuracy(spark: SparkSession, d: str) -> DataFrame:
    x = scores(spark, d).select((F.col("o_orderkey") % 3).cast("int").alias("t"), F.array("p1", "p2", "p3").alias("v"))
    return r6(Q.top_k_accuracy(x, "t", "v", 2), "accuracy", digits=8)


@R.add(f"WITH {_S}, r AS (SELECT p1, p2, y FROM s) SELECT round(avg(-(y * ln(least(greatest(p1, 1e-15), 1 - 1e-15)) + (1 - y) * ln(1 - least(greatest(p1, 1e-15), 1 - 1e-15)))), 8) AS log_loss FROM r")
def l22_log_loss(spark: SparkSession, d: str) -> DataFrame:
    return r6(scores(spark, d).agg(Q.log_loss(F.col("y"), F.col("p1")).alias("log_loss")), "log_loss", digits=8)


@R.add(f"WITH {_DRIFT}, n AS (SELECT v, sum(a) AS a, sum(b) AS b FROM (SELECT o_custkey AS v, 1 AS a, 0 AS b FROM a UNION ALL SELECT o_custkey, 0, 1 FROM b) GROUP BY 1) SELECT round(avg(abs(a / (SELECT count(*) FROM a) - b / (SELECT count(*) FROM b))), 10) AS shift FROM n")
def l14_time_shift(spark: SparkSession, d: str) -> DataFrame:
    return r6(Q.population_shift(*_drift(spark, d), "o_custkey"), "shift", digits=10)


@R.add("WITH a AS (SELECT DISTINCT query_id, item_id FROM tiny_pairs_train WHERE query_id IS NOT NULL AND item_id IS NOT NULL), b AS (SELECT DISTINCT query_id, item_id FROM tiny_predictions WHERE query_id IS NOT NULL AND item_id IS NOT NULL), n AS (SELECT (SELECT count(*) FROM a SEMI JOIN b USING (query_id, item_id)) AS common, (SELECT count(*) FROM a) AS na, (SELECT count(*) FROM b) AS nb) SELECT common, na - common AS only_a, nb - common AS only_b, round(common / (na + nb - common), 9) AS jaccard FROM n")
def c18_key_overlap(spark: SparkSession, d: str) -> DataFrame:
    return r6(Q.key_overlap(table(spark, d, "tiny_pairs_train"), table(spark, d, "tiny_predictions"), ["query_id", "item_id"]), "jaccard", digits=9)


@R.add("SELECT count(*) FILTER (domain = 0) AS train, count(*) FILTER (domain = 1) AS test FROM (SELECT 0 AS domain FROM tiny_pairs_train UNION ALL SELECT 1 FROM tiny_predictions)")
def g9_domains(spark: SparkSession, d: str) -> DataFrame:
    x = Q.domains(table(spark, d, "tiny_pairs_train"), table(spark, d, "tiny_predictions"))
    return x.agg(F.count_if(F.col("domain") == 0).alias("train"), F.count_if(F.col("domain") == 1).alias("test"))


@R.add("WITH n AS (SELECT o_orderpriority AS c, count(*) AS n FROM orders GROUP BY 1) SELECT c, least(n, (SELECT min(n) FROM n)) AS n FROM n")
def g8_balanced(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each class after the larger ones are drawn down to the least."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("c"))
    return E.balanced(o, "c", "o_orderkey").groupBy("c").agg(F.count(F.lit(1)).alias("n"))


@R.add("WITH n AS (SELECT o_orderpriority AS c, count(*) AS n FROM orders GROUP BY 1) SELECT c, CAST(ceil(n * 0.1) AS BIGINT) AS n FROM n")
def f11_stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each class in a stratified tenth."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("c"))
    return E.stratified_sample(o, "c", "o_orderkey", 0.1).groupBy("c").agg(F.count(F.lit(1)).alias("n"))


@R.add("WITH x AS (SELECT c_acctbal AS v FROM customer), m AS (SELECT unnest(range(41)) AS i), l AS (SELECT -2 + 4 * i / 40 AS g FROM m), t AS (SELECT g, CASE WHEN v >= 0 THEN CASE WHEN abs(g) < 1e-9 THEN ln(v + 1) ELSE (pow(v + 1, g) - 1) / g END ELSE CASE WHEN abs(g - 2) < 1e-9 THEN -ln(1 - v) ELSE -(pow(1 - v, 2 - g) - 1) / (2 - g) END END AS y, v FROM x, l), s AS (SELECT g, -count(*) / 2 * ln(var_pop(y)) + (g - 1) * sum(sign(v) * ln(abs(v) + 1)) AS like FROM t GROUP BY g), b AS (SELECT g FROM s ORDER BY s.like DESC LIMIT 1) SELECT c_custkey, round(y, 4) AS x, round(g, 6) AS lambda FROM (SELECT c_custkey, c_acctbal AS w FROM customer) c JOIN (SELECT DISTINCT v, y, g FROM t JOIN b USING (g)) u ON u.v = c.w")
def h4_yeo_johnson(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    lam, column = E.yeo_johnson(c, "c_acctbal")
    return c.select("c_custkey", F.round(column, 4).alias("x"), F.lit(round(lam, 6)).alias("lambda"))


@R.add("WITH x AS (SELECT o_totalprice AS v FROM orders WHERE o_totalprice > 0), l AS (SELECT CASE WHEN i = 20 THEN 0 ELSE -2 + 4 * i / 40 END AS g FROM (SELECT unnest(range(41)) AS i)), s AS (SELECT g, -count(*) / 2 * ln(var_pop(CASE WHEN g = 0 THEN ln(v) ELSE (pow(v, g) - 1) / g END)) + (g - 1) * sum(ln(v)) AS like FROM x, l GROUP BY g), b AS (SELECT g FROM s ORDER BY s.like DESC LIMIT 1) SELECT o_orderkey, round(CASE WHEN g = 0 THEN ln(o_totalprice) ELSE (pow(o_totalprice, g) - 1) / g END, 4) AS x, round(g, 6) AS lambda FROM orders, b")
def h3_box_cox(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "orders")
    lam, column = E.box_cox(c, "o_totalprice")
    return c.select("o_orderkey", F.round(column, 4).alias("x"), F.lit(round(lam, 6)).alias("lambda"))


@R.add("SELECT item_id, title, CASE WHEN brand IS NULL THEN 1 ELSE 0 END AS brand_null, CASE WHEN category IS NULL THEN 1 ELSE 0 END AS category_null FROM tiny_items")
def i8_null_flags(spark: SparkSession, d: str) -> DataFrame:
    flags = E.null_flags(["brand", "category"])
    return table(spark, d, "tiny_items").select("item_id", "title", *[c.alias(k) for k, c in flags.items()])


@R.add("WITH k AS (SELECT o_orderpriority AS c, row_number() OVER (ORDER BY o_orderpriority) - 1 AS i FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-04')) SELECT o_orderkey, CAST(coalesce(i, -1) AS BIGINT) AS code FROM orders LEFT JOIN k ON c = o_orderpriority")
def i13_ordinal(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    out = E.ordinal_encoded(o, o.where("o_orderdate < TIMESTAMP '1995-01-04'"), "o_orderpriority")
    return out.select("o_orderkey", F.col("o_orderpriority_code").alias("code"))


@R.add(f"WITH {_S} SELECT true AS informative, count(*) AS rows FROM s")
def i7_tree_bins(spark: SparkSession, d: str) -> DataFrame:
    """Supervised bins of a score, checked: more of the target's variance between bins than with equal widths."""
    s = scores(spark, d)
    edges = E.tree_edges(s, "p1", "y", 8)
    binned = s.select("y", E.quantile_bin("p1", [float("-inf"), *edges, float("inf")]).alias("t"), F.floor(F.col("p1") * 8).alias("w"))
    between = lambda c: binned.groupBy(c).agg(F.avg("y").alias("m"), F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * F.col("m") * F.col("m")).alias("s")).first().s
    return binned.agg(F.lit(between("t") >= between("w")).alias("informative"), F.count(F.lit(1)).alias("rows"))


_STATS = f"""WITH {CLICKS}, c AS (SELECT *, CAST(('0x' || substr(md5(CAST(event_id AS VARCHAR) || '#0'), 1, 7))::BIGINT % 3 AS INT) AS fold FROM clicks)"""


@R.add(f"{_STATS} SELECT a.event_id, count(b.event_id) AS n, round(avg(b.value), 9) AS mean, arg_max(b.value, (b.us, b.event_id)) AS last FROM c a LEFT JOIN c b ON a.user_id = b.user_id AND a.fold <> b.fold AND b.us < a.us - 86400000000 GROUP BY a.event_id")
def e7_fold_history(spark: SparkSession, d: str) -> DataFrame:
    c = clicks(spark, d).withColumn("fold", T.hashed_fold(F.col("event_id"), 3))
    out = T.fold_history(c, "user_id", "us", "event_id", "value", "fold", 3, T.DAY_US)
    return out.select("event_id", F.col("value_n").alias("n"), F.round("value_mean", 9).alias("mean"), F.col("value_last").alias("last"))


@R.add(f"WITH {CLICKS} SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1 AS so_far, round((us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id)) / 86400000000, 6) AS gap_days, count(*) OVER (PARTITION BY user_id, item_id ORDER BY us, event_id) - 1 AS seen FROM clicks")
def e16_counters(spark: SparkSession, d: str) -> DataFrame:
    out = T.running_counters(clicks(spark, d), "user_id", "item_id", ["us", "event_id"], "us")
    return out.select("event_id", "so_far", F.round("gap_days", 6).alias("gap_days"), "seen")
