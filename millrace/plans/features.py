"""Queries of encoders, profiles, drift and prediction metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import blocks as B
from millrace.operators import encoders as E
from millrace.operators import quality as Q
from millrace.operators import summaries as U
from millrace.operators import timeline as T
from millrace.plans.registry import Registry
from millrace.sources.tables import table

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql

_LINES = "rows AS (SELECT *, row_number() OVER () AS r FROM lineitem), train AS (SELECT * FROM orders WHERE o_orderkey % 5 <> 0)"
_FOLD = "CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR) || '#0'), 1, 7))::BIGINT % 5 AS INT)"
_Y = "CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END"


def r6(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


def _orders(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    y = (F.col("o_totalprice") > 250000).cast("int")
    return o.select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderpriority").alias("c"), y.alias("y"), T.hashed_fold(F.col("o_orderkey"), 5).alias("fold"))


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The part that encoders are fitted on, and all orders, which they encode."""
    o = _orders(spark, d)
    return o.where("o_orderkey % 5 <> 0"), o


@R.add("WITH s AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS sd, min(c_acctbal) AS lo, max(c_acctbal) AS hi, quantile_cont(c_acctbal, 0.5) AS q2, quantile_cont(c_acctbal, 0.25) AS q1, quantile_cont(c_acctbal, 0.75) AS q3, quantile_cont(c_acctbal, 0.01) AS a, quantile_cont(c_acctbal, 0.99) AS b FROM customer) SELECT c_custkey, round((c_acctbal - m) / sd, 6) AS standard, round((c_acctbal - lo) / (hi - lo), 6) AS minmax, round((c_acctbal - q2) / (q3 - q1), 6) AS robust, round(least(greatest(c_acctbal, a), b), 6) AS clipped, CASE WHEN c_acctbal < q1 - 0.5 * (q3 - q1) OR c_acctbal > q3 + 0.5 * (q3 - q1) THEN 1 ELSE 0 END AS outlier FROM customer, s")
def i1_numeric(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    f = E.NumericFit.of(c, ["c_acctbal"])
    x = "c_acctbal"
    return r6(c.select("c_custkey", f.standard(x).alias("standard"), f.minmax(x).alias("minmax"), f.robust(x).alias("robust"), f.clipped(x).alias("clipped"), f.outlier(x, 0.5).alias("outlier")), "standard", "minmax", "robust", "clipped")


@R.add("WITH e AS (SELECT quantile_cont(c_acctbal, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) AS q, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer) SELECT c_custkey, CAST(len(list_filter(q[2:5], lambda v: v < c_acctbal)) AS INT) AS q_bin, CAST(least(greatest(ceil((c_acctbal - lo) / ((hi - lo) / 8)) - 1, 0), 7) AS INT) AS w_bin FROM customer, e")
def i5_binned(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    f = E.NumericFit.of(c, ["c_acctbal"])
    return c.select("c_custkey", E.quantile_bin("c_acctbal", E.quantile_edges(c, "c_acctbal", 5)).alias("q_bin"), f.equal_width("c_acctbal", 8).alias("w_bin"))


_FREQ = f"WITH {_LINES}, n AS (SELECT o_custkey, count(*) AS n FROM train GROUP BY 1), p AS (SELECT coalesce(sum(n), 0) AS p FROM n WHERE n < 5)"


@R.add(f"{_FREQ} SELECT o_orderkey, CAST(coalesce(CASE WHEN n < 5 THEN p ELSE n END, 0) AS BIGINT) AS n, round(coalesce(CASE WHEN n < 5 THEN p ELSE n END, 0) / (SELECT count(*) FROM train), 9) AS share FROM orders LEFT JOIN n USING (o_custkey), p")
def i15_frequency(spark: SparkSession, d: str) -> DataFrame:
    train, every = _parts(spark, d)
    out = E.frequency_encoded(every, train, "o_custkey", 5)
    return out.select("o_orderkey", F.col("o_custkey_count").alias("n"), F.round("o_custkey_share", 9).alias("share"))


@R.add(f"WITH {_LINES}, s AS (SELECT o_custkey, sum({_Y}) AS s, count(*) AS n FROM train GROUP BY 1), p AS (SELECT avg({_Y}) AS p FROM train) SELECT o_orderkey, round((coalesce(s, 0) + p * 20) / (coalesce(n, 0) + 20), 6) AS te FROM orders LEFT JOIN s USING (o_custkey), p")
def i16_target(spark: SparkSession, d: str) -> DataFrame:
    train, every = _parts(spark, d)
    return E.target_encoded(every, train, "o_custkey", "y").select("o_orderkey", F.round("o_custkey_te", 6).alias("te"))


@R.add(f"WITH o AS (SELECT o_orderkey, o_custkey, {_Y} AS y, {_FOLD} AS fold FROM orders), a AS (SELECT o_custkey, fold, sum(y) AS s, count(*) AS n FROM o GROUP BY ALL), w AS (SELECT o_custkey, sum(s) AS s, sum(n) AS n FROM a GROUP BY 1), f AS (SELECT fold, sum(s) AS s, sum(n) AS n FROM a GROUP BY 1), t AS (SELECT sum(s) AS s, sum(n) AS n FROM a) SELECT o_orderkey, round((w.s - a.s + (t.s - f.s) / (t.n - f.n) * 10) / (w.n - a.n + 10), 6) AS te FROM o JOIN a USING (o_custkey, fold) JOIN w USING (o_custkey) JOIN f USING (fold), t")
def i18_target_by_folds(spark: SparkSession, d: str) -> DataFrame:
    return E.target_encoded_by_folds(_orders(spark, d), "o_custkey", "y", "fold").select("o_orderkey", F.round("o_custkey_te", 6).alias("te"))


@R.add(f"WITH {_LINES}, g AS (SELECT o_orderpriority AS c, sum({_Y}) AS p, sum(1 - {_Y}) AS q FROM train GROUP BY 1), t AS (SELECT sum(p) AS p, sum(q) AS q FROM g) SELECT o_orderkey, round(ln(((g.p + 1e-6) / t.p) / ((g.q + 1e-6) / t.q)), 6) AS woe FROM orders JOIN g ON g.c = o_orderpriority, t")
def i17_woe(spark: SparkSession, d: str) -> DataFrame:
    train, every = _parts(spark, d)
    return E.woe_encoded(every, train, "c", "y").select("o_orderkey", F.round("c_woe", 6).alias("woe"))


@R.add("WITH t AS (SELECT list(k ORDER BY n DESC, k) AS k FROM (SELECT c_mktsegment AS k, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, k LIMIT 2)) SELECT c_custkey, CASE WHEN c_mktsegment = k[1] THEN 1 ELSE 0 END AS first, CASE WHEN c_mktsegment = k[2] THEN 1 ELSE 0 END AS second, CASE WHEN c_mktsegment IN (k[1], k[2]) THEN 0 ELSE 1 END AS other, CASE WHEN c_mktsegment IS NULL THEN 1 ELSE 0 END AS missing FROM customer, t")
def i10_one_hot(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    top = E.top_categories(c, "c_mktsegment", 2)
    hot = E.one_hot("c_mktsegment", top)
    return c.select("c_custkey", hot[f"c_mktsegment_{top[0]}"].alias("first"), hot[f"c_mktsegment_{top[1]}"].alias("second"), hot["c_mktsegment_other"].alias("other"), hot["c_mktsegment_null"].alias("missing"))


@R.add("WITH k AS (SELECT category FROM tiny_items WHERE category IS NOT NULL GROUP BY 1 HAVING count(*) >= 20) SELECT CASE WHEN category IS NULL OR category IN (SELECT category FROM k) THEN category ELSE 'Other' END AS category, count(*) AS n FROM tiny_items GROUP BY 1")
def i14_rare(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "tiny_items")
    return E.rare_combined(t, t, "category", 20).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@R.add("SELECT l_partkey, round(avg(l_quantity), 6) AS mean, round(stddev_samp(l_quantity), 6) AS std, median(l_quantity) AS median, min(l_quantity) AS min, max(l_quantity) AS max, sum(l_quantity) AS sum, count(l_quantity) AS n, count(DISTINCT l_quantity) AS distinct, CASE WHEN count(*) > 2 THEN round(skewness(l_quantity), 6) END AS skew, CASE WHEN count(*) > 3 THEN round(kurtosis(l_quantity), 5) END AS kurt FROM lineitem GROUP BY 1")
def d3_group_stats(spark: SparkSession, d: str) -> DataFrame:
    return r6(r6(E.group_stats(table(spark, d, "lineitem"), ["l_partkey"], "l_quantity"), "mean", "std", "skew"), "kurt", digits=5)


@R.add("SELECT c_custkey, c_nationkey + c_acctbal AS a, c_nationkey * c_acctbal AS m, round(c_nationkey / (c_acctbal + 1e-6), 6) AS q, round(c_acctbal - avg(c_acctbal) OVER w, 6) AS dev FROM customer WINDOW w AS (PARTITION BY c_mktsegment)")
def i20_interactions(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    x = E.number_pairs(["c_nationkey", "c_acctbal"])
    out = E.deviation(c, "c_mktsegment", "c_acctbal")
    return out.select("c_custkey", x["c_nationkey_add_c_acctbal"].alias("a"), x["c_nationkey_mul_c_acctbal"].alias("m"), F.round(x["c_nationkey_div_c_acctbal"], 6).alias("q"), F.round("c_acctbal_sub_c_mktsegment", 6).alias("dev"))


@R.add("SELECT l_orderkey, CAST(('0x' || substr(md5(CAST(l_suppkey AS VARCHAR)), 1, 7))::BIGINT % 16 AS INT) AS bucket, round(sum(l_quantity), 6) AS value FROM lineitem GROUP BY ALL")
def i24_hashed_cross(spark: SparkSession, d: str) -> DataFrame:
    return r6(E.hashed_cross(table(spark, d, "lineitem"), "l_orderkey", "l_suppkey", "l_quantity", 16), "value")


_GEO = "g AS (SELECT c_custkey AS k, 45 + (c_custkey * 7919 % 1000) / 1000 AS la, 7 + (c_custkey * 104729 % 1000) / 1000 AS lo FROM customer)"


@R.add(f"WITH {_GEO} SELECT a.k, count(b.k) AS n FROM g a LEFT JOIN g b ON a.k <> b.k AND abs(a.la - b.la) < 0.1 AND 2 * 6371000 * asin(sqrt(pow(sin(radians(b.la - a.la) / 2), 2) + cos(radians(a.la)) * cos(radians(b.la)) * pow(sin(radians(b.lo - a.lo) / 2), 2))) <= 5000 GROUP BY a.k")
def c19_radius(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    g = table(spark, d, "customer").select(k.alias("k"), (45 + (k * 7919 % 1000) / 1000).alias("la"), (7 + (k * 104729 % 1000) / 1000).alias("lo"))
    return E.radius_neighbours(g, "k", "la", "lo", 5000)


_DRIFT = "a AS (SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), b AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')"


def _drift(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders")
    return o.where("o_orderdate < TIMESTAMP '1998-01-01'"), o.where("o_orderdate >= TIMESTAMP '1998-01-01'")


@R.add(f"WITH {_DRIFT}, e AS (SELECT quantile_cont(o_totalprice, [0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]) AS q FROM a), n AS (SELECT len(list_filter(q, lambda v: v < o_totalprice)) AS bin, s FROM (SELECT o_totalprice, 1 AS s FROM a UNION ALL SELECT o_totalprice, 0 FROM b), e), c AS (SELECT bin, greatest(sum(s) / (SELECT count(*) FROM a), 1e-6) AS p, greatest(sum(1 - s) / (SELECT count(*) FROM b), 1e-6) AS q FROM n GROUP BY 1) SELECT round(sum((q - p) * ln(q / p)), 8) AS psi FROM c")
def m1_psi(spark: SparkSession, d: str) -> DataFrame:
    return r6(Q.stability_index(*_drift(spark, d), "o_totalprice"), "psi", digits=8)


@R.add(f"WITH {_DRIFT}, x AS (SELECT o_totalprice AS x, 1 AS s FROM a UNION ALL SELECT o_totalprice, 0 FROM b), n AS (SELECT x, sum(s) AS a, sum(1 - s) AS b FROM x GROUP BY 1), c AS (SELECT sum(a) OVER (ORDER BY x) / (SELECT count(*) FROM a) AS fa, sum(b) OVER (ORDER BY x) / (SELECT count(*) FROM b) AS fb FROM n) SELECT round(max(abs(fa - fb)), 8) AS ks FROM c")
def m3_ks(spark: SparkSession, d: str) -> DataFrame:
    return r6(Q.ks_distance(*_drift(spark, d), "o_totalprice"), "ks", digits=8)


@R.add(f"WITH {_DRIFT}, n AS (SELECT v, sum(s) AS a, sum(1 - s) AS b FROM (SELECT o_custkey AS v, 1 AS s FROM a UNION ALL SELECT o_custkey, 0 FROM b) GROUP BY 1), t AS (SELECT sum(a) AS ta, sum(b) AS tb FROM n), p AS (SELECT *, a / ta AS p, b / tb AS q, (a / ta + b / tb) / 2 AS m, (a + b) / (ta + tb) AS s FROM n, t) SELECT round(sum(abs(p - q)) / 2, 6) AS tvd, round(sum(CASE WHEN p > 0 THEN p * log2(p / m) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / m) ELSE 0 END) / 2, 6) AS js, round(sum(pow(a - s * ta, 2) / (s * ta) + pow(b - s * tb, 2) / (s * tb)), 4) AS chi2, count(*) FILTER (a = 0 AND b > 0) AS unseen FROM p")
def m5_categories(spark: SparkSession, d: str) -> DataFrame:
    return r6(r6(Q.category_distances(*_drift(spark, d), "o_custkey"), "tvd", "js"), "chi2", digits=4)


@R.add("WITH x AS (SELECT 'l_quantity' AS feature, l_quantity AS x FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem) SELECT feature, count(*) AS rows, count(*) FILTER (x IS NULL) AS missing, count(*) FILTER (x = 0) AS zeros, count(*) FILTER (x < 0) AS negatives, count(DISTINCT x) AS distinct, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, round(quantile_cont(x, 0.01), 6) AS p01, round(median(x), 6) AS p50, round(quantile_cont(x, 0.99), 6) AS p99 FROM x GROUP BY 1")
def m8_profile(spark: SparkSession, d: str) -> DataFrame:
    p = Q.profile(table(spark, d, "lineitem"), ["l_quantity", "l_tax"])
    p = p.select("feature", "rows", "missing", "zeros", "negatives", "distinct", "mean", "std", "p01", "p50", "p99")
    return r6(r6(p, "p01", "p50", "p99"), "mean", "std", digits=4)


_P = "p AS (SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS y, (o_custkey % 97 + CASE WHEN o_totalprice > 250000 THEN 30 ELSE 0 END) / 130 AS p FROM orders)"


def _preds(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d)
    return o.select("o_orderkey", "y", ((F.col("o_custkey") % 97 + 30 * F.col("y")) / 130).alias("p"))


@R.add(f"WITH {_P}, c AS (SELECT count(*) FILTER (y = 1 AND p > 0.5) AS tp, count(*) FILTER (y = 0 AND p > 0.5) AS fp, count(*) FILTER (y = 1 AND p <= 0.5) AS fn, count(*) FILTER (y = 0 AND p <= 0.5) AS tn FROM p) SELECT *, round((tp + tn) / (tp + fp + fn + tn), 8) AS accuracy, round(tp / (tp + fp), 8) AS precision, round(tp / (tp + fn), 8) AS recall, round(2 * tp / (2 * tp + fp + fn), 8) AS f1 FROM c")
def l19_confusion(spark: SparkSession, d: str) -> DataFrame:
    return r6(Q.confusion(_preds(spark, d), "y", "p"), "accuracy", "precision", "recall", "f1", digits=8)


@R.add(f"WITH {_P}, n AS (SELECT p, sum(y) AS pos, sum(1 - y) AS neg FROM p GROUP BY 1), c AS (SELECT *, sum(pos) OVER (ORDER BY p DESC) AS cp, sum(neg) OVER (ORDER BY p DESC) AS cn FROM n) SELECT round(sum(neg * (cp - pos / 2)) / (sum(pos) * sum(neg)), 8) AS auc, round(sum(pos * cp / (cp + cn)) / sum(pos), 8) AS ap FROM c")
def l20_auc_ap(spark: SparkSession, d: str) -> DataFrame:
    return r6(Q.ranking_quality(_preds(spark, d), "y", "p"), "auc", "ap", digits=8)


@R.add("WITH x AS (SELECT l_extendedprice AS y, l_quantity * 1000 AS p FROM lineitem) SELECT round(sqrt(avg(pow(y - p, 2))), 4) AS rmse, round(avg(abs(y - p)), 4) AS mae, round(avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16)), 6) AS mape, round(sqrt(avg(pow(ln(1 + y) - ln(1 + p), 2))), 6) AS rmsle, round(1 - sum(pow(y - p, 2)) / (var_pop(y) * count(y)), 6) AS r2 FROM x")
def l22_regression(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select(F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1000).alias("p"))
    return r6(r6(Q.regression_metrics(x, "y", "p"), "mape", "rmsle", "r2"), "rmse", "mae", digits=4)


@R.add("WITH x AS (SELECT l_linenumber AS a, CAST(round_even(l_quantity / 8, 0) AS BIGINT) AS b FROM lineitem), n AS (SELECT a, b, count(*) AS n FROM x GROUP BY ALL), ra AS (SELECT a, sum(n) AS n FROM n GROUP BY 1), rb AS (SELECT b, sum(n) AS n FROM n GROUP BY 1), e AS (SELECT sum(ra.n * rb.n * pow(a - b, 2)) / (SELECT sum(n) FROM n) AS e FROM ra, rb) SELECT round(1 - sum(n * pow(a - b, 2)) / any_value(e), 8) AS qwk FROM n, e")
def l23_kappa(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem").select(F.col("l_linenumber").alias("a"), (F.col("l_quantity") / 8).alias("b"))
    return r6(Q.weighted_kappa(x, "a", "b"), "qwk", digits=8)


@R.add(f"WITH {_P}, b AS (SELECT least(floor(p * 10), 9) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS my, sum(pow(p - y, 2)) AS se FROM p GROUP BY 1) SELECT round(sum(n * abs(mp - my)) / sum(n), 8) AS ece, round(sum(se) / sum(n), 8) AS brier FROM b")
def m22_calibration(spark: SparkSession, d: str) -> DataFrame:
    return r6(Q.calibration(_preds(spark, d), "y", "p"), "ece", "brier", digits=8)


@R.add(f"WITH {_P}, g AS (SELECT unnest(range(101)) AS g), k AS (SELECT ceil(p * 100) AS k, y FROM p), s AS (SELECT g, 2 * coalesce(sum(y), 0) / (count(k) + (SELECT sum(y) FROM p)) AS f1 FROM g LEFT JOIN k ON k > g GROUP BY g) SELECT g / 100 AS threshold, round(f1, 8) AS f1 FROM s ORDER BY s.f1 DESC, g LIMIT 1")
def n14_threshold(spark: SparkSession, d: str) -> DataFrame:
    return r6(Q.best_threshold(_preds(spark, d), "y", "p"), "f1", digits=8)


@R.add(f"WITH {_P}, w AS (SELECT o_orderkey, least(p / greatest(1 - p, 1e-6), 2) AS w FROM p) SELECT o_orderkey, round(w / avg(w) OVER (), 6) AS weight FROM w")
def m17_weights(spark: SparkSession, d: str) -> DataFrame:
    return r6(Q.importance_weights(_preds(spark, d), "p", 2.0).select("o_orderkey", "weight"), "weight")


@R.add(f"WITH f AS (SELECT o_orderkey, {_FOLD} AS fold FROM orders), n AS (SELECT fold, count(*) AS n FROM f GROUP BY 1) SELECT sum(n)::BIGINT AS rows, count(*) AS folds, min(n) AS least, max(n) AS most, 0::BIGINT AS overlaps FROM n")
def m14_folds(spark: SparkSession, d: str) -> DataFrame:
    return Q.fold_report(_orders(spark, d), "o_orderkey", "fold")


_RANK = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2"


@R.add(f"WITH r AS (SELECT {_RANK('l_quantity')} AS q, {_RANK('l_extendedprice')} AS e, {_RANK('l_tax')} AS t FROM lineitem) SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(q, e), 6) AS r FROM r UNION ALL SELECT 'l_quantity', 'l_tax', round(corr(q, t), 6) FROM r UNION ALL SELECT 'l_extendedprice', 'l_tax', round(corr(e, t), 6) FROM r")
def m11_spearman(spark: SparkSession, d: str) -> DataFrame:
    return r6(Q.correlations(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], ranks=True), "r")


@R.add("SELECT o_orderpriority AS value, count(*) AS n, round(count(*) / (SELECT count(*) FROM orders), 9) AS share FROM orders GROUP BY 1")
def d2_value_counts(spark: SparkSession, d: str) -> DataFrame:
    return r6(E.value_counts(_orders(spark, d), "c"), "share", digits=9)


@R.add("WITH n AS (SELECT *, count(*) OVER (PARTITION BY category, brand) AS n FROM tiny_items) SELECT item_id, category, brand, CAST(n AS BIGINT) AS copies FROM n WHERE n > 1")
def g3_repeated(spark: SparkSession, d: str) -> DataFrame:
    """Every row of which category and brand are repeated, with how often they are."""
    return U.repeated_rows(table(spark, d, "tiny_items").select("item_id", "category", "brand"), ["category", "brand"])


@R.add("WITH k AS (SELECT *, row_number() OVER (PARTITION BY query_id, item_id ORDER BY ts_query NULLS LAST, label NULLS LAST) AS k FROM tiny_pairs_train) SELECT query_id, item_id, epoch_us(ts_query) AS us, label FROM k WHERE k = 1")
def g2_distinct_rows(spark: SparkSession, d: str) -> DataFrame:
    """One row for each pair: the earliest, then the least label."""
    out = U.first_rows(table(spark, d, "tiny_pairs_train"), ["query_id", "item_id"], [F.col("ts_query").asc_nulls_last(), F.col("label").asc_nulls_last()])
    return out.select("query_id", "item_id", F.unix_micros("ts_query").alias("us"), "label")


@R.add("WITH a AS (SELECT DISTINCT item_id FROM tiny_interactions WHERE item_id IS NOT NULL), b AS (SELECT DISTINCT item_id FROM tiny_items WHERE item_id IS NOT NULL) SELECT (SELECT count(*) FROM a) AS seen, (SELECT count(*) FROM a SEMI JOIN b USING (item_id)) AS known, (SELECT count(*) FROM a ANTI JOIN b USING (item_id)) AS cold")
def c12_cold_items(spark: SparkSession, d: str) -> DataFrame:
    return U.cold_report(table(spark, d, "tiny_interactions"), table(spark, d, "tiny_items"), "item_id")


_KEYS = "k AS (SELECT DISTINCT 'predictions' AS run, query_id, item_id FROM tiny_predictions UNION ALL SELECT DISTINCT 'pairs', query_id, item_id FROM tiny_pairs_train UNION ALL SELECT DISTINCT 'ranker', query_id, item_id FROM ranker_x_train), r AS (SELECT DISTINCT run FROM k)"


@R.add(f"WITH {_KEYS} SELECT a.run AS a, b.run AS b, (SELECT count(*) FROM k x JOIN k y ON x.query_id = y.query_id AND x.item_id = y.item_id WHERE x.run = a.run AND y.run = b.run) AS common FROM r a JOIN r b ON a.run < b.run")
def c21_overlap(spark: SparkSession, d: str) -> DataFrame:
    of = lambda run, name: table(spark, d, name).select(F.lit(run).alias("run"), "query_id", "item_id")
    runs = of("predictions", "tiny_predictions").unionByName(of("pairs", "tiny_pairs_train")).unionByName(of("ranker", "ranker_x_train"))
    return U.run_overlaps(runs, ["query_id", "item_id"])


@R.add("WITH f AS (SELECT query_id, item_id, max(CASE WHEN isnan(f1) OR isinf(f1) THEN NULL ELSE f1 END) AS f1 FROM ranker_x_train GROUP BY ALL), p AS (SELECT query_id, item_id, max(label) AS label FROM tiny_pairs_train GROUP BY ALL) SELECT p.query_id, p.item_id, coalesce(p.label, 0) AS label, CAST(coalesce(f1, 0) AS FLOAT) AS f1 FROM p LEFT JOIN f ON f.query_id = p.query_id AND f.item_id = p.item_id")
def c1_feature_join(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "ranker_x_train").groupBy("query_id", "item_id").agg(F.max(E.finite("f1")).alias("f1"))
    p = table(spark, d, "tiny_pairs_train").groupBy("query_id", "item_id").agg(F.max("label").alias("label"))
    return B.plain_types(B.joined_blocks([p, f]))


@R.add("WITH x AS (SELECT l_orderkey, date_trunc('week', l_shipdate) AS w, l_extendedprice AS y FROM lineitem) SELECT strftime(w, '%Y-%m-%d') AS week, count(*) AS n, round(avg(y), 3) AS mean, round(median(y), 3) AS median FROM x GROUP BY w")
def d18_by_week(spark: SparkSession, d: str) -> DataFrame:
    week = F.date_format(F.date_trunc("week", "l_shipdate"), "yyyy-MM-dd").alias("week")
    return r6(U.target_by(table(spark, d, "lineitem"), [week], "l_extendedprice").drop("std"), "mean", "median", digits=3)


@R.add("SELECT c_custkey, CASE WHEN c_acctbal > -1 THEN round(ln(1 + c_acctbal), 9) END AS log1p, round(sqrt(greatest(c_acctbal, 0)), 9) AS root, round(1 / (1 + exp(-c_acctbal / 5000)), 9) AS sigmoid, c_mktsegment || '_' || CAST(c_nationkey AS VARCHAR) AS crossed FROM customer")
def h1_scalar_functions(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("c_acctbal")
    return table(spark, d, "customer").select(
        "c_custkey", F.when(x > -1, F.round(F.log1p(x), 9)).alias("log1p"), F.round(F.sqrt(F.greatest(x, F.lit(0))), 9).alias("root"), F.round(1 / (1 + F.exp(-x / 5000)), 9).alias("sigmoid"),
        F.concat_ws("_", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("crossed"),
    )


@R.add(f"WITH r AS (SELECT o_orderkey, {_RANK('o_totalprice')} AS k, count(*) OVER () AS n FROM orders) SELECT o_orderkey, round(k / n, 9) AS pct FROM r")
def e11_percent_rank(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    n = Q.running_counts(o.groupBy("o_totalprice").agg(F.count(F.lit(1)).alias("k")), "o_totalprice", ["k"])
    total = o.agg(F.count(F.lit(1))).scalar()
    return o.join(n, "o_totalprice").select("o_orderkey", F.round((F.col("cum_k") - (F.col("k") - 1) / 2) / total, 9).alias("pct"))
