"""Profiles, drift between two tables, prediction metrics, calibration and thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.numbers import finite
from millrace.session import cut


def running_counts(df: DataFrame, value: str, counts: Sequence[str]) -> DataFrame:
    """df (one row for each value) with the running sums cum_{c} of count columns in the order of value: rows are
    partitioned by ranges of the value, summed within a range, and a range adds the sums of those before it, which
    are one row for each partition."""
    rows = cut(df.repartitionByRange(F.col(value)).withColumn("__part", F.spark_partition_id()))
    per = rows.groupBy("__part").agg(*[F.sum(c).alias(c) for c in counts])
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    before = per.select("__part", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"__{c}") for c in counts])
    inside = Window.partitionBy("__part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    joined = rows.join(F.broadcast(before), "__part")
    return joined.withColumns({f"cum_{c}": F.sum(c).over(inside) + F.col(f"__{c}") for c in counts}).drop("__part", *[f"__{c}" for c in counts])


def grouped_quantiles(df: DataFrame, group: str, value: str, probs: Sequence[float]) -> DataFrame:
    """group, q: exact quantiles, between two ranks in proportion, of each group's values that are not null, by running
    counts over the distinct (group, value): no group or column is held by one task."""
    n = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("__n"))
    run = running_counts(n.withColumn("__v", F.struct(group, value)), "__v", ["__n"])
    per = run.groupBy(F.col(group).alias("__g")).agg(F.sum("__n").alias("__all"), F.min(F.col("cum___n") - F.col("__n")).alias("__base"))
    met = run.join(per, F.col(group) == F.col("__g"))
    below = F.col("cum___n") - F.col("__base")
    rank = lambda p: (F.col("__all") - 1) * F.lit(float(p))
    ends = []
    for i, p in enumerate(probs):
        ends += [F.min(F.when(below >= F.floor(rank(p)) + 1, F.col(value))).alias(f"a{i}"), F.min(F.when(below >= F.ceil(rank(p)) + 1, F.col(value))).alias(f"b{i}"), F.max(rank(p) - F.floor(rank(p))).alias(f"f{i}")]
    got = met.groupBy(group).agg(*ends)
    return got.select(group, F.array(*[(F.col(f"a{i}") + (F.col(f"b{i}") - F.col(f"a{i}")) * F.col(f"f{i}")).cast("double") for i in range(len(probs))]).alias("q"))


def quantiles(df: DataFrame, c: str | Column, probs: Sequence[float]) -> list[float]:
    """Exact quantiles of one column; none where it has no value."""
    x = F.col(c) if isinstance(c, str) else c
    row = grouped_quantiles(df.select(F.lit(0).alias("g"), x.alias("x")), "g", "x", probs).first()
    return list(row.q) if row else []


def long_form(df: DataFrame, columns: Sequence[str], *keep: str) -> DataFrame:
    """keep, feature, x: one row for each number of each row; NaN and infinities are null."""
    return df.select(*keep, F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), finite(c).alias("x")) for c in columns])).alias("v")).select(*keep, "v.*")


PROFILE_POINTS = {"p01": 0.01, "p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row for each numeric column: rows, missing, zeros, negatives, their shares, distinct, mean, std, min, max,
    bias-corrected skew and kurtosis, and percentiles; constant and near-constant (one value in over 99 %) flags."""
    long = long_form(df, columns)
    n, m, k = F.count("x").cast("double"), F.skewness("x"), F.kurtosis("x")
    stats = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("x").isNull()).alias("missing"), F.count_if(F.col("x") == 0).alias("zeros"), F.count_if(F.col("x") < 0).alias("negatives"),
        F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"),
        F.when(n > 2, m * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"), F.when(n > 3, ((n + 1) * k + 6) * (n - 1) / ((n - 2) * (n - 3))).alias("kurt"),
    )
    values = long.where("x IS NOT NULL").groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n")).groupBy("feature").agg(F.count(F.lit(1)).alias("distinct"), F.max("n").alias("most"))
    points = grouped_quantiles(long, "feature", "x", list(PROFILE_POINTS.values()))
    points = points.select("feature", *[F.col("q")[i].alias(c) for i, c in enumerate(PROFILE_POINTS)])
    out = stats.join(values, "feature", "left").join(points, "feature", "left").fillna(0, ["distinct", "most"])
    share = {f"{c}_share": F.col(c) / F.col("rows") for c in ("missing", "zeros", "negatives")}
    return out.withColumns(share | {"constant": F.col("distinct") <= 1, "near_constant": F.col("most") > 0.99 * F.col("rows")}).drop("most")


def category_profile(df: DataFrame, columns: Sequence[str], rare: int = 10) -> DataFrame:
    """feature, rows, missing, distinct, rare (values of under `rare` rows), rare_share of the rows that have them,
    top_share of the most frequent value, and entropy in bits."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    n = long.groupBy("feature", "v").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(F.col("feature").alias("f")).agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("v").isNotNull(), F.col("n"))).alias("known"))
    met, few = n.join(total, F.col("feature") == F.col("f")), F.col("v").isNotNull() & (F.col("n") < rare)
    p = F.col("n") / F.col("known")
    has = F.col("v").isNotNull()
    return met.groupBy("feature").agg(
        F.first("rows").alias("rows"), F.sum(F.when(~has, F.col("n")).otherwise(0)).alias("missing"), F.count_if(has).alias("distinct"), F.count_if(few).alias("rare"),
        F.coalesce(F.sum(F.when(few, p)), F.lit(0.0)).alias("rare_share"), F.max(F.when(has, p)).alias("top_share"), F.coalesce(F.sum(F.when(has, -p * F.log2(p))), F.lit(0.0)).alias("entropy"),
    )


def _binned(train: DataFrame, test: DataFrame, columns: Sequence[str], bins: int, outer: bool) -> DataFrame:
    """feature, bin, a, b: rows of both tables by bins at train's quantiles, all columns at once. Bins are open at
    both ends; with outer, values beyond the fitted range fall to the end bins all the same, which is one."""
    a, b = long_form(train, columns), long_form(test, columns)
    edges = grouped_quantiles(a, "feature", "x", [i / bins for i in range(1, bins)]).select(F.col("feature").alias("f"), F.array_distinct("q").alias("e"))
    both = a.withColumn("side", F.lit("a")).unionAll(b.withColumn("side", F.lit("b"))).where("x IS NOT NULL").join(F.broadcast(edges), F.col("feature") == F.col("f"))
    low = (lambda v: v < F.col("x")) if not outer else (lambda v: v <= F.col("x"))
    return both.groupBy("feature", F.size(F.filter("e", low)).alias("bin")).agg(F.count_if(F.col("side") == "a").alias("a"), F.count_if(F.col("side") == "b").alias("b"))


def stability_indices(train: DataFrame, test: DataFrame, columns: Sequence[str], bins: int = 10, eps: float = 1e-6, clipped: bool = False) -> DataFrame:
    """feature, psi of numbers between two tables. Bins at train's quantiles, right-closed and open at both ends;
    clipped: left-closed, values beyond the range in the end bins."""
    n = _binned(train, test, columns, bins, clipped)
    t = n.groupBy(F.col("feature").alias("f")).agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"))
    p, q = F.greatest(F.col("a") / F.col("ta"), F.lit(eps)), F.greatest(F.col("b") / F.col("tb"), F.lit(eps))
    return n.join(t, F.col("feature") == F.col("f")).groupBy("feature").agg(F.sum((q - p) * F.log(q / p)).alias("psi"))


def stability_index(train: DataFrame, test: DataFrame, c: str, bins: int = 10, eps: float = 1e-6) -> DataFrame:
    """psi of a number between two tables: bins at train's quantiles, open at both ends."""
    return stability_indices(train, test, [c], bins, eps).select("psi")


def drift_table(train: DataFrame, test: DataFrame, columns: Sequence[str], bins: int = 10, limit: float = 0.25) -> DataFrame:
    """feature, psi, ks, mean_shift and std_shift (test's less train's, in train's deviations), drop (psi over the
    limit) and psi_rank from 1, the greatest first, ties by name."""
    psi = stability_indices(train, test, columns, bins)
    both = long_form(train, columns).select("feature", "x", F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(long_form(test, columns).select("feature", "x", F.lit(0), F.lit(1))).where("x IS NOT NULL")
    n = both.groupBy("feature", "x").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).withColumn("v", F.struct("feature", "x"))
    run = running_counts(n, "v", ["a", "b"])
    per = run.groupBy(F.col("feature").alias("f")).agg(*[F.sum(c).alias(f"t{c}") for c in "ab"], *[F.min(F.col(f"cum_{c}") - F.col(c)).alias(f"o{c}") for c in "ab"])
    part = lambda c: (F.col(f"cum_{c}") - F.col(f"o{c}")) / F.col(f"t{c}")
    ks = run.join(F.broadcast(per), F.col("feature") == F.col("f")).groupBy("feature").agg(F.max(F.abs(part("a") - part("b"))).alias("ks"))
    side = lambda c, f: f(F.when(F.col(c) == 1, F.col("x")))
    shift = both.groupBy("feature").agg(side("a", F.avg).alias("ma"), side("b", F.avg).alias("mb"), side("a", F.stddev_samp).alias("sa"), side("b", F.stddev_samp).alias("sb"))
    shift = shift.select("feature", ((F.col("mb") - F.col("ma")) / F.col("sa")).alias("mean_shift"), ((F.col("sb") - F.col("sa")) / F.col("sa")).alias("std_shift"))
    rank = F.row_number().over(Window.orderBy(F.col("psi").desc(), "feature"))  # a row for each column
    return psi.join(ks, "feature").join(shift, "feature").withColumns({"drop": F.col("psi") > limit, "psi_rank": rank})


def ks_distance(a: DataFrame, b: DataFrame, c: str) -> DataFrame:
    """ks: the greatest difference of the two distribution functions."""
    both = a.select(finite(c).alias("x"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select(finite(c), F.lit(0), F.lit(1))).where("x IS NOT NULL")
    cum = running_counts(both.groupBy("x").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "x", ["a", "b"])
    # the totals are the greatest running sums
    totals = cum.agg(F.struct(F.max("cum_a").alias("a"), F.max("cum_b").alias("b"))).scalar()
    return cum.withColumn("t", totals).agg(F.max(F.abs(F.col("cum_a") / F.col("t.a") - F.col("cum_b") / F.col("t.b"))).alias("ks"))


def category_distances(a: DataFrame, b: DataFrame, c: str) -> DataFrame:
    """tvd, js (base 2), chi2 of the shares of categories, null one of them, and how many of b's are not in a."""
    v = F.coalesce(F.col(c).cast("string"), F.lit("\0null"))
    n = a.select(v.alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select(v, F.lit(0), F.lit(1))).groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    n = n.withColumn("t", n.agg(F.struct(F.sum("a").alias("a"), F.sum("b").alias("b"))).scalar())
    p, q = F.col("a") / F.col("t.a"), F.col("b") / F.col("t.b")
    m = (p + q) / 2
    part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    share = (F.col("a") + F.col("b")) / (F.col("t.a") + F.col("t.b"))
    chi = F.pow(F.col("a") - share * F.col("t.a"), 2) / (share * F.col("t.a")) + F.pow(F.col("b") - share * F.col("t.b"), 2) / (share * F.col("t.b"))
    return n.agg((F.sum(F.abs(p - q)) / 2).alias("tvd"), (F.sum(part(p) + part(q)) / 2).alias("js"), F.sum(chi).alias("chi2"), F.count_if((F.col("a") == 0) & (F.col("b") > 0)).alias("unseen"))


def confusion(df: DataFrame, y: str, p: str, threshold: float = 0.5) -> DataFrame:
    """accuracy, precision, recall, f1 of p > threshold; 0 where undefined."""
    t, s = F.col(y) == 1, F.col(p) > threshold
    n = df.agg(F.count_if(t & s).alias("tp"), F.count_if(~t & s).alias("fp"), F.count_if(t & ~s).alias("fn"), F.count_if(~t & ~s).alias("tn"))
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return n.select("tp", "fp", "fn", "tn", div(tp + tn, tp + fp + fn + tn).alias("accuracy"), div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def ranking_quality(df: DataFrame, y: str, p: str) -> DataFrame:
    """auc and average precision, ties grouped: aggregates by distinct score, then running sums."""
    n = df.groupBy((-F.col(p)).alias("s")).agg(F.sum(y).cast("long").alias("pos"), F.sum(1 - F.col(y)).cast("long").alias("neg"))
    c = running_counts(n, "s", ["pos", "neg"])
    auc = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)) / (F.sum("pos") * F.sum("neg"))
    ap = F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))) / F.sum("pos")
    return c.agg(auc.alias("auc"), ap.alias("ap"))


def log_loss(y: Column, p: Column, eps: float = 1e-15) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.avg(-(y * F.log(q) + (1 - y) * F.log(1 - q)))


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    e = F.col(y) - F.col(p)
    return df.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(F.abs(e) / F.greatest(F.abs(F.col(y)), F.lit(2.220446049250313e-16))).alias("mape"),
        F.sqrt(F.avg(F.pow(F.log1p(y) - F.log1p(p), 2))).alias("rmsle"), (1 - F.sum(e * e) / (F.var_pop(y) * F.count(y))).alias("r2"),
    )


def weighted_kappa(df: DataFrame, y: str, p: str) -> DataFrame:
    """Quadratic weighted kappa of rounded predictions, from the contingency table."""
    n = df.select(F.col(y).cast("long").alias("a"), F.rint(p).cast("long").alias("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    m = n.agg(F.struct(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("a")).alias("a"), F.sum(F.col("n") * F.col("b")).alias("b"), F.sum(F.col("n") * F.col("a") * F.col("a")).alias("aa"), F.sum(F.col("n") * F.col("b") * F.col("b")).alias("bb")).alias("m"))
    seen = n.agg(F.sum(F.col("n") * F.pow(F.col("a") - F.col("b"), 2))).scalar()
    # expected sum of (a - b)^2 under independence needs the moments only
    chance = F.col("m.aa") + F.col("m.bb") - 2 * F.col("m.a") * F.col("m.b") / F.col("m.n")
    return m.select((1 - seen / chance).alias("qwk"))


def calibration(df: DataFrame, y: str, p: str, bins: int = 10) -> DataFrame:
    """ece over equal-width bins of p, and brier."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    per = df.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mp"), F.avg(y).alias("my"), F.sum(F.pow(F.col(p) - F.col(y), 2)).alias("se"))
    return per.agg((F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n")).alias("ece"), (F.sum("se") / F.sum("n")).alias("brier"))


def best_threshold(df: DataFrame, y: str, p: str, steps: int = 101) -> DataFrame:
    """threshold of greatest f1 on a grid, the least among equals: one histogram over the grid, then its tails."""
    k = F.ceil(F.col(p) * (steps - 1)).cast("int")  # p > t for the grid points below
    h = df.groupBy(k.alias("k")).agg(F.sum(y).alias("pos"), F.count(F.lit(1)).alias("n"))
    total = df.agg(F.sum(y)).scalar()
    grid = df.sparkSession.range(steps).select(F.col("id").cast("int").alias("g"))
    tails = grid.join(F.broadcast(h), F.col("k") > F.col("g"), "left").groupBy("g").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("s"))
    f1 = F.coalesce(2 * F.col("tp") / (F.col("s") + total), F.lit(0.0))
    return tails.withColumn("f1", f1).agg(F.max_by(F.struct((F.col("g") / (steps - 1)).alias("threshold"), F.col("f1").alias("f1")), F.struct("f1", -F.col("g"))).alias("b")).select("b.*")


def importance_weights(df: DataFrame, p: str, cap: float = 10.0) -> DataFrame:
    """df with weight p / (1 - p), capped, of mean 1."""
    w = F.least(F.col(p) / F.greatest(1 - F.col(p), F.lit(1e-6)), F.lit(cap))
    return df.withColumn("weight", w / df.agg(F.avg(w)).scalar())


def fold_report(folds: DataFrame, key: str, fold: str) -> DataFrame:
    """rows, keys in several folds, folds, least and greatest fold size."""
    per = folds.groupBy(fold).agg(F.count(F.lit(1)).alias("n"))
    multi = folds.groupBy(key).agg(F.count_distinct(fold).alias("f")).where("f > 1").agg(F.count(F.lit(1))).scalar()
    return per.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("folds"), F.min("n").alias("least"), F.max("n").alias("most")).withColumn("overlaps", multi)


def correlations(df: DataFrame, columns: Sequence[str], ranks: bool = False) -> DataFrame:
    """a, b, r of every pair of columns: all in one aggregate pass; with ranks, Spearman's by average ranks, each
    column's ranks from running counts over its distinct values."""
    if ranks:
        for c in columns:
            n = running_counts(df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")), c, ["n"])
            r = n.select(F.col(c).alias("__v"), (F.col("cum_n") - (F.col("n") - 1) / 2).alias(f"__r_{c}"))
            df = df.join(r, F.col(c) == F.col("__v"), "left").drop("__v")
    of = (lambda c: F.col(f"__r_{c}")) if ranks else F.col
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(of(a), of(b)).alias("r")) for a, b in pairs]).alias("x"))
    return row.select(F.explode("x").alias("x")).select("x.*")


def leak_probes(df: DataFrame, columns: Sequence[str], y: str, limit: float = 0.95) -> DataFrame:
    """feature, auc of each column alone as a score of a 0/1 target (the better direction, nulls left out), and
    leak where it reaches the limit; one pass over the columns made long."""
    long = long_form(df.where(F.col(y).isNotNull()), columns, y).where("x IS NOT NULL")
    n = long.groupBy("feature", "x").agg(F.sum(y).cast("long").alias("pos"), F.sum(1 - F.col(y)).cast("long").alias("neg")).withColumn("v", F.struct("feature", "x"))
    run = running_counts(n, "v", ["pos", "neg"])
    per = run.groupBy(F.col("feature").alias("f")).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.min(F.col("cum_neg") - F.col("neg")).alias("o"))
    below = F.col("cum_neg") - F.col("o") - F.col("neg") / 2
    auc = run.join(F.broadcast(per), F.col("feature") == F.col("f")).groupBy("feature").agg((F.sum(F.col("pos") * below) / F.first(F.col("p") * F.col("n"))).alias("auc"))
    better = F.greatest("auc", 1 - F.col("auc"))
    return auc.select("feature", better.alias("auc"), (better >= limit).alias("leak"))


def domains(train: DataFrame, test: DataFrame) -> DataFrame:
    """Rows of both tables in the columns they share, with `domain`: 0 of train, 1 of test."""
    shared = [c for c in train.columns if c in test.columns]
    return train.select(*shared).withColumn("domain", F.lit(0)).unionByName(test.select(*shared).withColumn("domain", F.lit(1)))


def suspicious(drift: DataFrame, probes: DataFrame, psi: float = 0.25, auc: float = 0.7) -> DataFrame:
    """feature, psi, auc (as a score of the domain) and reason of the columns that tell the tables apart."""
    both = drift.select("feature", "psi").join(probes.select("feature", "auc"), "feature", "full").fillna(0.0)
    reason = F.concat_ws("+", F.when(F.col("psi") >= psi, "psi"), F.when(F.col("auc") >= auc, "auc"))
    return both.withColumn("reason", reason).where("reason <> ''")


def rank_agreement(runs: DataFrame, a: str, b: str, pairs: int = 20, seed: int = 0) -> DataFrame:
    """kendall (tau of sampled pairs, ties neither way) and inversions (share of pairs in opposite order) of two
    score columns of (key, a, b): each row meets `pairs` others at seeded distances in a hashed order, which are
    neighbours in a range partition, so that no two tables of all rows are joined."""
    w = Window.partitionBy("__part").orderBy("__h", "key")
    rows = cut(runs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("__h", F.md5(F.concat(F.col("key").cast("string"), F.lit(f"#{seed}")))).repartitionByRange("__h").withColumn("__part", F.spark_partition_id()))
    steps = {f"__s{k}": F.signum(F.col(a) - F.lag(a, k).over(w)) * F.signum(F.col(b) - F.lag(b, k).over(w)) for k in range(1, pairs + 1)}
    signs = rows.withColumns(steps).select(F.explode(F.array(*steps)).alias("s")).where("s IS NOT NULL")
    return signs.agg(F.avg("s").alias("kendall"), F.avg((F.col("s") < 0).cast("double")).alias("inversions"), F.count(F.lit(1)).alias("pairs"))


def grouped_average_precision(df: DataFrame, group: str, y: str, score: str, item: str, k: int) -> DataFrame:
    """map: the mean over groups with a positive of the average precision of their k best, divided by all positives."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(item))
    ranked = df.withColumn("__r", F.row_number().over(w)).withColumn("__h", F.sum(y).over(w))
    per = ranked.groupBy(group).agg(F.sum(F.when((F.col("__r") <= k) & (F.col(y) == 1), F.col("__h") / F.col("__r")).otherwise(0.0)).alias("s"), F.sum(y).alias("n"))
    return per.where("n > 0").agg(F.avg(F.col("s") / F.col("n")).alias("map"))


def top_k_accuracy(df: DataFrame, truth: str, scores: str, k: int) -> DataFrame:
    """accuracy: the share of rows whose class (from 0) is among the k best of an array of class scores, ties to the
    lower class."""
    own = F.col(scores)[F.col(truth)]
    better = F.size(F.filter(F.sequence(F.lit(0), F.size(scores) - 1), lambda i: (F.col(scores)[i] > own) | ((F.col(scores)[i] == own) & (i < F.col(truth)))))
    return df.agg(F.avg((better < k).cast("double")).alias("accuracy"))


def population_shift(a: DataFrame, b: DataFrame, c: str) -> DataFrame:
    """shift: the mean over the values of either table of the absolute difference of their shares."""
    n = a.select(F.col(c).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(b.select(F.col(c), F.lit(0), F.lit(1))).where("v IS NOT NULL").groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    t = n.agg(F.struct(F.sum("a").alias("a"), F.sum("b").alias("b"))).scalar()
    return n.withColumn("t", t).agg(F.avg(F.abs(F.col("a") / F.col("t.a") - F.col("b") / F.col("t.b"))).alias("shift"))


def key_overlap(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """common, only_a, only_b, jaccard of the distinct keys of two tables, null keys left out."""
    side = lambda df, x, y: df.select(*keys).dropna().distinct().withColumns({"a": F.lit(x), "b": F.lit(y)})
    n = side(a, 1, 0).unionByName(side(b, 0, 1)).groupBy(*keys).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    out = n.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 1)).alias("common"), F.count_if(F.col("b") == 0).alias("only_a"), F.count_if(F.col("a") == 0).alias("only_b"))
    total = F.col("common") + F.col("only_a") + F.col("only_b")
    return out.withColumn("jaccard", F.when(total > 0, F.col("common") / total).otherwise(0.0))
