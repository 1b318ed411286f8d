"""Reports over splits, lists, candidates, folds and columns, and small derived columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import quality as Q
from millrace.operators.encoders import grid_cell
from millrace.operators.quality import grouped_quantiles, long_form

DAY_US = 86_400_000_000


def split_report(df: DataFrame, split: str) -> DataFrame:
    """split (null too), n and share of the rows."""
    n = df.groupBy(split).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / df.agg(F.count(F.lit(1))).scalar())


def query_lists(df: DataFrame, query: str, item: str, rank: str, k: int) -> DataFrame:
    """query, items: the items of rank 1 to k in order, as one array of at most k."""
    top = df.where(F.col(rank) <= k).groupBy(query).agg(F.array_sort(F.collect_list(F.struct(rank, item))).alias("x"))
    return top.select(query, F.transform("x", lambda s: s[item]).alias("items"))


def distinct_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, distinct: different values of each column, null none of them, in one aggregation of the columns made
    long, so that no value set is held whole."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")).select("x.*")
    found = long.where("v IS NOT NULL").distinct().groupBy("feature").agg(F.count(F.lit(1)).alias("distinct"))
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    return names.join(found, "feature", "left").fillna(0, ["distinct"])


def daily_mean(df: DataFrame, ts: str, value: str, days: int = 30) -> DataFrame:
    """day, n, mean of the last `days` calendar days up to the latest moment that have rows."""
    per = df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias("day")).agg(F.count(value).alias("n"), F.avg(value).alias("mean"))
    return per.where(F.col("day") > F.date_sub(per.agg(F.max("day")).scalar(), days))


def target_by(df: DataFrame, keys: Sequence[Column | str], y: str) -> DataFrame:
    """The keys with n, mean, median and std (sample) of a target."""
    named = df.select(F.struct(*keys).alias("__key"), F.col(y).cast("double").alias("__y"))
    stats = named.groupBy("__key").agg(F.count("__y").alias("n"), F.avg("__y").alias("mean"), F.stddev_samp("__y").alias("std"))
    middle = grouped_quantiles(named, "__key", "__y", [0.5]).select(F.col("__key").alias("__k"), F.col("q")[0].alias("median"))
    return stats.join(middle, F.col("__key").eqNullSafe(F.col("__k")), "left").select("__key.*", "n", "mean", "median", "std")


def grid_counts(df: DataFrame, lat: str, lon: str, step_m: float) -> DataFrame:
    """df with cell_n, the rows of its grid cell, and cell_share of all rows with a place; null without a place."""
    row, column = grid_cell(F.col(lat), F.col(lon), step_m)
    rows = df.withColumns({"__r": row, "__c": column})
    cells = rows.where("__r IS NOT NULL AND __c IS NOT NULL").groupBy(F.col("__r").alias("__r2"), F.col("__c").alias("__c2")).agg(F.count(F.lit(1)).alias("cell_n"))
    met = rows.join(cells, (F.col("__r") == F.col("__r2")) & (F.col("__c") == F.col("__c2")), "left")
    return met.withColumn("cell_share", F.col("cell_n") / cells.agg(F.sum("cell_n")).scalar()).drop("__r", "__c", "__r2", "__c2")


def place_report(df: DataFrame, lat: str, lon: str, step_m: float) -> DataFrame:
    """rows, missing, invalid (outside the globe), repeated (rows beyond the first of one place) and cells."""
    ok = (F.abs(F.col(lat)) <= 90) & (F.abs(F.col(lon)) <= 180)
    n = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(lat).isNull() | F.col(lon).isNull()).alias("missing"), F.count_if(~ok).alias("invalid"))
    valid = df.where(ok)
    places = valid.groupBy(lat, lon).agg(F.count(F.lit(1)).alias("k")).agg(F.coalesce(F.sum(F.col("k") - 1), F.lit(0)).alias("repeated"))
    row, column = grid_cell(F.col(lat), F.col(lon), step_m)
    cells = valid.select(row.alias("r"), column.alias("c")).distinct().agg(F.count(F.lit(1)).alias("cells"))
    return n.crossJoin(places).crossJoin(cells)  # one row each


def source_attribution(candidates: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """source, hits: of the true (query_id, item_id) pairs, by the source that has them at the best rank up to k, ties by
    name; the source null counts the misses."""
    top = candidates.where(F.col("rank") <= k).groupBy("query_id", "item_id").agg(F.min(F.struct("rank", "source")).alias("x"))
    met = truth.select("query_id", "item_id").distinct().join(top.select("query_id", "item_id", "x.source"), ["query_id", "item_id"], "left")
    return met.groupBy("source").agg(F.count(F.lit(1)).alias("hits"))


VECTOR_STATS: Mapping[str, Callable[[Column], Column]] = {
    "mean": F.avg, "max": F.max, "min": F.min,
    # generalised mean of power 3, of absolute values
    "gem": lambda x: F.pow(F.avg(F.pow(F.abs(x), F.lit(3.0))), F.lit(1 / 3)),
}


def vector_aggregate(df: DataFrame, key: str, vector: str, how: str) -> DataFrame:
    """key, vector: element-wise mean, max, min or gem of a key's vectors. Vectors are made long, so that a key of any
    number of vectors is summed in the map tasks first."""
    long = df.where(F.col(key).isNotNull()).select(key, F.posexplode(F.col(vector).cast("array<double>")).alias("i", "x"))
    per = long.groupBy(key, "i").agg(VECTOR_STATS[how](F.col("x")).alias("x"))
    return per.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vector))


def _of(metric: str) -> Callable[[DataFrame, str, str], DataFrame]:
    found = {"accuracy": Q.confusion, "f1": Q.confusion, "precision": Q.confusion, "recall": Q.confusion, "auc": Q.ranking_quality, "ap": Q.ranking_quality, "qwk": Q.weighted_kappa} | {m: Q.regression_metrics for m in ("rmse", "mae", "mape", "rmsle", "r2")}
    if metric not in found:
        raise ValueError(f"unknown metric {metric!r}")
    return found[metric]


GREATER_IS_BETTER = {"accuracy", "f1", "precision", "recall", "auc", "ap", "qwk", "r2"}


def scorer(metric: str) -> tuple[Callable[[DataFrame, str, str], float], bool]:
    """(score of a table with target and prediction columns, whether greater is better) of a metric by name."""
    make = _of(metric)
    return (lambda df, y, p: make(df, y, p).first()[metric]), metric in GREATER_IS_BETTER


def scores_by_fold(df: DataFrame, y: str, p: str, fold: str, metric: str) -> list[tuple[object, float]]:
    """The metric of each fold, in the order of the folds, which are few."""
    make, _ = scorer(metric)
    names = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    return [(k, make(df.where(F.col(fold).eqNullSafe(F.lit(k))), y, p)) for k in names]


def best_runs(scores: Mapping[str, float], k: int, metric: str) -> list[str]:
    """Names of the k runs of the best scores, ties by name."""
    sign = -1 if metric in GREATER_IS_BETTER else 1
    return sorted(scores, key=lambda n: (sign * scores[n], n))[:k]


def baselines(df: DataFrame, y: str) -> DataFrame:
    """mae of the mean and accuracy of the most frequent value as the only prediction."""
    mean = df.agg(F.avg(y)).scalar()
    top = df.groupBy(y).agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") / F.sum("n")).alias("majority_accuracy"))
    return df.withColumn("__m", mean).agg(F.avg(F.abs(F.col(y) - F.col("__m"))).alias("mean_mae")).crossJoin(top)  # one row each


def outlier_tips(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """feature, low, high (quartiles less and plus k times their distance), outside, share."""
    long = long_form(df, columns)
    q = grouped_quantiles(long, "feature", "x", [0.25, 0.75]).select(F.col("feature").alias("f"), F.col("q")[0].alias("a"), F.col("q")[1].alias("b"))
    q = q.select("f", (F.col("a") - k * (F.col("b") - F.col("a"))).alias("low"), (F.col("b") + k * (F.col("b") - F.col("a"))).alias("high"))
    met = long.where("x IS NOT NULL").join(F.broadcast(q), F.col("feature") == F.col("f"))
    return met.groupBy("feature", "low", "high").agg(F.count_if((F.col("x") < F.col("low")) | (F.col("x") > F.col("high"))).alias("outside"), F.count(F.lit(1)).alias("n")).select("feature", "low", "high", "outside", (F.col("outside") / F.col("n")).alias("share"))


def sparse_profile(rows: DataFrame, columns: int) -> DataFrame:
    """rows, nnz, density, and quartiles of the entries of a row, of (indices, values) rows of so many columns."""
    n = rows.select(F.size("indices").alias("n"))
    q = Q.quantiles(n, "n", [0.25, 0.5, 0.75])
    out = n.agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("nnz"))
    return out.withColumns({"density": F.col("nnz") / (F.col("rows") * columns)} | {c: F.lit(float(x)) for c, x in zip(("p25", "p50", "p75"), q or [0.0] * 3)})


def set_jaccard(features: DataFrame, run: str, feature: str) -> DataFrame:
    """a, b, jaccard of the feature sets of every two runs (a < b)."""
    own = features.select(run, feature).dropna().distinct()
    size = own.groupBy(F.col(run).alias("r")).agg(F.count(F.lit(1)).alias("n"))
    common = own.select(F.col(run).alias("a"), feature).join(own.select(F.col(run).alias("b"), feature), feature).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    pairs = size.select(F.col("r").alias("a"), F.col("n").alias("na")).join(size.select(F.col("r").alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b"))  # a row for each run
    met = pairs.join(common, ["a", "b"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return met.select("a", "b", (F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("jaccard"))


def repeated_columns(df: DataFrame) -> list[list[str]]:
    """Groups of columns that hold the same values in all rows: by two sums of hashes over the rows' values, in one
    pass. Numbers and texts of equal spelling are equal; nulls are values."""
    h = lambda c, s: F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("\0null")), F.xxhash64(*df.columns), F.lit(s))
    sums = [F.struct(F.lit(c).alias("c"), F.sum(h(c, 1).cast("decimal(20,0)")).alias("a"), F.sum(h(c, 2).cast("decimal(20,0)")).alias("b")) for c in df.columns]
    groups: dict[tuple, list[str]] = {}
    for r in df.agg(F.array(*sums).alias("x")).first().x:
        groups.setdefault((r.a, r.b), []).append(r.c)
    return [g for g in groups.values() if len(g) > 1]


def column_kinds(df: DataFrame, few: int = 50) -> dict[str, str]:
    """num, cat, text, time or other for each column: texts of at most `few` different values are categories."""
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    n = {r.feature: r.distinct for r in distinct_counts(df, texts).collect()} if texts else {}  # a row for each column
    kind = lambda f: "num" if isinstance(f.dataType, T.NumericType) else "time" if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else ("cat" if n[f.name] <= few else "text") if f.name in n else "other"
    return {f.name: kind(f) for f in df.schema}


def unparsed_share(df: DataFrame, raw: str, parsed: str) -> float:
    """Share of the rows with a raw value that has no parsed one; 0 of none."""
    r = df.agg(F.count(raw).alias("n"), F.count_if(F.col(raw).isNotNull() & F.col(parsed).isNull()).alias("bad")).first()
    return r.bad / r.n if r.n else 0.0


def span(later: Column, earlier: Column, unit: str = "D") -> Column:
    """Fractional days (D), hours (h), minutes (m) or seconds (s) between two moments."""
    seconds = {"D": 86_400, "h": 3600, "m": 60, "s": 1}[unit]
    return (F.unix_micros(later) - F.unix_micros(earlier)) / (seconds * 1_000_000)


def embargo_us(text: str) -> int:
    """Microseconds of a span such as 3d, 12h, 30m, 15s or a sum of these."""
    if not re.fullmatch(r"(\s*\d+\s*[dhms])+\s*", text):
        raise ValueError(f"no span: {text!r}")
    return sum(int(n) * {"d": DAY_US, "h": 3_600_000_000, "m": 60_000_000, "s": 1_000_000}[u] for n, u in re.findall(r"(\d+)\s*([dhms])", text))


def plain_name(c: Column) -> Column:
    """A value as part of a column name: lower case, anything but letters and digits as one low line, none outside."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "_"), r"^_+|_+$", "")


def list_statistics(text: Column, between: str = ",") -> dict[str, Column]:
    """Of a text of several values: len, distinct, top1_share and entropy in bits of its values; null texts have 0."""
    x = F.coalesce(F.filter(F.transform(F.split(text, between), F.btrim), lambda v: v != ""), F.array().cast("array<string>"))
    n = F.size(x)
    shares = F.transform(F.array_distinct(x), lambda v: F.size(F.filter(x, lambda w: w == v)) / n)
    return {"len": n, "distinct": F.size(F.array_distinct(x)), "top1_share": F.coalesce(F.array_max(shares), F.lit(0.0)), "entropy": F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))}


def fraction_split(df: DataFrame, us: str, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """df with `split`: train, val, test by the quantiles of time, with the bounds at full hours."""
    a, b = Q.quantiles(df, us, [train, train + val])
    hour = 3_600_000_000
    a, b = (int(x // hour * hour) for x in (a, b))
    return df.withColumn("split", F.when(F.col(us) < a, "train").when(F.col(us) < b, "val").when(F.col(us).isNotNull(), "test"))


def trailing_mean_before(df: DataFrame, group: str, us: str, key: str, value: str, period_us: int) -> DataFrame:
    """df with {value}_before: the mean of the rows of the group in the period up to and with the row before, by time,
    then key; null for a group's first row. The row before is taken within the group."""
    inner = Window.partitionBy(group).orderBy(us).rangeBetween(-period_us, 0)
    return df.withColumn("__m", F.avg(value).over(inner)).withColumn(f"{value}_before", F.lag("__m").over(Window.partitionBy(group).orderBy(us, key))).drop("__m")


def repeated_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows whose values of the columns (null a value) more than one row has, with `copies`. Values are counted and
    joined back, so that no group of copies is one task's."""
    n = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select(F.struct(*columns).alias("__k"), "copies")
    return df.withColumn("__v", F.struct(*columns)).join(n, F.col("__v").eqNullSafe(F.col("__k"))).drop("__v", "__k")


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key, null a value, in an order that should name all that differs."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__k", k).where(F.col("__k") == 1).drop("__k")


def cold_report(log: DataFrame, items: DataFrame, item: str) -> DataFrame:
    """seen (distinct items of the log), known (of these in the item table) and cold."""
    known = items.select(item, F.lit(1).alias("k")).where(F.col(item).isNotNull()).distinct()
    seen = log.select(item).where(F.col(item).isNotNull()).distinct().join(known, item, "left")
    return seen.agg(F.count(F.lit(1)).alias("seen"), F.count("k").alias("known"), F.count_if(F.col("k").isNull()).alias("cold"))


def run_overlaps(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """a, b, common: for every two runs (a < b) the distinct keys, without nulls, that both have. Each key gives its runs
    as one array, whose pairs are counted: as many as there are runs squared at most."""
    own = runs.dropna(subset=list(keys)).groupBy(*keys).agg(F.array_sort(F.collect_set("run")).alias("r"))
    pairs = own.select(F.explode("r").alias("a"), "r").select("a", F.explode("r").alias("b")).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("common"))
    names = runs.select("run").distinct()
    every = names.select(F.col("run").alias("a")).join(names.select(F.col("run").alias("b")), F.col("a") < F.col("b"))
    return every.join(pairs, ["a", "b"], "left").fillna(0, ["common"])
