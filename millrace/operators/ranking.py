"""Ranking: best-k, quotas, diversity, fusion of runs, and ranking metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best(df: DataFrame, group: str, score: str, item: str, k: int) -> DataFrame:
    """The k rows of each group of greatest score, ties by item, with rank from 1."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(item))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def within_quotas(df: DataFrame, quotas: Mapping[str, int], k: int, source: str = "source") -> DataFrame:
    """Per query the best of each source by its quota, one row per item (its best), then the best k."""
    quota = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv]), F.col(source)), F.lit(0))
    w = Window.partitionBy("query_id", source).orderBy(F.col("score").desc(), "item_id")
    kept = df.withColumn("q", F.row_number().over(w)).where(F.col("q") <= quota)
    return best(kept.groupBy("query_id", "item_id").agg(F.max("score").alias("score")), "query_id", "score", "item_id", k)


def per_category(df: DataFrame, category: str, most: int, k: int) -> DataFrame:
    """Per query at most `most` items of a category, then the best k."""
    w = Window.partitionBy("query_id", category).orderBy(F.col("score").desc(), "item_id")
    kept = df.withColumn("c", F.row_number().over(w)).where(F.col("c") <= most).drop("c")
    return best(kept, "query_id", "score", "item_id", k)


def padded(df: DataFrame, queries: DataFrame, pool: DataFrame, k: int) -> DataFrame:
    """Lists of exactly k where the pool suffices: the best k of each query, then pool items it lacks, best
    first. The pool's k best, and as many as a list can hold besides, suffice for any query: 2k rows at most."""
    have = best(df, "query_id", "score", "item_id", k)
    own = have.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("own"))
    top = pool.orderBy(F.col("score").desc(), "item_id").limit(2 * k).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "item_id")))).scalar()
    items = F.coalesce(F.transform("own", lambda x: x["item_id"]), F.array().cast(own.select(F.transform("own", lambda x: x["item_id"]).alias("x")).schema["x"].dataType))
    joined = queries.select("query_id").distinct().join(own, "query_id", "left").withColumn("best", top)
    joined = joined.withColumns({"items": items, "top": F.transform("best", lambda x: x["item_id"])})
    full = F.slice(F.concat("items", F.array_except("top", "items")), 1, k)
    return joined.select("query_id", F.posexplode(full).alias("p", "item_id")).select("query_id", "item_id", (F.col("p") + 1).alias("rank"))


def mmr_by_category(df: DataFrame, category: str, k: int, trade: float) -> DataFrame:
    """Maximal marginal relevance where an equal category (null among them) is a similarity of 1: greedily the
    greatest trade * score - (1 - trade) * [category taken], ties by score, then item. An item that is not the best of
    its category always meets it taken, so the greedy order is the order of these fixed gains: whole lists of any
    length, in two windows. Adds gain and rank."""
    first = F.row_number().over(Window.partitionBy("query_id", category).orderBy(F.col("score").desc(), "item_id")) == 1
    gained = df.withColumn("gain", trade * F.col("score") - F.when(first, 0.0).otherwise(1 - trade))
    w = Window.partitionBy("query_id").orderBy(F.col("gain").desc(), F.col("score").desc(), "item_id")
    return gained.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mmr(df: DataFrame, k: int, trade: float, vector: str) -> DataFrame:
    """Maximal marginal relevance: greedily trade * score - (1 - trade) * greatest cosine of vectors to those taken,
    ties by score, then item; gain is that at the pick. Sequential within one query's candidates, which the caller
    bounds by a retrieval stage; similarities are taken to the picked ones only."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "item_id"], ascending=[False, True]).reset_index(drop=True)
        m = np.array(pdf[vector].tolist(), float)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        score, worst = pdf["score"].to_numpy(float), np.zeros(len(pdf))
        taken: list[int] = []
        gains: list[float] = []
        for _ in range(min(k, len(pdf))):
            gain = trade * score - (1 - trade) * worst
            gain[taken] = -np.inf
            taken.append(int(np.argmax(gain)))
            gains.append(gain[taken[-1]])
            like = m @ m[taken[-1]]
            worst = like if len(taken) == 1 else np.maximum(worst, like)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[taken], "item_id": pdf["item_id"].iloc[taken], "rank": np.arange(1, len(taken) + 1), "gain": gains})

    kinds = dict(df.dtypes)
    return df.select("query_id", "item_id", "score", vector).groupBy("query_id").applyInPandas(run, f"query_id {kinds['query_id']}, item_id {kinds['item_id']}, rank int, gain double")


def average_rank(score: Column, *by: Column | str) -> Column:
    """Rank from 1 by ascending score with the mean rank among equals."""
    w, peers = Window.partitionBy(*by).orderBy(score), Window.partitionBy(*by, score)
    return F.rank().over(w) + (F.count(F.lit(1)).over(peers) - 1) / 2


def reciprocal_rank_fusion(runs: DataFrame, k: float = 60) -> DataFrame:
    """Of (run, query_id, item_id, score): sum over the runs of a query of 1 / (k + rank); an item that a run
    lacks counts there with the run's greatest rank plus 1000."""
    w = Window.partitionBy("run", "query_id").orderBy(F.col("score").desc(), "item_id")
    ranked = runs.withColumn("rank", F.row_number().over(w))
    lists = ranked.groupBy("query_id", "run").agg(F.max("rank").alias("n"))
    lack = lists.groupBy("query_id").agg(F.sum(1 / (k + F.col("n") + 1000)).alias("all"))
    got = ranked.join(lists, ["query_id", "run"]).groupBy("query_id", "item_id").agg(F.sum(1 / (k + F.col("rank")) - 1 / (k + F.col("n") + 1000)).alias("s"))
    return got.join(lack, "query_id").select("query_id", "item_id", (F.col("s") + F.col("all")).alias("score"))


def borda(runs: DataFrame, k: int) -> DataFrame:
    top = best(runs.withColumn("list", F.struct("run", "query_id")), "list", "score", "item_id", k)
    return top.groupBy("query_id", "item_id").agg(F.sum(F.lit(k + 1) - F.col("rank")).alias("score"))


def comb(runs: DataFrame) -> DataFrame:
    """CombSUM and CombMNZ of scores brought to 0..1 within each run's list (constant: 0)."""
    w = Window.partitionBy("run", "query_id")
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    norm = runs.withColumn("x", F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(0.0))
    return norm.groupBy("query_id", "item_id").agg(F.sum("x").alias("comb_sum"), (F.sum("x") * F.count(F.lit(1))).alias("comb_mnz"))


def linear_blend(runs: DataFrame, weights: Mapping[str, float]) -> DataFrame:
    total = sum(weights.values())
    w = F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("run"))
    return runs.groupBy("query_id", "item_id").agg((F.sum(F.coalesce(w, F.lit(0.0)) * F.col("score")) / total).alias("score"))


def query_metrics(truth: DataFrame, preds: DataFrame, k: int) -> DataFrame:
    """Of every query with truth: recall, hit, precision (by the list's length), ndcg, ap (by min(truths, k)) and
    rr at k; 0 without predictions. preds: query_id, item_id, rank from 1; repeated truths count once."""
    t = truth.select("query_id", "item_id").distinct()
    n = t.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    top = preds.where(F.col("rank") <= k).select("query_id", "item_id", "rank")
    length = top.groupBy("query_id").agg(F.count(F.lit(1)).alias("len"))
    w = Window.partitionBy("query_id").orderBy("rank")
    hits = top.join(t, ["query_id", "item_id"]).withColumn("seen", F.row_number().over(w))
    h = hits.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("h"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.col("seen") / F.col("rank")).alias("ap"), F.min("rank").alias("first")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda a, x: a + 1 / F.log2(x + 1))
    out = n.join(length, "query_id", "left").join(h, "query_id", "left").fillna(0, ["len", "h", "dcg", "ap"])
    return out.select(
        "query_id", (F.col("h") / F.col("n")).alias("recall"), (F.col("h") > 0).cast("double").alias("hit"),
        F.when(F.col("len") > 0, F.col("h") / F.col("len")).otherwise(0.0).alias("precision"), (F.col("dcg") / ideal).alias("ndcg"),
        (F.col("ap") / F.least("n", F.lit(k))).alias("ap"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("rr"),
    )


def list_metrics(preds: DataFrame, items: DataFrame, popularity: DataFrame, k: int) -> DataFrame:
    """One row: coverage of the catalogue, novelty -ln(share of popularity) and distinct categories by length."""
    top = preds.where(F.col("rank") <= k)
    universe, all_pop = items.agg(F.count_distinct("item_id")).scalar(), popularity.agg(F.sum("pop")).scalar()
    one = top.join(items.select("item_id", "category"), "item_id", "left").join(popularity, "item_id", "left")
    per = one.groupBy("query_id").agg((F.count_distinct("category") / F.count(F.lit(1))).alias("d"), F.sum(-F.log(F.col("pop") / all_pop)).alias("s"), F.count("pop").alias("c"))
    totals = per.agg(F.avg("d").alias("diversity"), (F.sum("s") / F.sum("c")).alias("novelty"))
    return totals.withColumn("coverage", top.agg(F.count_distinct("item_id")).scalar() / universe)


def bootstrap_interval(values: DataFrame, column: str, draws: int = 100, seed: int = 0, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Percentiles of the mean over Poisson resamples of rows: each row draws its own counts from its hash, so
    the whole is one pass and one small aggregate."""
    u = F.pmod(F.xxhash64("query_id", "b", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    cdf = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, i + 1)) for i in range(8)])
    n = F.lit(0)
    for c in cdf:
        n = n + (u >= float(c)).cast("int")
    rows = values.select("query_id", F.col(column).alias("x"), F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("b")).withColumn("n", n)
    means = rows.groupBy("b").agg((F.sum(F.col("n") * F.col("x")) / F.sum("n")).alias("m"))
    return means.agg(F.percentile("m", low).alias("low"), F.percentile("m", high).alias("high"))


def metrics_by(per_query: DataFrame, slices: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean metrics of the queries of each slice value; slices: query_id, slice, value."""
    return per_query.join(slices.distinct(), "query_id").groupBy("slice", "value").agg(F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in names])
