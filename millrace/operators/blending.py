"""Blending the scores of runs: spaces, weight searches, second-level models, thresholds.

Scores come as a wide table: a key, the target, and a column for each run. Searches over many weights are one pass over
the rows, which gives a row of sums for each weighting, or the moments from which any weighting's squared error follows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.quality import running_counts


def wide_scores(runs: DataFrame, names: Sequence[str], keys: Sequence[str] = ("query_id", "item_id")) -> DataFrame:
    """keys and a column for each run of (run, keys, score), null where a run lacks the key: a full outer join as one
    aggregation. Of several scores the greatest counts."""
    return runs.groupBy(*keys).agg(*[F.max(F.when(F.col("run") == n, F.col("score"))).alias(n) for n in names])


def clipped(p: Column, eps: float = 1e-6) -> Column:
    return F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clipped(p, eps)
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def softmax(scores: Column) -> Column:
    """Of an array of scores: shares that add up to 1."""
    e = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def ranked(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df with each column as its average rank's share of the rows (from over 0 to 1), nulls as they are."""
    for c in columns:
        n = running_counts(df.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n")), c, ["n"])
        total = n.agg(F.max("cum_n")).scalar()
        place = n.select(F.col(c).alias("__v"), ((F.col("cum_n") - (F.col("n") - 1) / 2) / total).alias("__r"))
        df = df.join(place, F.col(c) == F.col("__v"), "left").withColumn(c, F.col("__r")).drop("__v", "__r")
    return df


def blended(df: DataFrame, weights: Mapping[str, float], space: str = "proba", out: str = "blend") -> DataFrame:
    """df with the weighted mean of its runs' columns in a space: proba (as they are), logit (back through the sigmoid)
    or rank. Where a run is null the others share its weight."""
    if space not in ("proba", "logit", "rank"):
        raise ValueError(f"unknown space {space!r}")
    of = ranked(df.select("*", *[F.col(c).alias(f"__{c}") for c in weights]), [f"__{c}" for c in weights]) if space == "rank" else df.withColumns({f"__{c}": logit(F.col(c)) if space == "logit" else F.col(c) for c in weights})
    parts = [F.when(F.col(f"__{c}").isNotNull(), F.lit(float(w))).otherwise(0.0) for c, w in weights.items()]
    total = sum((F.coalesce(F.col(f"__{c}"), F.lit(0.0)) * p for c, p in zip(weights, parts)), F.lit(0.0))
    mass = sum(parts, F.lit(0.0))
    mean = F.when(mass > 0, total / mass)
    return of.withColumn(out, sigmoid(mean) if space == "logit" else mean).drop(*[f"__{c}" for c in weights])


def median_blend(df: DataFrame, columns: Sequence[str], out: str = "blend") -> DataFrame:
    """df with the median of the columns that are not null."""
    x = F.array_sort(F.array_compact(F.array(*columns)))
    n = F.size(x)
    middle = (F.get(x, ((n - 1) / 2).cast("int")) + F.get(x, (n / 2).cast("int"))) / 2
    return df.withColumn(out, F.when(n > 0, middle))


def simplex(v: np.ndarray) -> np.ndarray:
    """The nearest weights that are at least 0 and add up to 1."""
    u = np.sort(v)[::-1]
    over = u - (np.cumsum(u) - 1) / np.arange(1, len(v) + 1)
    k = np.flatnonzero(over > 0)[-1]
    return np.maximum(v - (np.cumsum(u)[k] - 1) / (k + 1), 0)


def moments(df: DataFrame, columns: Sequence[str], y: str, by: str | None = None) -> dict[Any, tuple[int, np.ndarray, np.ndarray, float]]:
    """For each value of `by` (None: one for all): rows, mean products of the columns (with 1 before them), with the
    target, and mean square of the target, in one pass. Rows with a null are left out."""
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in columns]]
    t = F.col(y).cast("double")
    pairs = [F.avg(a * b) for i, a in enumerate(x) for b in x[i:]]
    rows = df.dropna(subset=[*columns, y]).groupBy(F.lit(0).alias("__k") if by is None else F.col(by).alias("__k")).agg(F.count(F.lit(1)).alias("n"), F.array(*pairs).alias("xx"), F.array(*[F.avg(a * t) for a in x]).alias("xy"), F.avg(t * t).alias("yy"))
    out = {}
    for r in rows.collect():  # a row for each fold
        m = np.zeros((len(x), len(x)))
        m[np.triu_indices(len(x))] = r.xx
        out[r["__k"]] = (r.n, m + np.triu(m, 1).T, np.array(r.xy), r.yy)
    return out


def _pooled(parts: Sequence[tuple[int, np.ndarray, np.ndarray, float]]) -> tuple[int, np.ndarray, np.ndarray, float]:
    n = sum(p[0] for p in parts)
    return (n, *(sum(p[i] * p[0] for p in parts) / n for i in (1, 2, 3)))


def convex_weights(m: tuple[int, np.ndarray, np.ndarray, float], rounds: int = 2000) -> np.ndarray:
    """Weights of the columns, at least 0 and of sum 1, of least squared error: projected gradient steps on the
    moments, which are as many numbers as there are pairs of runs."""
    xx, xy = m[1][1:, 1:], m[2][1:]
    step = 1 / max(np.linalg.norm(xx, 2), 1e-12)
    w = np.full(len(xy), 1 / len(xy))
    for _ in range(rounds):
        w = simplex(w - step * (xx @ w - xy))
    return w


def nonnegative_weights(m: tuple[int, np.ndarray, np.ndarray, float], rounds: int = 2000) -> np.ndarray:
    """Weights of at least 0 of least squared error, without a constant."""
    xx, xy = m[1][1:, 1:], m[2][1:]
    step = 1 / max(np.linalg.norm(xx, 2), 1e-12)
    w = np.zeros(len(xy))
    for _ in range(rounds):
        w = np.maximum(w - step * (xx @ w - xy), 0)
    return w


def ridge_weights(m: tuple[int, np.ndarray, np.ndarray, float], alpha: float = 1.0) -> np.ndarray:
    """Constant and weights of least squared error plus alpha times their squares over the rows (not the constant's)."""
    pen = np.eye(len(m[2])) * alpha / max(m[0], 1)
    pen[0, 0] = 0
    return np.linalg.solve(m[1] + pen, m[2])


def squared_error(m: tuple[int, np.ndarray, np.ndarray, float], w: Sequence[float]) -> float:
    """Mean squared error of weights (with the constant first) by the moments."""
    w = np.asarray(w, float)
    return float(w @ m[1] @ w - 2 * (w @ m[2]) + m[3])


def second_level(df: DataFrame, columns: Sequence[str], y: str, fold: str, alphas: Sequence[float] = (0.1, 1.0, 10.0)) -> tuple[DataFrame, dict[str, Any]]:
    """(df with `level2`, report): ridge over the runs' out-of-fold scores, each fold predicted by the weights of the
    others; alpha of least error over the folds; the report's weights are the mean of the folds'."""
    parts = moments(df, columns, y, fold)
    rest = {k: _pooled([p for j, p in parts.items() if j != k]) for k in parts}
    total = sum(p[0] for p in parts.values())
    error = {a: sum(parts[k][0] * squared_error(parts[k], ridge_weights(rest[k], a)) for k in parts) / total for a in alphas}
    best = min(alphas, key=lambda a: (error[a], a))
    own = {k: ridge_weights(rest[k], best) for k in parts}
    value = F.lit(None).cast("double")
    for k, w in own.items():
        line = sum((F.lit(float(x)) * F.col(c) for x, c in zip(w[1:], columns)), F.lit(float(w[0])))
        value = F.when(F.col(fold) == F.lit(k), line).otherwise(value)
    return df.withColumn("level2", value), {"alpha": best, "mse": error[best], "weights": np.mean(list(own.values()), axis=0).tolist()}


def fold_safe_blend(df: DataFrame, columns: Sequence[str], y: str, fold: str) -> DataFrame:
    """df with `blend`: each fold by convex weights fitted on the other folds."""
    parts = moments(df, columns, y, fold)
    value = F.lit(None).cast("double")
    for k in parts:
        w = convex_weights(_pooled([p for j, p in parts.items() if j != k]))
        value = F.when(F.col(fold) == F.lit(k), sum((F.lit(float(x)) * F.col(c) for x, c in zip(w, columns)), F.lit(0.0))).otherwise(value)
    return df.withColumn("blend", value)


def weight_candidates(runs: int, tries: int, seed: int = 0, around: Sequence[float] | None = None) -> list[list[float]]:
    """Weightings to search: the equal one, each run alone, and seeded draws of sum 1; with `around`, seven in ten of
    these are small changes of it."""
    rng = np.random.default_rng(seed)
    out = [np.full(runs, 1 / runs), *np.eye(runs)]
    while len(out) < tries + runs + 1:
        near = around is not None and rng.random() < 0.7
        out.append(simplex(np.array(around) + rng.normal(0, 0.1, runs)) if near else rng.dirichlet(np.ones(runs)))
    return [[float(x) for x in w] for w in out]


def search_by_ndcg(df: DataFrame, columns: Sequence[str], y: str, weights: Sequence[Sequence[float]], k: int, query: str = "query_id", item: str = "item_id") -> DataFrame:
    """candidate, ndcg: of each weighting the mean over queries with a relevant row of binary ndcg at k, ties by item.
    Rows are multiplied by the weightings and ranked in one window by (weighting, query); null scores count 0."""
    w = F.array(*[F.struct(F.lit(i).alias("candidate"), F.array(*[F.lit(float(x)) for x in row]).alias("w")) for i, row in enumerate(weights)])
    rows = df.select(query, item, y, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("x"), F.explode(w).alias("c"))
    score = F.aggregate(F.zip_with("x", "c.w", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    rows = rows.select(query, item, y, "c.candidate", F.round(score, 9).alias("s"))
    place = F.row_number().over(Window.partitionBy("candidate", query).orderBy(F.col("s").desc(), item))
    hit = rows.withColumn("place", place).groupBy("candidate", query).agg(F.sum(F.when((F.col("place") <= k) & (F.col(y) > 0), 1 / F.log2(F.col("place") + 1)).otherwise(0.0)).alias("dcg"), F.count_if(F.col(y) > 0).alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")), F.lit(0.0), lambda a, x: a + 1 / F.log2(x + 1))
    return hit.where("n > 0").groupBy("candidate").agg(F.avg(F.col("dcg") / ideal).alias("ndcg"))


def best_candidate(found: DataFrame, metric: str = "ndcg") -> DataFrame:
    """The row of the greatest metric, the first among equals."""
    return found.orderBy(F.col(metric).desc(), "candidate").limit(1)


def with_threshold(df: DataFrame, p: str, threshold: float | Mapping[Any, float], by: str | None = None, otherwise: float = 0.5) -> DataFrame:
    """df with `decision`: 1 where p is over the threshold, one for all or one for each value of `by`."""
    t = F.lit(float(threshold)) if by is None else F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in threshold.items() for x in kv]), F.col(by)), F.lit(otherwise))
    return df.withColumn("decision", F.when(F.col(p).isNotNull(), (F.col(p) > t).cast("int")))


def top_decisions(df: DataFrame, group: str, p: str, item: str, k: int) -> DataFrame:
    """df with `decision`: 1 for the k rows of greatest p in each group, ties by item, else 0."""
    w = Window.partitionBy(group).orderBy(F.col(p).desc_nulls_last(), F.col(item))
    return df.withColumn("decision", (F.row_number().over(w) <= k).cast("int"))


def threshold_curve(df: DataFrame, y: str, p: str, steps: int = 101) -> DataFrame:
    """threshold, tp, fp, fn, tn, f1, youden of p > threshold on an even grid from 0 to 1: one histogram and its tails."""
    k = F.least(F.greatest(F.ceil(F.col(p) * (steps - 1)), F.lit(0)), F.lit(steps)).cast("int")
    h = df.where(F.col(p).isNotNull()).groupBy(k.alias("k")).agg(F.sum(F.col(y).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(steps).select(F.col("id").cast("int").alias("g"))
    t = grid.join(F.broadcast(h), F.col("k") > F.col("g"), "left").groupBy("g").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("tp"), F.coalesce(F.sum("n"), F.lit(0)).alias("s"))
    whole = h.agg(F.struct(F.sum("pos").alias("p"), F.sum("n").alias("n"))).scalar()
    t = t.withColumn("w", whole).withColumns({"fp": F.col("s") - F.col("tp"), "fn": F.col("w.p") - F.col("tp"), "tn": F.col("w.n") - F.col("s") - (F.col("w.p") - F.col("tp"))})
    f1 = F.coalesce(2 * F.col("tp") / F.nullif(F.col("s") + F.col("w.p"), F.lit(0)), F.lit(0.0))
    youden = F.coalesce(F.col("tp") / F.nullif(F.col("w.p"), F.lit(0)), F.lit(0.0)) - F.coalesce(F.col("fp") / F.nullif(F.col("w.n") - F.col("w.p"), F.lit(0)), F.lit(0.0))
    return t.select((F.col("g") / (steps - 1)).alias("threshold"), "tp", "fp", "fn", "tn", f1.alias("f1"), youden.alias("youden"))

