"""Feature encoders: fitted on a table in one aggregate pass, applied as projections or joins.

A fit gives a small row of statistics (read once on the driver) or, for categories, a table that is joined; the
join is broadcast by the optimiser only where the table's measured size allows. Null numbers stay null unless
imputed; null categories are a category of their own where the encoder says so.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.numbers import finite
from millrace.operators.quality import grouped_quantiles, long_form, quantiles, running_counts


@dataclass
class NumericFit:
    """Statistics of numeric columns, of one pass over the training table."""

    stats: dict[str, dict[str, float]] = field(default_factory=dict)

    @classmethod
    def of(cls, df: DataFrame, columns: Sequence[str], quantiles: Sequence[float] = (0.01, 0.25, 0.5, 0.75, 0.99)) -> NumericFit:
        long = long_form(df, columns)
        stats = long.groupBy("feature").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
        rows = stats.join(grouped_quantiles(long, "feature", "x", quantiles), "feature", "left").collect()  # a row for each column
        return cls({r.feature: {k: r[k] for k in ("mean", "std", "min", "max")} | dict(zip([f"q{q:g}" for q in quantiles], r.q or [None] * len(quantiles))) for r in rows})

    def standard(self, c: str) -> Column:
        s = self.stats[c]
        return (finite(c) - F.lit(s["mean"])) / F.lit(s["std"] or 1.0)

    def minmax(self, c: str) -> Column:
        s = self.stats[c]
        return (finite(c) - F.lit(s["min"])) / F.lit((s["max"] - s["min"]) or 1.0)

    def robust(self, c: str) -> Column:
        s = self.stats[c]
        return (finite(c) - F.lit(s["q0.5"])) / F.lit((s["q0.75"] - s["q0.25"]) or 1.0)

    def imputed(self, c: str, by: str = "q0.5") -> Column:
        return F.coalesce(finite(c), F.lit(self.stats[c][by]))

    def clipped(self, c: str, low: str = "q0.01", high: str = "q0.99") -> Column:
        s = self.stats[c]
        return F.least(F.greatest(finite(c), F.lit(s[low])), F.lit(s[high]))

    def outlier(self, c: str, k: float = 1.5) -> Column:
        s = self.stats[c]
        reach = k * (s["q0.75"] - s["q0.25"])
        return F.coalesce((finite(c) < s["q0.25"] - reach) | (finite(c) > s["q0.75"] + reach), F.lit(False)).cast("int")

    def equal_width(self, c: str, bins: int) -> Column:
        """Right-closed bins from 0, the least value in the first; -1 outside the fitted range or for null."""
        s = self.stats[c]
        x, width = finite(c), (s["max"] - s["min"]) / bins or 1.0
        n = F.least(F.greatest(F.ceil((x - s["min"]) / width) - 1, F.lit(0)), F.lit(bins - 1))
        return F.coalesce(F.when((x >= s["min"]) & (x <= s["max"]), n), F.lit(-1)).cast("int")


def quantile_edges(df: DataFrame, c: str, bins: int) -> list[float]:
    return list(dict.fromkeys(quantiles(df, finite(c), [i / bins for i in range(bins + 1)])))


def quantile_bin(c: str, edges: Sequence[float]) -> Column:
    """Right-closed bins between fitted edges, the least value in the first; -1 outside or for null."""
    x = finite(c)
    n = sum(((x > e).cast("int") for e in edges[1:-1]), F.lit(0))
    return F.coalesce(F.when((x >= edges[0]) & (x <= edges[-1]), n), F.lit(-1)).cast("int")


def box_cox(df: DataFrame, c: str, low: float = -2.0, high: float = 2.0, steps: int = 41) -> tuple[float, Column]:
    """lambda of greatest likelihood on a grid, all its values in one aggregate pass, and the transformed column;
    values of 0 or less are null."""
    x = F.when(finite(c) > 0, finite(c))
    grid = [low + (high - low) * i / (steps - 1) for i in range(steps)]
    grid = [0.0 if abs(g) < 1e-9 else g for g in grid]
    form = lambda g: F.log(x) if g == 0 else (F.pow(x, F.lit(g)) - 1) / g
    row = df.agg(F.count(x).alias("n"), F.sum(F.log(x)).alias("l"), *[F.var_pop(form(g)).alias(f"v{i}") for i, g in enumerate(grid)]).first()
    like = [-row["n"] / 2 * math.log(max(row[f"v{i}"] or 0, 1e-300)) + (g - 1) * row["l"] for i, g in enumerate(grid)]
    best = grid[like.index(max(like))]
    return best, form(best)


def yeo_johnson(df: DataFrame, c: str, low: float = -2.0, high: float = 2.0, steps: int = 41) -> tuple[float, Column]:
    """lambda of greatest likelihood on a grid, in one aggregate pass, and the transformed column, of any finite
    numbers."""
    x = finite(c)
    grid = [low + (high - low) * i / (steps - 1) for i in range(steps)]

    def form(g: float) -> Column:
        up = F.log(x + 1) if abs(g) < 1e-9 else (F.pow(x + 1, F.lit(g)) - 1) / g
        down = -F.log(1 - x) if abs(g - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - g)) - 1) / (2 - g)
        return F.when(x >= 0, up).when(x < 0, down)

    row = df.agg(F.count(x).alias("n"), F.sum(F.signum(x) * F.log(F.abs(x) + 1)).alias("l"), *[F.var_pop(form(g)).alias(f"v{i}") for i, g in enumerate(grid)]).first()
    like = [-row["n"] / 2 * math.log(max(row[f"v{i}"] or 0, 1e-300)) + (g - 1) * (row["l"] or 0) for i, g in enumerate(grid)]
    best = grid[like.index(max(like))]
    return best, form(best)


def null_flags(columns: Sequence[str]) -> dict[str, Column]:
    """0/1 columns of what is null."""
    return {f"{c}_null": F.col(c).isNull().cast("int") for c in columns}


def value_flag(c: str, value: object) -> Column:
    """1 where the column equals a value, 0 elsewhere and for null."""
    return F.coalesce(F.col(c) == F.lit(value), F.lit(False)).cast("int")


def ordinal_encoded(df: DataFrame, train: DataFrame, c: str, unknown: int = -1) -> DataFrame:
    """df with {c}_code: the place, from 0, of the value among train's in their order; unseen values and null: unknown."""
    values = train.select(c).where(F.col(c).isNotNull()).distinct().withColumn("n", F.lit(1).cast("long"))
    codes = running_counts(values, c, ["n"]).select(F.col(c).alias("__v"), (F.col("cum_n") - 1).alias(f"{c}_code"))
    return df.join(codes, F.col(c) == F.col("__v"), "left").drop("__v").fillna(unknown, [f"{c}_code"])


def tree_edges(df: DataFrame, c: str, y: str, bins: int, grid: int = 256) -> list[float]:
    """Up to bins - 1 edges of a number that lower the squared error of a target most, one after the other. Only the
    sums of the target in `grid` cells of like size, from running counts, decide: a regression tree of one feature."""
    known = df.select(finite(c).alias("x"), F.col(y).cast("double").alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    run = running_counts(known.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("s")), "x", ["n"])
    whole = run.agg(F.max("cum_n")).scalar()
    cell = F.floor((F.col("cum_n") - 1) * grid / whole)
    rows = run.groupBy(cell.alias("k")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.max("x").alias("x")).orderBy("k").collect()  # at most `grid` rows
    n, total = np.cumsum([0, *(r.n for r in rows)]), np.cumsum([0.0, *(r.s for r in rows)])
    square = lambda a, b: (total[b] - total[a]) ** 2 / (n[b] - n[a])
    parts = [(0, len(rows))] if rows else []
    while parts and len(parts) < bins:
        gains = [(square(a, m) + square(m, b) - square(a, b), a, m, b) for a, b in parts for m in range(a + 1, b)]
        if not gains or max(gains)[0] <= 1e-12:
            break
        _, a, m, b = max(gains)
        parts.remove((a, b))
        parts += [(a, m), (m, b)]
    return sorted(rows[a - 1].x for a, _ in parts if a)


def _numbered(df: DataFrame, label: str, key: str, seed: int) -> DataFrame:
    """df with `__at`, the place from 1 of a row in its label in the order of a seeded hash, and `__all`, its rows."""
    rows = df.withColumn("__v", F.struct(F.col(label), F.xxhash64(key, F.lit(seed)), F.col(key)))
    n = running_counts(rows.groupBy("__v").agg(F.count(F.lit(1)).alias("__n")), "__v", ["__n"])
    per = n.groupBy(F.col(f"__v.{label}").alias("__l")).agg(F.sum("__n").alias("__all"), F.min(F.col("cum___n") - F.col("__n")).alias("__base"))
    place = n.join(per, F.col(f"__v.{label}").eqNullSafe(F.col("__l"))).select(F.col("__v").alias("__w"), (F.col("cum___n") - F.col("__base")).alias("__at"), "__all")
    return rows.join(place, F.col("__v") == F.col("__w")).drop("__v", "__w")


def stratified_sample(df: DataFrame, label: str, key: str, share: float, seed: int = 0) -> DataFrame:
    """The first rows of each label in a hashed order: the share of its rows, rounded up. Keys must be distinct."""
    return _numbered(df, label, key, seed).where(F.col("__at") <= F.ceil(F.col("__all") * share)).drop("__at", "__all")


def balanced(df: DataFrame, label: str, key: str, seed: int = 0) -> DataFrame:
    """As many rows of each label as the least frequent has, the first in a hashed order. Keys must be distinct."""
    least = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).scalar()
    return _numbered(df, label, key, seed).where(F.col("__at") <= least).drop("__at", "__all")


def value_counts(df: DataFrame, c: str) -> DataFrame:
    """value (null too), n, share."""
    n = df.groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.col("n") / df.agg(F.count(F.lit(1))).scalar())


def frequency_encoded(df: DataFrame, train: DataFrame, c: str, rare: int = 0) -> DataFrame:
    """df with {c}_count and {c}_share by train; values of under `rare` rows share their pooled count; unseen: 0."""
    counts = value_counts(train, c)
    pooled = counts.where(F.col("n") < rare).agg(F.coalesce(F.sum("n"), F.lit(0))).scalar()
    total = train.agg(F.count(F.lit(1))).scalar()
    counts = counts.select(F.col("value").alias("__v"), F.when(F.col("n") < rare, pooled).otherwise(F.col("n")).alias(f"{c}_count"))
    out = df.join(counts, F.col(c).eqNullSafe(F.col("__v")), "left").drop("__v").fillna(0, [f"{c}_count"])
    return out.withColumn(f"{c}_share", F.col(f"{c}_count") / total)


def target_encoded(df: DataFrame, train: DataFrame, c: str, target: str, strength: float = 20.0) -> DataFrame:
    """df with {c}_te: (sum + prior m) / (n + m) of train's target by category; unseen and null: the prior."""
    prior = train.agg(F.avg(target)).scalar()
    t = train.where(F.col(c).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(c).alias("__v")).agg(F.sum(target).alias("__s"), F.count(target).alias("__n"))
    out = df.join(t, F.col(c) == F.col("__v"), "left")
    return out.withColumn(f"{c}_te", (F.coalesce("__s", F.lit(0.0)) + prior * strength) / (F.coalesce("__n", F.lit(0)) + strength)).drop("__v", "__s", "__n")


def target_encoded_by_folds(df: DataFrame, c: str, target: str, fold: str, strength: float = 10.0) -> DataFrame:
    """df with {c}_te from the other folds only: totals less the own fold's, of one aggregation by (c, fold)."""
    per = df.groupBy(F.col(c).alias("__v"), F.col(fold).alias("__f")).agg(F.sum(target).alias("s"), F.count(target).alias("n"))
    whole = per.groupBy(F.col("__v").alias("__w")).agg(F.sum("s").alias("ws"), F.sum("n").alias("wn"))
    folds = per.groupBy(F.col("__f").alias("__g")).agg(F.sum("s").alias("fs"), F.sum("n").alias("fn"))
    total = per.agg(F.struct(F.sum("s").alias("s"), F.sum("n").alias("n"))).scalar()
    rest = per.join(whole, F.col("__v").eqNullSafe(F.col("__w"))).join(folds, F.col("__f") == F.col("__g")).withColumn("total", total)
    prior = (F.col("total.s") - F.col("fs")) / (F.col("total.n") - F.col("fn"))
    te = (F.col("ws") - F.col("s") + prior * strength) / (F.col("wn") - F.col("n") + strength)
    return df.join(rest.select("__v", "__f", te.alias(f"{c}_te")), F.col(c).eqNullSafe(F.col("__v")) & (F.col(fold) == F.col("__f")), "left").drop("__v", "__f")


def woe_encoded(df: DataFrame, train: DataFrame, c: str, target: str, eps: float = 1e-6) -> DataFrame:
    """df with {c}_woe: log odds of a 0/1 target by category against the whole; unseen and null: 0."""
    pos, neg = train.agg(F.sum(target)).scalar(), train.agg(F.sum(1 - F.col(target))).scalar()
    t = train.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("__v")).agg(F.sum(target).alias("p"), F.sum(1 - F.col(target)).alias("q"))
    t = t.select("__v", F.log(((F.col("p") + eps) / pos) / ((F.col("q") + eps) / neg)).alias(f"{c}_woe"))
    return df.join(t, F.col(c) == F.col("__v"), "left").drop("__v").fillna(0.0, [f"{c}_woe"])


def top_categories(df: DataFrame, c: str, most: int) -> list[str]:
    rows = df.where(F.col(c).isNotNull()).groupBy(c).count().orderBy(F.col("count").desc(), c).limit(most).collect()
    return [r[0] for r in rows]


def one_hot(c: str, categories: Sequence[str]) -> dict[str, Column]:
    """0/1 columns of the categories, of `other` and of null."""
    out = {f"{c}_{k}": F.coalesce(F.col(c) == k, F.lit(False)).cast("int") for k in categories}
    return out | {f"{c}_other": F.coalesce(~F.col(c).isin(list(categories)), F.lit(False)).cast("int"), f"{c}_null": F.col(c).isNull().cast("int")}


def rare_combined(df: DataFrame, train: DataFrame, c: str, least: int, other: str = "Other") -> DataFrame:
    keep = train.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("__v")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).drop("__n")
    out = df.join(keep, F.col(c) == F.col("__v"), "left")
    return out.withColumn(c, F.when(F.col(c).isNull() | F.col("__v").isNotNull(), F.col(c)).otherwise(other)).drop("__v")


def group_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """mean, std, median, min, max, sum, n, distinct and bias-corrected skew and kurtosis of a group's values."""
    n, m = F.count(value).cast("double"), F.skewness(value)
    k = F.kurtosis(value)
    named = df.withColumn("__group", F.struct(*keys))
    middle = grouped_quantiles(named, "__group", value, [0.5]).select("__group", F.col("q")[0].alias("median"))
    stats = df.groupBy(*keys).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum"),
        F.count(value).alias("n"), F.count_distinct(value).alias("distinct"), F.when(n > 2, m * F.sqrt(n * (n - 1)) / (n - 2)).alias("skew"),
        F.when(n > 3, ((n + 1) * k + 6) * (n - 1) / ((n - 2) * (n - 3))).alias("kurt"),
    )
    return stats.withColumn("__k", F.struct(*keys)).join(middle, F.col("__k").eqNullSafe(F.col("__group")), "left").drop("__k", "__group")


def number_pairs(columns: Sequence[str], ops: Sequence[str] = ("add", "sub", "mul", "div"), eps: float = 1e-6) -> dict[str, Column]:
    form = {"add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": lambda a, b: a / (b + eps)}
    return {f"{a}_{op}_{b}": form[op](F.col(a), F.col(b)) for i, a in enumerate(columns) for b in columns[i + 1 :] for op in ops}


def deviation(df: DataFrame, category: str, number: str, eps: float = 1e-6) -> DataFrame:
    """df with the number less its category's mean and divided by it."""
    mean = df.groupBy(F.col(category).alias("__v")).agg(F.avg(number).alias("__m"))
    out = df.join(mean, F.col(category).eqNullSafe(F.col("__v")), "left")
    return out.withColumns({f"{number}_sub_{category}": F.col(number) - F.col("__m"), f"{number}_div_{category}": F.col(number) / (F.col("__m") + eps)}).drop("__v", "__m")


def hashed_cross(df: DataFrame, key: str, category: str, number: str, buckets: int) -> DataFrame:
    """Sparse long form: key, bucket of the category's hash, sum of the number."""
    b = F.pmod(F.conv(F.substring(F.md5(F.col(category).cast("string")), 1, 7), 16, 10).cast("long"), F.lit(buckets)).cast("int")
    return df.where(F.col(category).isNotNull()).groupBy(key, b.alias("bucket")).agg(F.sum(number).alias("value"))


EARTH_M = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(a))


def grid_cell(lat: Column, lon: Column, step_m: float) -> tuple[Column, Column]:
    """Cell of about step_m metres; the longitude step is that of the cell row, so that a row has equal cells."""
    row = F.floor(lat / (step_m / 111_320.0))
    wide = F.greatest(F.cos(F.radians(row * (step_m / 111_320.0))), F.lit(0.01))
    return row.cast("long"), F.floor(lon / (step_m / 111_320.0) * wide).cast("long")


def radius_neighbours(df: DataFrame, key: str, lat: str, lon: str, radius_m: float) -> DataFrame:
    """key, n: the points of other keys within radius_m, one row a key. Points of one place are counted first, so that
    only places meet, however many points they hold. Equal-key join on latitude bands and longitude cells: each place
    asks its own and the bordering cells, whose width is taken at the widest of its three bands; the last cell of a band
    borders on the first, across the 180th meridian, and bands at the poles are one cell."""
    step = radius_m / 111_000.0
    points = df.select(F.col(key).alias("k"), F.col(lat).cast("double").alias("la"), F.col(lon).cast("double").alias("lo")).where("la IS NOT NULL AND lo IS NOT NULL")
    points = points.groupBy("k", "la", "lo").agg(F.count(F.lit(1)).alias("m"))
    p = points.where("k IS NOT NULL").groupBy("la", "lo").agg(F.sum("m").alias("w"))
    band = F.floor(F.col("la") / step).cast("long")
    least = lambda b: F.least(F.cos(F.radians(b * step)), F.cos(F.radians((b + 1) * step)))
    # near the poles a radius spans any longitudes: one cell
    width = lambda b: F.when(least(b) < 4 * math.radians(step), 360.0).otherwise(step / least(b))
    cells = lambda b: F.greatest(F.ceil(360 / width(b)), F.lit(1)).cast("long")
    cell = lambda b: F.floor(F.pmod(F.col("lo") + 180, F.lit(360.0)) / width(b)).cast("long")
    own = p.withColumn("b", band).withColumn("c", cell(F.col("b")))
    ask = p.withColumn("b", F.explode(F.array(band - 1, band, band + 1)))
    near = F.transform(F.array(*[F.lit(x) for x in range(-2, 3)]), lambda x: F.pmod(cell(F.col("b")) + x, cells(F.col("b"))))
    ask = ask.withColumn("c", F.explode(F.array_distinct(near)))
    within = haversine(F.col("la"), F.col("lo"), F.col("la2"), F.col("lo2")) <= radius_m
    other = own.select(F.col("w").alias("w2"), F.col("la").alias("la2"), F.col("lo").alias("lo2"), "b", "c")
    near = ask.join(other, ["b", "c"]).where(within).groupBy("la", "lo").agg(F.sum("w2").alias("near"))
    total = points.join(near, ["la", "lo"], "left").groupBy("k").agg(F.sum(F.col("m") * F.coalesce("near", F.lit(0))).alias("n"))
    # less the pairs of a key's own points
    mine = points.select("k", F.col("la").alias("la2"), F.col("lo").alias("lo2"), F.col("m").alias("m2"))
    same = points.join(mine, "k").where(within).groupBy("k").agg(F.sum(F.col("m") * F.col("m2")).alias("s"))
    n = F.when(F.col("k").isNull(), 0).otherwise(F.col("n") - F.coalesce("s", F.lit(0)))
    return total.join(same, "k", "left").select(F.col("k").alias(key), n.cast("long").alias("n"))
