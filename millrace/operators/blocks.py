"""Feature blocks of (query_id, item_id) pairs, their joiner, training pairs and learning-to-rank groups.

A block is fitted on the event log and the item table and transforms pairs to `query_id`, `item_id` and its columns,
from events at moments up to the pair's ts_query alone. Pairs have query_id, user_id, item_id, ts_query; repeated pairs
are one.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any, Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import candidates as C
from millrace.operators import timeline as L

KEYS = ["query_id", "item_id"]


class FeatureBlock(Protocol):
    def fit(self, log: DataFrame, items: DataFrame | None) -> FeatureBlock: ...

    def transform(self, pairs: DataFrame) -> DataFrame: ...


REGISTRY: dict[str, Callable[..., FeatureBlock]] = {}


def register(name: str) -> Callable[[type], type]:
    """Make a block known under a name, for build_blocks."""

    def keep(cls: type) -> type:
        REGISTRY[name] = cls
        return cls

    return keep


@dataclass
class _Block:
    log: DataFrame | None = field(default=None, init=False, repr=False)
    items: DataFrame | None = field(default=None, init=False, repr=False)

    def fit(self, log: DataFrame, items: DataFrame | None) -> FeatureBlock:
        self.log, self.items = log, items
        return self


def _moments(pairs: DataFrame, *columns: str) -> DataFrame:
    return pairs.select(*columns, F.unix_micros("ts_query").alias("q")).distinct()


def _events(log: DataFrame) -> DataFrame:
    return log.where("ts IS NOT NULL").select("user_id", "item_id", F.unix_micros("ts").alias("t"))


@register("pairwise_core")
@dataclass
class PairwiseCore(_Block):
    """recency_user_h, recency_item_h, seen_before, and by window user_count, user_items and item_count."""

    windows: Sequence[int] = (7, 30, 90)

    def transform(self, pairs: DataFrame) -> DataFrame:
        return L.pair_features(pairs, self.log, self.windows).drop("user_id")


@register("user_agg")
@dataclass
class UserAgg(_Block):
    """user_recency_h (0 without an event), user_freq_{d}d and user_unique_items_{d}d."""

    windows: Sequence[int] = (30,)

    def transform(self, pairs: DataFrame) -> DataFrame:
        own = L._windowed(_moments(pairs, "query_id", "user_id", "item_id"), _events(self.log).where("user_id IS NOT NULL"), "user_id", self.windows, "item_id")
        hours = F.coalesce((F.col("q") - F.col("last")) / 3.6e9, F.lit(0.0)).alias("user_recency_h")
        columns = [F.coalesce(f"count_{d}", F.lit(0)).alias(f"user_freq_{d}d") for d in self.windows] + [F.coalesce(f"distinct_{d}", F.lit(0)).alias(f"user_unique_items_{d}d") for d in self.windows]
        return own.select(*KEYS, hours, *columns)


@register("item_agg")
@dataclass
class ItemAgg(_Block):
    """item_pop_{d}d: the item's events in the d days up to ts_query."""

    windows: Sequence[int] = (7, 30)

    def transform(self, pairs: DataFrame) -> DataFrame:
        own = L._windowed(_moments(pairs, *KEYS), _events(self.log).where("item_id IS NOT NULL"), "item_id", self.windows)
        return own.select(*KEYS, *[F.coalesce(f"count_{d}", F.lit(0)).alias(f"item_pop_{d}d") for d in self.windows])


@register("sequence")
@dataclass
class SequenceBlock(_Block):
    """seq_len, gap_mean_s, gap_std_s and last_items of each query's last events, beside each of its pairs."""

    max_len: int = 100
    last_k: int = 20

    def transform(self, pairs: DataFrame) -> DataFrame:
        queries = pairs.select("query_id", "user_id", "ts_query").distinct()
        return pairs.select(*KEYS).distinct().join(L.sequence_features(queries, self.log, self.max_len, self.last_k), "query_id")


@register("similarity")
@dataclass
class Similarity(_Block):
    """cat_match_share: the share of the query's last events whose item has the pair's item's category; 0 where that
    is unknown or there is no event. Items must be one row each."""

    last: int = 20

    def transform(self, pairs: DataFrame) -> DataFrame:
        cats = self.items.select("item_id", "category").where("item_id IS NOT NULL")
        hist = L.history(self.log, pairs.select("query_id", "user_id", "ts_query").distinct(), self.last)
        per = hist.join(cats, "item_id", "left").groupBy("query_id", "category").agg(F.count(F.lit(1)).alias("n"))
        size = per.groupBy("query_id").agg(F.sum("n").alias("all"))
        own = pairs.select(*KEYS).distinct().join(cats, "item_id", "left").join(per, ["query_id", "category"], "left").join(size, "query_id", "left")
        return own.select(*KEYS, F.coalesce(F.col("n") / F.col("all"), F.lit(0.0)).alias("cat_match_share"))


@register("attributes")
@dataclass
class Attributes(_Block):
    """Number columns of the item table; 0 where the item or its number is unknown."""

    columns: Sequence[str] = ()

    def transform(self, pairs: DataFrame) -> DataFrame:
        own = pairs.select(*KEYS).distinct().join(self.items.select("item_id", *self.columns), "item_id", "left")
        return own.select(*KEYS, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in self.columns])


@register("cross")
@dataclass
class Cross(_Block):
    """The keys alone: a place for crossings of other blocks' columns."""

    def transform(self, pairs: DataFrame) -> DataFrame:
        return pairs.select(*KEYS).distinct()


@register("source")
@dataclass
class SourceBlock(_Block):
    """Of candidates (query_id, item_id, source, score, rank): from_{source} 0/1, the greatest score and the least rank,
    null for pairs that are no candidate; `candidates` is given at set-up."""

    candidates: DataFrame | None = None
    sources: Sequence[str] = ()

    def transform(self, pairs: DataFrame) -> DataFrame:
        flags = [F.max((F.col("source") == s).cast("int")).alias(f"from_{s}") for s in self.sources]
        per = self.candidates.groupBy(*KEYS).agg(*flags, F.max("score").alias("score_max"), F.min("rank").alias("rank_min"))
        return pairs.select(*KEYS).distinct().join(per, KEYS, "left")


def build_blocks(blocks: Mapping[str, Mapping[str, Any]], profile: Mapping[str, Mapping[str, Any]] | None = None) -> dict[str, FeatureBlock]:
    """Blocks by name from their parameters, over which a profile's hold; enabled: false leaves one out, an unknown
    name is an error."""
    out = {}
    for name, params in blocks.items():
        merged = {**params, **(profile or {}).get(name, {})}
        if merged.pop("enabled", True):
            if name not in REGISTRY:
                raise ValueError(f"unknown feature block {name!r}")
            out[name] = REGISTRY[name](**merged)
    return out


def joined_blocks(frames: Sequence[DataFrame]) -> DataFrame:
    """Left joins of the blocks' frames to the first by (query_id, item_id)."""
    return reduce(lambda a, b: a.join(b, KEYS, "left"), frames)


def plain_types(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Numbers as float (whole ones as they are), nulls and NaN 0; other columns and the keys as they are."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if f.name in keys:
            pass
        elif isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
            c = F.coalesce(F.nanvl(c.cast("float"), F.lit(None).cast("float")), F.lit(0.0).cast("float"))
        elif isinstance(f.dataType, T.NumericType):
            c = F.coalesce(c, F.lit(0).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def align_columns(train: DataFrame, test: DataFrame, keys: Sequence[str] = KEYS) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both frames with the columns of either, the keys first, the others by name, missing ones 0."""
    others = sorted({*train.columns, *test.columns} - set(keys))
    ordered = [k for k in keys if k in train.columns or k in test.columns] + others
    full = lambda df: df.select(*[F.col(c) if c in df.columns else F.lit(0).alias(c) for c in ordered])
    return full(train), full(test), ordered


@dataclass
class FeatureJoiner:
    """Fits blocks once and joins their features for train and test pairs, in one order of columns, with a catalogue
    of each block's columns and the seconds its plan took to set up."""

    blocks: Mapping[str, FeatureBlock]

    def fit(self, log: DataFrame, items: DataFrame | None = None) -> FeatureJoiner:
        for b in self.blocks.values():
            b.fit(log, items)
        return self

    def transform(self, train: DataFrame, test: DataFrame) -> dict[str, Any]:
        parts: dict[str, list[DataFrame]] = {"train": [], "test": []}
        catalogue, taken = [], set()
        for name, block in self.blocks.items():
            began = time.perf_counter()
            for side, pairs in (("train", train), ("test", test)):
                got = block.transform(pairs)
                # a column that another block has already takes the block's name before it
                parts[side].append(got.withColumnsRenamed({c: f"{name}_{c}" for c in got.columns if c in taken}))
            own = [c for c in parts["train"][-1].columns if c not in KEYS]
            taken |= set(own)
            catalogue.append({"block": name, "columns": own, "seconds": time.perf_counter() - began})
        a, b, columns = align_columns(*(plain_types(joined_blocks(parts[s])) for s in ("train", "test")))
        return {"train": a, "test": b, "columns": columns, "catalog": catalogue}


def build_pairs(log: DataFrame, queries: DataFrame, n: int = 10, mode: str = "pop", links: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """query_id, item_id, ts_query, label: of each query with an event up to ts_query its last item (label 1) and at
    most n others (label 0) of the items of the log, without replacement. queries: query_id, user_id, ts_query.

    mode: uniform, every item alike; pop, by its events; hard, of the links (item_i, item_j, w) of the positive by
    their weight, filled up by popularity where these are fewer."""
    if mode not in ("uniform", "pop", "hard"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "hard" and links is None:
        raise ValueError("hard negatives need links")
    positive = L.history(log, queries, 1).select("query_id", "item_id")
    counts = log.where("item_id IS NOT NULL").groupBy("item_id").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    if mode == "uniform":
        counts = counts.withColumn("weight", F.lit(1.0))
    positive = C.cut(positive)
    if mode == "hard":
        near = positive.join(links, positive.item_id == links.item_i).where("item_i <> item_j")
        w = Window.partitionBy("query_id").orderBy(F.col("w").desc(), "item_j")
        hard = C.cut(near.withColumn("k", F.row_number().over(w)).where(F.col("k") <= n).select("query_id", F.col("item_j").alias("item_id")))
        fill = C.sampled_negatives(positive.unionByName(hard), counts, n, seed)
        order = hard.withColumn("side", F.lit(0)).unionByName(fill.withColumn("side", F.lit(1)))
        k = F.row_number().over(Window.partitionBy("query_id").orderBy("side", F.xxhash64("query_id", "item_id")))
        drawn = order.withColumn("k", k).where(F.col("k") <= n).select("query_id", "item_id")
    else:
        drawn = C.sampled_negatives(positive, counts, n, seed)
    both = positive.withColumn("label", F.lit(1)).unionByName(drawn.withColumn("label", F.lit(0)))
    return both.join(queries.select("query_id", "ts_query").dropDuplicates(["query_id"]), "query_id").select("query_id", "item_id", "ts_query", "label")


def group_sizes(pairs: DataFrame, query: str = "query_id") -> DataFrame:
    """query and size of each learning-to-rank group, in the order of the query, which is the order a trainer must
    sort its rows in; a null query is a group."""
    return pairs.groupBy(query).agg(F.count(F.lit(1)).alias("size"))


def ranker_folds(pairs: DataFrame, n: int, by: str = "query_id", ts: str | None = None, seed: int = 0) -> DataFrame:
    """pairs with `fold`: groups of `by` dealt by hash, or, with ts, by blocks of the group's last moment, so that no
    group is divided."""
    if ts is None:
        return pairs.withColumn("fold", L.hashed_fold(F.col(by), n, seed))
    last = pairs.groupBy(by).agg(F.max(F.unix_micros(ts)).alias("__last")).where("__last IS NOT NULL")
    return pairs.join(L.time_blocks(last, "__last", n).select(by, "fold"), by, "left")


def late_rows(rows: DataFrame, queries: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows of (query_id, ts...) whose moment is after their query's ts_query."""
    q = queries.select("query_id", F.col("ts_query").alias("__q")).where("__q IS NOT NULL")
    return rows.join(q, "query_id").where(F.col(ts) > F.col("__q")).drop("__q")


def assert_time_safe(rows: DataFrame, queries: DataFrame, ts: str = "ts") -> None:
    if not late_rows(rows, queries, ts).isEmpty():
        raise AssertionError("rows with a moment after their query")


def column_problems(train: DataFrame, test: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """column, side, problem, rows: columns missing on a side, columns of two types, nulls, and NaN or infinite numbers,
    in one pass over each side; empty where all is well."""
    spark = train.sparkSession
    fixed = [(c, "test", "missing", None) for c in train.columns if c not in test.columns] + [(c, "train", "missing", None) for c in test.columns if c not in train.columns]
    kinds = dict(test.dtypes)
    fixed += [(c, "test", f"type {kinds[c]} for {k}", None) for c, k in train.dtypes if c in kinds and kinds[c] != k]
    fixed += [(c, side, "twice", None) for side, df in (("train", train), ("test", test)) for c in sorted({c for c in df.columns if df.columns.count(c) > 1})]
    out = spark.createDataFrame(fixed, "column string, side string, problem string, rows long")
    for side, df in (("train", train), ("test", test)):
        checks = []
        for c, k in df.dtypes:
            if c in keys or df.columns.count(c) > 1:
                continue
            checks.append(F.struct(F.lit(c).alias("column"), F.lit("null").alias("problem"), F.count_if(F.col(c).isNull()).alias("rows")))
            if k in ("double", "float"):
                odd = F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
                checks.append(F.struct(F.lit(c).alias("column"), F.lit("not finite").alias("problem"), F.count_if(odd).alias("rows")))
        if checks:
            found = df.agg(F.array(*checks).alias("x")).select(F.explode("x").alias("x")).select("x.column", F.lit(side).alias("side"), "x.problem", "x.rows").where("rows > 0")
            out = out.unionByName(found)
    return out


def list_problems(lists: DataFrame, rank: str = "rank") -> DataFrame:
    """problem, n of ranked lists (query_id, item_id, rank from 1): repeated items, null ids, and queries whose ranks are
    not 1, 2, 3 without a gap; zeros where all is well."""
    per = lists.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min(rank).alias("lo"), F.max(rank).alias("hi"), F.count_distinct(rank).alias("d"))
    broken = per.where((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("d") != F.col("n"))).agg(F.count(F.lit(1)).alias("n"))
    repeated = lists.groupBy("query_id", "item_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(F.count(F.lit(1)).alias("n"))
    null = lists.agg(F.count_if(F.col("query_id").isNull() | F.col("item_id").isNull()).alias("n"))
    parts = [df.select(F.lit(name).alias("problem"), "n") for name, df in (("gap in ranks", broken), ("null id", null), ("repeated item", repeated))]
    return reduce(DataFrame.unionByName, parts)


def submission(preds: DataFrame, sample: DataFrame, key: str, value: str, low: float | None = None, high: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, problems): the values by the keys of a sample, in no other order than its keys', and problem, n: keys of
    the sample without a value, predictions of no key of it, repeated predictions, values outside low to high."""
    one = preds.groupBy(key).agg(F.max(value).alias(value), F.count(F.lit(1)).alias("__n"))
    rows = sample.select(key).distinct().join(one, key, "left")
    outside = F.lit(False) if low is None else (F.col(value) < low) | (F.col(value) > high)
    odd = rows.agg(F.count_if(F.col(value).isNull()).alias("missing"), F.count_if(F.col("__n") > 1).alias("repeated"), F.count_if(outside).alias("outside"))
    extra = one.join(sample.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("extra")).scalar()
    odd = odd.withColumn("extra", extra)
    kinds = [F.struct(F.lit(c).alias("problem"), F.col(c).alias("n")) for c in ("extra", "missing", "outside", "repeated")]
    return rows.select(key, value), odd.select(F.explode(F.array(*kinds)).alias("x")).select("x.*")

