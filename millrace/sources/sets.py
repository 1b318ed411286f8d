"""Datasets, indexers, and tables kept under a folder: feature sets, packages by content, submissions."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.quality import running_counts
from millrace.sources.frames import adapt_interactions, epoch_or_text, read_table, renamed, required


@dataclass
class Schema:
    """Names of source columns by canonical name, and whether queries are sessions or users."""

    interactions: Mapping[str, str] = field(default_factory=dict)
    items: Mapping[str, str] = field(default_factory=dict)
    queries: Mapping[str, str] = field(default_factory=dict)
    scope: str = "session_id"


@dataclass
class Dataset:
    interactions: DataFrame
    items: DataFrame | None
    queries: DataFrame | None
    indexers: Indexers | None = None


def load_items(spark: SparkSession, path: str, names: Mapping[str, str]) -> DataFrame:
    return required(renamed(read_table(spark, path), names), ["item_id"])


def load_queries(spark: SparkSession, path: str | None, names: Mapping[str, str]) -> DataFrame | None:
    """Queries with canonical names and ts_query as a UTC moment; None without a path."""
    if path is None:
        return None
    df = required(renamed(read_table(spark, path), names), ["query_id"])
    return df.withColumn("ts_query", epoch_or_text(F.col("ts_query"), df.schema["ts_query"].dataType)) if "ts_query" in df.columns else df


def load_datasets(spark: SparkSession, schema: Schema, interactions: str, items: str | None = None, queries: str | None = None, cutoff: str | None = None, index: bool = False) -> Dataset:
    """The three tables under canonical names, interactions without whole-row copies and up to the cutoff, and with
    `index` the numbers of users, items (of the item table where there is one) and sessions."""
    log = adapt_interactions(read_table(spark, interactions), schema.interactions, cutoff)
    dim = load_items(spark, items, schema.items) if items else None
    made = None
    if index:
        sources = {"user_id": log, "item_id": log if dim is None else dim, "session_id": log}
        made = Indexers.of({c: df for c, df in sources.items() if c in df.columns})
    return Dataset(log, dim, load_queries(spark, queries, schema.queries), made)


def indexed(df: DataFrame, column: str) -> DataFrame:
    """`column`, `idx`: the distinct values that are not null, numbered from 0 in their order."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("n", F.lit(1).cast("long"))
    return running_counts(values, column, ["n"]).select(column, (F.col("cum_n") - 1).alias("idx"))


@dataclass
class Indexers:
    """Numbers of the values of columns, as tables of (value, idx)."""

    tables: dict[str, DataFrame]

    @classmethod
    def of(cls, sources: Mapping[str, DataFrame]) -> Indexers:
        return cls({c: indexed(df, c) for c, df in sources.items()})

    def apply(self, df: DataFrame, unknown: int = -1) -> DataFrame:
        """df with {column without _id}_idx for each column it has; values not met and nulls: unknown."""
        for c, t in self.tables.items():
            if c in df.columns:
                name = f"{c.removesuffix('_id')}_idx"
                df = df.join(t.select(F.col(c).alias("__v"), F.col("idx").alias(name)), F.col(c) == F.col("__v"), "left").drop("__v").fillna(unknown, [name])
        return df

    def save(self, path: str) -> None:
        for c, t in self.tables.items():
            t.write.mode("overwrite").parquet(f"{path}/{c}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, columns: Sequence[str]) -> Indexers:
        return cls({c: spark.read.parquet(f"{path}/{c}") for c in columns})


def fingerprint(notes: Mapping[str, Any]) -> str:
    """SHA-256 of a mapping as JSON with sorted keys: the same on every machine."""
    return hashlib.sha256(json.dumps(notes, sort_keys=True, default=str).encode()).hexdigest()


def _write_notes(spark: SparkSession, path: str, notes: Mapping[str, Any]) -> None:
    spark.createDataFrame([(json.dumps(notes, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read_notes(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(path).first()[0])


def kept(spark: SparkSession, folder: str, notes: Mapping[str, Any], make) -> DataFrame:
    """The table that make() gives, kept under the fingerprint of its notes (parameters, code version, source stamps):
    made and written at the first call, read at later ones."""
    path = f"{folder.rstrip('/')}/{fingerprint(notes)}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/table/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(f"{path}/table")
        _write_notes(spark, f"{path}/notes", notes)
    return spark.read.parquet(f"{path}/table")


def write_set(path: str, train: DataFrame, test: DataFrame, keys: Sequence[str], y: str | None = None, folds: DataFrame | None = None, meta: Mapping[str, Any] | None = None) -> None:
    """A feature set: train and test matrices with the same feature columns of the same types, the target in train,
    folds (keys, fold) for the train keys. Differences, null or repeated keys are errors, and nothing is written."""
    features = [c for c in train.columns if c not in {*keys, y}]
    if sorted(features) != sorted(c for c in test.columns if c not in {*keys, y}):
        raise ValueError("train and test have different features")
    kinds = dict(test.dtypes)
    if wrong := [c for c, k in train.dtypes if c in features and kinds[c] != k]:
        raise ValueError(f"columns of different types: {', '.join(wrong)}")
    for name, df in (("train", train), ("test", test)):
        n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        if not n.where((F.col("n") > 1) | F.greatest(*[F.col(k).isNull().cast("int") for k in [*keys, keys[0]]]).cast("boolean")).isEmpty():
            raise ValueError(f"null or repeated keys in {name}")
    if folds is not None and not train.select(*keys).join(folds.select(*keys).distinct(), list(keys), "left_anti").isEmpty():
        raise ValueError("train rows without a fold")
    train.select(*keys, *features, *([y] if y else [])).write.mode("overwrite").parquet(f"{path}/train")
    test.select(*keys, *features).write.mode("overwrite").parquet(f"{path}/test")
    if folds is not None:
        folds.write.mode("overwrite").parquet(f"{path}/folds")
    _write_notes(train.sparkSession, f"{path}/notes", {"keys": list(keys), "features": features, "y": y, "folds": folds is not None, "meta": dict(meta or {})})


def read_set(spark: SparkSession, path: str) -> dict[str, Any]:
    """train, test, folds (None without) and the notes of a set that write_set wrote."""
    notes = _read_notes(spark, f"{path}/notes")
    out = {name: spark.read.parquet(f"{path}/{name}") for name in ("train", "test")}
    return notes | out | {"folds": spark.read.parquet(f"{path}/folds") if notes["folds"] else None}


def sparse_rows(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """keys, indices, values: the numbers of a row that are neither null nor 0, with the places of their columns."""
    cells = F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)])
    full = F.filter(cells, lambda s: s["x"].isNotNull() & (s["x"] != 0))
    return df.select(*keys, F.transform(full, lambda s: s["i"]).alias("indices"), F.transform(full, lambda s: s["x"]).alias("values"))


def write_lists(df: DataFrame, path: str, query: str, item: str, rank: str, form: str = "pairs") -> None:
    """Ranked lists as CSV: pairs, a row for each item in the order of rank within its query's rows; or spaced, a row for
    each query with its items between blanks."""
    if form == "pairs":
        df.repartition(F.col(query)).sortWithinPartitions(query, rank).select(query, item).write.mode("overwrite").option("header", True).csv(path)
        return
    items = F.transform(F.array_sort(F.collect_list(F.struct(rank, item))), lambda x: x[item].cast("string"))
    df.groupBy(query).agg(F.concat_ws(" ", items).alias(item)).write.mode("overwrite").option("header", True).csv(path)
