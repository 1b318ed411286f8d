"""Jaccard of the neighbour sets of items that share a scope, from arrays in the shared folder.

Items are numbers in their order. Scopes lie there as lists of numbers; one task a block of items makes the sorted lists
of their neighbours, which are joined in one file. A later task maps this file and takes common neighbours of an item and
each of its neighbours from there: neither wedges nor pairs are rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import cut, kept_folder, materialised

MEMBERS = 200_000_000
MET = 4_000_000


def _write(uri: str, *arrays: np.ndarray) -> None:
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0])
    with system.open_output_stream(path) as out:
        for a in arrays:
            out.write(np.ascontiguousarray(a))


def _read(uri: str, kind: type) -> np.ndarray:
    """The file's numbers; of a folder on this machine, mapped, so that the machine holds them once."""
    system, path = fs.FileSystem.from_uri(uri)
    if system.get_file_info(path).size == 0:
        return np.empty(0, kind)
    if isinstance(system, fs.LocalFileSystem):
        return np.memmap(path, kind, "r").view(np.ndarray)
    with system.open_input_file(path) as f:
        return np.frombuffer(f.read(), kind)


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after the other."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())


class Neighbours:
    """The graph in the shared folder; a copy goes to each task."""

    def __init__(self, items: object, ahead: np.ndarray, folder: str) -> None:
        self.items, self.ahead, self.folder, self.ready = items, ahead, folder, False

    def open(self) -> Neighbours:
        if not self.ready:
            self.names = self.items.value
            self.lists, self.offset = _read(f"{self.folder}/lists", np.int32), np.asarray(_read(f"{self.folder}/offsets", np.int64))
            self.mark, self.ready = np.zeros(len(self.names), bool), True
        return self

    def of(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of its neighbours, ascending, and the jaccard with each."""
        t = len(self.ahead)
        place = self.ahead[item % t] + item // t
        near = self.lists[self.offset[place] : self.offset[place + 1]]
        if not len(near):
            return near, np.empty(0)
        places = self.ahead[near % t] + near // t
        start = self.offset[places]
        length = self.offset[places + 1] - start
        self.mark[near] = True
        if length.sum() <= MET:
            common = np.add.reduceat(self.mark[self.lists[_runs(start, length)]], np.cumsum(length) - length, dtype=np.int64)
        else:
            common = np.array([np.count_nonzero(self.mark[self.lists[a : a + n]]) for a, n in zip(start, length)])
        self.mark[near] = False
        return near, common / (len(near) + length - common)


def _graph(sets: DataFrame, tasks: int) -> Neighbours:
    """sets: x, the different items of a scope."""
    spark = sets.sparkSession
    sc, folder = spark.sparkContext, kept_folder(spark, "neighbours")
    names = np.sort(sets.select(F.explode("x").alias("i")).distinct().toArrow()["i"].to_numpy())
    items, n = sc.broadcast(names), len(names)

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sizes, members = uuid.uuid4().hex, [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        for b in batches:
            x = b.column(0)
            sizes.append(np.diff(x.offsets.to_numpy()).astype(np.int32))
            members.append(np.searchsorted(items.value, x.flatten().to_numpy(zero_copy_only=False)).astype(np.int32))
        _write(f"{folder}/{name}.sizes", *sizes)
        _write(f"{folder}/{name}.members", *members)
        yield pa.RecordBatch.from_pydict({"name": [name]})

    files = [r.name for r in sets.select("x").mapInArrow(numbered, "name string").collect()]

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for block in (b for batch in batches for b in batch["id"]):
            keys, held = [np.empty(0, np.int64)], 0
            for name in files:
                sizes, members = _read(f"{folder}/{name}.sizes", np.int32).astype(np.int64), _read(f"{folder}/{name}.members", np.int32)
                ends = np.cumsum(sizes)
                own = np.flatnonzero(members % tasks == block)
                scope = np.searchsorted(ends, own, side="right")
                size = sizes[scope]
                # members of a few million pairs at a time
                bounds = np.flatnonzero(np.diff(np.cumsum(size) // MET, prepend=0)) if len(size) else []
                for part in np.split(np.arange(len(own)), bounds):
                    other = members[_runs(ends[scope[part]] - size[part], size[part])]
                    me = np.repeat(members[own[part]], size[part])
                    keys.append((me // tasks).astype(np.int64)[me != other] * n + other[me != other])
                    held += len(keys[-1])
                    if held > 5 * MET:
                        keys = [np.unique(np.concatenate(keys))]
                        held = 0
            keys = np.unique(np.concatenate(keys))
            many = len(range(block, n, tasks))
            _write(f"{folder}/{block}-{(name := uuid.uuid4().hex)}", (keys % max(n, 1)).astype(np.int32))
            counts = np.diff(np.searchsorted(keys, np.arange(many + 1) * n))
            _write(f"{folder}/{block}-{name}.counts", counts.astype(np.int64))
            yield pd.DataFrame({"block": [block], "name": [name]})

    made = dict(spark.range(0, tasks, 1, tasks).mapInPandas(listed, "block long, name string").collect())
    system, path = fs.FileSystem.from_uri(folder)
    counts = [np.asarray(_read(f"{folder}/{b}-{made[b]}.counts", np.int64)) for b in range(tasks)]
    _write(f"{folder}/offsets", np.cumsum(np.concatenate([[0], *counts])).astype(np.int64))
    with system.open_output_stream(f"{path}/lists") as out:
        for b in range(tasks):
            out.write(np.ascontiguousarray(_read(f"{folder}/{b}-{made[b]}", np.int32)))
            system.delete_file(f"{path}/{b}-{made[b]}")
    for name in files:
        system.delete_file(f"{path}/{name}.members")
    return Neighbours(items, np.cumsum([0, *map(len, counts)])[:-1], folder)


def graph_of(rows: DataFrame, scope: str) -> tuple[Neighbours, int] | None:
    """rows: different pairs of scope and item_id, a number. The graph, and the number of tasks that suit it; None where
    there are more than MEMBERS pairs, as each task maps the whole graph."""
    sets = materialised(rows.groupBy(scope).agg(F.collect_list("item_id").alias("x")).where(F.size("x") > 1).select("x"), "scopes")
    members = sets.agg(F.coalesce(F.sum(F.size("x")), F.lit(0))).first()[0]
    tasks = max(min(members // 20_000, 32), members // 500_000, 1)
    return None if members > MEMBERS else (_graph(sets, tasks), tasks)


def nearest_neighbours(graph: Neighbours, tasks: int, kind: str, k: int) -> DataFrame:
    """item_i, item_j, jaccard, rank: of each item its k neighbours of greatest jaccard, ties by item."""

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = graph.open()
        for block in (b for batch in batches for b in batch["id"]):
            own = np.arange(block, len(g.names), tasks)
            for a in range(0, len(own), 2000):
                out = []
                for i in own[a : a + 2000]:
                    near, jaccard = g.of(i)
                    at = np.argsort(-jaccard, kind="stable")[:k]
                    out.append((near[at], jaccard[at]))
                size = np.array([len(x) for x, _ in out])
                yield pd.DataFrame({"item_i": g.names[np.repeat(own[a : a + 2000], size)], "item_j": g.names[np.concatenate([x for x, _ in out])], "jaccard": np.concatenate([x for _, x in out]), "rank": (_runs(np.zeros(len(size), np.int64), size) + 1).astype(np.int32)})

    blocks = SparkSession.active().range(0, tasks, 1, tasks)
    return blocks.mapInPandas(ranked, f"item_i {kind}, item_j {kind}, jaccard double, rank int")


def neighbour_candidates(graph: Neighbours, tasks: int, kind: str, hist: DataFrame) -> DataFrame:
    """query_id, item_id, score: the sum over a query's history of the jaccard with its items, in the order of pos."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = graph.open()
        for batch in batches:
            for a in range(0, len(batch), 500):
                part, out = batch.iloc[a : a + 500], []
                for own in part["x"]:
                    ids = np.asarray([x["item_id"] for x in own])
                    at = np.minimum(np.searchsorted(g.names, ids), max(len(g.names) - 1, 0))
                    met = [g.of(i) for i, x in zip(at, ids) if len(g.names) and g.names[i] == x]
                    near = np.concatenate([np.empty(0, np.int32), *[x for x, _ in met]])
                    items, place = np.unique(near, return_inverse=True)
                    out.append((items, np.bincount(place, np.concatenate([np.empty(0), *[x for _, x in met]]), len(items))))
                found = np.concatenate([x for x, _ in out])
                ids = part["query_id"].to_numpy().repeat([len(x) for x, _ in out])
                yield pd.DataFrame({"query_id": ids, "item_id": g.names[found], "score": np.concatenate([x for _, x in out])})

    rows = cut(hist.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("pos", "item_id"))).alias("x")).repartition(tasks))
    return rows.mapInPandas(summed, f"query_id {dict(rows.dtypes)['query_id']}, item_id {kind}, score double")
