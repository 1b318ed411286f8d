"""The greatest inner products of queries with items, from arrays in the shared folder.

Items lie there by falling norm. A query's product with an item is at most the product of their norms, so that each query
leaves the list where this falls below its k-th best so far: all pairs are decided, few are multiplied.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.neighbours import _read, _write
from millrace.session import cut, kept_folder

BLOCK = 1000
TILE = 1024
FIRST = 4096
HELD = 2_000_000
GROUP = 30_000


def _best(row: np.ndarray, place: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k greatest of each row, in the order of row, score and place."""
    order = np.lexsort((place, -score, row))
    start = np.flatnonzero(np.diff(row[order], prepend=-1))
    rank = np.arange(len(row)) - np.repeat(start, np.diff(start, append=len(row)))
    order = order[rank < k]
    return row[order], place[order], score[order]


def greatest(queries: np.ndarray, items: np.ndarray, norms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row of the query, place of the item and product in double precision of the k greatest of each query, ties by place.
    items: float32, by falling norm. Products in single precision only leave out what lies below by more than their error."""
    exact = queries.astype(np.float64)
    size, n = np.sqrt((exact * exact).sum(1)), len(items)
    unit = (exact / np.where(size > 0, size, 1)[:, None]).astype(np.float32)
    error = (items.shape[1] + 2) * 2.0**-22
    # per unit of the query's norm: what its k-th best is at least
    least = np.full(len(queries), -np.inf)
    if n > k and k < FIRST:
        for a in range(0, len(queries), BLOCK):
            first = unit[a : a + BLOCK] @ items[:FIRST].T
            least[a : a + BLOCK] = np.partition(first, first.shape[1] - k, axis=1)[:, first.shape[1] - k] - 2 * error * norms[0]
    least[size == 0] = np.inf
    order, out = np.argsort(least, kind="stable"), []
    scores, over = np.empty(BLOCK * TILE, np.float32), np.empty(BLOCK * TILE, bool)
    for a in range(0, len(queries), BLOCK):
        own = order[a : a + BLOCK]
        low, at, width = least[own], 0, FIRST
        zero, few = np.flatnonzero(size[own] == 0), min(k, n)
        best = np.repeat(zero, few), np.tile(np.arange(few), len(zero)), np.zeros(len(zero) * few)  # all products are 0
        while at < n and len(live := np.flatnonzero(low < norms[at] * (1 + 1e-9))):
            found, held, end = [best], 0, min(at + width, n)
            while at < end and held < HELD:
                x = items[at : min(at + TILE, end)]
                shape, cells = (len(live), len(x)), len(live) * len(x)
                s = np.matmul(unit[own[live]], x.T, out=scores[:cells].reshape(shape))
                bound = (low[live] - error * norms[at]).astype(np.float32)[:, None]
                hit = np.flatnonzero(np.greater(s, bound, out=over[:cells].reshape(shape)))
                r, p = live[hit // len(x)], at + hit % len(x)
                found.append((r, p, np.einsum("ij,ij->i", exact[own[r]], items[p].astype(np.float64))))
                held += len(hit)
                at += len(x)
            best = _best(*[np.concatenate(c) for c in zip(*found)], k)
            ends = np.flatnonzero(np.diff(best[0], append=-1))
            whole = np.bincount(best[0], minlength=len(own))[best[0][ends]] >= k
            r = best[0][ends[whole]]
            r, kth = r[size[own[r]] > 0], best[2][ends[whole]][size[own[r]] > 0]
            low[r] = np.maximum(low[r], kth / size[own[r]])
            width *= 2
        out.append((own[best[0]], best[1], best[2]))
    return tuple(np.concatenate(c) for c in zip(*out))


def greatest_products(items: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query, doc, score: the k items of greatest inner product with each query, ties by the greater norm, then by doc.
    items: doc, vector; queries: query, vector; both ids whole numbers, vectors of floats of one length."""
    spark = items.sparkSession
    folder = kept_folder(spark, "products")
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path)
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    ordered = items.select("doc", norm.alias("norm"), F.col("vector").cast("array<float>").alias("vector")).orderBy(F.desc("norm"), "doc")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, parts = uuid.uuid4().hex, ([np.empty(0, np.int64)], [np.empty(0)], [np.empty(0, np.float32)])
        for b in batches:
            for part, c in zip(parts, (b.column(0).cast(pa.int64()), b.column(1), b.column(2).flatten())):
                part.append(c.to_numpy(zero_copy_only=False))
        for part, kind in zip(parts, ("docs", "norms", "vectors")):
            _write(f"{folder}/{name}.{kind}", *part)
        yield pa.RecordBatch.from_pydict({"part": [TaskContext.get().partitionId()], "name": [name], "n": [sum(map(len, parts[0]))]}, pa.schema({"part": pa.int32(), "name": pa.string(), "n": pa.int64()}))

    files = sorted(ordered.mapInArrow(written, "part int, name string, n long").collect())
    for kind in ("docs", "norms", "vectors"):
        with system.open_output_stream(f"{path}/{kind}") as out:
            for f in files:
                if f.n:
                    out.write(np.ascontiguousarray(_read(f"{folder}/{f.name}.{kind}", np.uint8)))
                system.delete_file(f"{path}/{f.name}.{kind}")
    asked = cut(queries.select("query", F.col("vector").cast("array<float>").alias("vector")))
    kinds = {**dict(asked.dtypes), **dict(items.dtypes)}
    number = {"int": np.int32, "bigint": np.int64}

    def multiplied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, norms, vectors = _read(f"{folder}/docs", np.int64), _read(f"{folder}/norms", np.float64), _read(f"{folder}/vectors", np.float32)

        def run(group: list[pa.RecordBatch]) -> pa.RecordBatch:
            ids = np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in group])
            rows = np.concatenate([b.column(1).flatten().to_numpy(zero_copy_only=False) for b in group]).reshape(len(ids), -1)
            row, place, score = greatest(rows, vectors.reshape(len(docs), -1), norms, k)
            return pa.RecordBatch.from_pydict({"query": ids[row], "doc": docs[place].astype(number[kinds["doc"]]), "score": score})

        group: list[pa.RecordBatch] = []
        for b in batches if len(docs) else ():
            if b.num_rows:
                group.append(b)
            if sum(x.num_rows for x in group) >= GROUP:
                yield run(group)
                group = []
        if group:
            yield run(group)

    tasks = max(asked.count() // (GROUP // 2), 1)
    return asked.repartition(tasks).mapInArrow(multiplied, f"query {kinds['query']}, doc {kinds['doc']}, score double")
