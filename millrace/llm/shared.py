"""Long stretches that appear verbatim in more than one record."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.splits import attached
from millrace.session import cut, materialised

DEPTH = 2
MAX_BITS = 28
BLOCK_BITS = 16
STEP = 250_000
HOT_ROWS = 200_000
HOT_CLASSES = 4096
_BASE = 6_364_136_223_846_793_005
_INVERSE = pow(_BASE, -1, 1 << 64)
_ROW = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    up = down = np.empty(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            n = 1 << n.bit_length()
            ones = [np.full(n, b, np.uint64) for b in (_BASE, _INVERSE)]
            for x in ones:
                x[0] = 1
            cls.up, cls.down = (np.multiply.accumulate(x) for x in ones)
        return cls.up, cls.down


def _windows(points: np.ndarray, length: int, sums: np.ndarray) -> np.ndarray:
    """Hash of the window of `length` at each place: a polynomial of its code points, from running sums."""
    up, _ = _Powers.of(len(points))
    n = len(points) - length + 1
    return _mix((sums[length:] - sums[:n]) * up[:n])


def fingerprints(text: str, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For every window of `length` code points: its hash, and its representative, the least hash of the
    half as long windows within. Equal windows have equal representatives, and neighbours mostly share theirs."""
    points = _mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1))
    if len(points) < length:
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    _, down = _Powers.of(len(points))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(points * down[: len(points)])])
    half = length // 2
    small, whole = _windows(points, half, sums), _windows(points, length, sums)
    span, least = length - half + 1, small
    width = 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    return whole, least[: len(whole)]


def _cells(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    return [((keys * m) >> np.uint64(64 - bits)).astype(np.int64) for m in _ROW]


def _pieces(texts: list[str], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Windows of texts, many texts at a time: number of the text, number of its piece, place in the text, hash and
    representative of every window. Texts are cut in pieces of STEP windows, so that no array follows the length of
    a text, and pieces are put together up to about STEP characters."""
    held: list[tuple[int, int, str]] = []
    size = 0
    for k, text in enumerate(texts):
        for start in range(0, len(text) - length + 1, STEP):
            piece = text[start : start + STEP + length - 1]
            held.append((k, start, piece))
            size += len(piece)
            if size >= STEP:
                yield _together(held, length)
                held, size = [], 0
    if held:
        yield _together(held, length)


def _together(held: list[tuple[int, int, str]], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    sizes = np.array([len(t) for _, _, t in held])
    n = sizes - length + 1
    whole, least = fingerprints("".join(t for _, _, t in held), length)
    piece = np.repeat(np.arange(len(held)), n)
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(np.cumsum(sizes) - sizes, n) + inside
    text, start = (np.array([x[i] for x in held])[piece] for i in (0, 1))
    return text, piece, start + inside, whole[at], least[at]


def _runs(piece: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Places where a piece's representative changes."""
    return np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (piece[1:] != piece[:-1])])


def _sketch(length: int, bits: int):
    """The count-min sketch of a task, in blocks: of each the cells that are hit once and those hit more often, by
    representatives counted once a piece of text. Only touched cells are held, whatever the size of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list[np.ndarray]] = [[] for _ in _ROW]
        for batch in batches:
            for _, piece, _, _, least in _pieces(batch.column("text").to_pylist(), length):
                at = _runs(piece, least)
                keys, owner = least[at], piece[at]
                order = np.lexsort((owner, keys))
                keys, owner = keys[order], owner[order]
                keys = keys[np.r_[True, (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])]]
                for held, cells in zip(rows, _cells(keys, bits)):
                    held.append(cells)
        size = 1 << min(bits, BLOCK_BITS)
        out: dict[str, list] = {"block": [], "once": [], "often": []}
        for d, held in enumerate(rows):
            if not held:
                continue
            cells, n = np.unique(np.concatenate(held), return_counts=True)
            starts = np.flatnonzero(np.r_[True, cells[1:] // size != cells[:-1] // size])
            for i, j in zip(starts, np.r_[starts[1:], len(cells)]):
                own, many = (cells[i:j] % size).astype(np.uint16), n[i:j] > 1
                out["block"].append((d << max(0, bits - BLOCK_BITS)) + int(cells[i] // size))
                out["once"].append(own[~many].tobytes())
                out["often"].append(own[many].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out["block"], pa.int32()), pa.array(out["once"], pa.binary()), pa.array(out["often"], pa.binary())], list(out))

    return run


def _merge(size: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(size, np.uint8)
        for once, often in zip(pdf["once"], pdf["often"]):
            cells = np.frombuffer(once, np.uint16)
            total[cells] = np.minimum(2, total[cells] + 1)
            total[np.frombuffer(often, np.uint16)] = 2
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "repeated": [np.packbits(total > 1).tobytes()]})

    return run


def sketch_bits(docs: DataFrame, text: str, length: int) -> int:
    """Bits of a sketch with four counters for each representative expected in the texts, 16 to MAX_BITS."""
    chars = docs.agg(F.sum(F.length(text))).first()[0] or 0
    return min(MAX_BITS, max(16, math.ceil(math.log2(8 * chars / (length - length // 2 + 2) + 1))))


def repeated_windows(docs: DataFrame, doc_id: str, text: str, length: int = 300, bits: int | None = None) -> DataFrame:
    """`id`, `v`, `pos`, `h`, `first`: every window of `length` code points whose representative is estimated to be
    in more than one piece of text, by id, hash of the text and 0-based place, with its hash, and whether it is the
    first of its hash in its piece. All windows that are in two texts are among them.

    bits: size of the sketch, by default from the number of characters (sketch_bits). Its bit map of at most
    2 x 2^MAX_BITS bits (64 MB) is broadcast; a fuller sketch lets more windows through and loses none."""
    src = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= length))
    if bits is None:
        bits = sketch_bits(src, "text", length)
    if not 3 <= bits <= MAX_BITS:
        raise ValueError(f"bits must be 3 to {MAX_BITS}")
    size = 1 << min(bits, BLOCK_BITS)
    sketches = src.select("text").mapInArrow(_sketch(length, bits), "block int, once binary, often binary")
    merged = sketches.groupBy("block").applyInPandas(_merge(size), "block int, repeated binary").collect()
    table = np.zeros((DEPTH * (1 << bits) // size, size // 8), np.uint8)
    for r in merged:
        table[r["block"]] = np.frombuffer(r["repeated"], np.uint8)
    held = docs.sparkSession.sparkContext.broadcast(table.reshape(DEPTH, -1))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        for batch in batches:
            for owner, piece, pos, whole, least in _pieces(batch.column("text").to_pylist(), length):
                starts = _runs(piece, least)
                often = np.ones(len(starts), bool)
                for row, cells in zip(table, _cells(least[starts], bits)):
                    often &= (row[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1
                if not often.any():
                    continue
                at = np.flatnonzero(np.repeat(often, np.diff(np.r_[starts, len(whole)])))
                h, p = whole[at], piece[at]
                order = np.lexsort((at, h, p))
                first = np.ones(len(at), bool)
                first[order[1:]] = (h[order[1:]] != h[order[:-1]]) | (p[order[1:]] != p[order[:-1]])
                take = pa.array(owner[at])
                columns = [batch.column("id").take(take), batch.column("v").take(take), pa.array(pos[at].astype(np.int32)), pa.array(h.view(np.int64)), pa.array(first)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "v", "pos", "h", "first"])

    kind = src.schema["id"].dataType.simpleString()
    return src.select("id", F.xxhash64("text").alias("v"), "text").mapInArrow(emit, f"id {kind}, v long, pos int, h long, first boolean")


def _texts(docs: DataFrame, doc_id: str, text: str, length: int) -> DataFrame:
    return docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= length))


def _met(rows: DataFrame, classes: DataFrame, total: int) -> DataFrame:
    """rows joined with the class of their hash; classes of more than 1/HOT_CLASSES of all rows, fewer than
    HOT_CLASSES, are broadcast, so that their rows need not meet in one task."""
    least = max(HOT_ROWS, total // HOT_CLASSES)
    hot = classes.where(F.col("n") > least)
    if total <= HOT_ROWS or hot.isEmpty():
        return rows.join(classes, "h")
    near = rows.join(F.broadcast(hot), "h")
    return near.unionByName(rows.join(F.broadcast(hot.select("h")), "h", "left_anti").join(classes.where(F.col("n") <= least), "h"))


def shared_classes(docs: DataFrame, doc_id: str, text: str, length: int = 300, bits: int | None = None) -> DataFrame:
    """`class`, `members`, `doc_id`: groups of records that all hold one window of `length` code points. Any two
    records that have a stretch of that length in common are in a class together, and no others are. Neighbouring
    windows of the same records are one class, so that m copies of a text are one class of m rows.

    Null, empty and shorter texts are in no class; rows with null id are left out; repeated rows of one id are one
    record; other columns are ignored.

    Method: count-min prefilter (repeated_windows), then exact groups of the windows estimated repeated. Of windows
    that follow each other in their record of least id and have the same records (their number, and a sum of 24 bits
    and the exclusive or of 64 bits of their ids' hashes) the first stays. Its text is taken from every record, and a
    class is the records whose texts have one SHA-256 digest beside the window's hash.
    """
    windows = materialised(repeated_windows(docs, doc_id, text, length, bits).where("first").select("id", "pos", "h"), "windows")
    total = windows.count()
    k = F.xxhash64("id", F.lit(3))
    sums = [F.sum(k.bitwiseAND(F.lit((1 << 24) - 1))).alias("s"), F.bit_xor(k).alias("x")]
    classes = windows.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "pos")).alias("lead"), *sums).where("n > 1")
    w = Window.partitionBy("lead.id").orderBy("lead.pos")
    same = F.col("lead.pos") == F.lag("lead.pos").over(w) + 1
    for c in ("n", "s", "x"):
        same = same & (F.col(c) == F.lag(c).over(w))
    heads = cut(classes.withColumn("same", F.coalesce(same, F.lit(False))).where(~F.col("same")).select("h", "n"))
    members = _met(windows, heads, total).select("h", "id", "pos").distinct()
    digest = F.unhex(F.sha2(F.substring("text", F.col("pos") + 1, F.lit(length)), 256))
    own = members.join(_texts(docs, doc_id, text, length), "id").select("h", "id", digest.alias("digest"))
    own = cut(own.distinct())
    sizes = own.groupBy("h", "digest").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    sizes = cut(sizes.select("h", F.col("digest").alias("d"), F.monotonically_increasing_id().alias("class"), "members", F.col("members").alias("n")))
    return _met(own, sizes, total).where("digest = d").select("class", "members", F.col("id").alias(doc_id))


def pairs_within(classes: DataFrame, item: str, block: int = 512) -> DataFrame:
    """`a` < `b`: all pairs of items in a class of shared_classes, each once. For results that ask for the pairs
    themselves: a class of m items gives m (m - 1) / 2 rows, so large ones are cut in blocks that meet in different
    tasks."""
    many = F.ceil(F.col("members") / F.lit(block)).cast("long")
    rows = cut(classes.select("class", F.col(item).alias("x"), many.alias("many")).withColumn("k", F.pmod(F.xxhash64("x"), F.col("many"))))
    zero = F.lit(0).cast("long")
    left = rows.select("class", F.col("x").alias("a"), F.col("k").alias("ka"), F.explode(F.sequence(F.col("k"), F.col("many") - 1)).alias("kb"))
    right = rows.select("class", F.col("x").alias("b"), F.explode(F.sequence(zero, F.col("k"))).alias("ka"), F.col("k").alias("kb"))
    met = left.join(right, ["class", "ka", "kb"]).where("(ka < kb AND a <> b) OR a < b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def shared_pairs(docs: DataFrame, doc_id: str, text: str, length: int = 300, bits: int | None = None) -> DataFrame:
    """`doc_a` < `doc_b`: the pairs of records that have a stretch of at least `length` code points in common, which
    are those of shared_classes; copies of a text under several ids are pairs."""
    pairs = pairs_within(shared_classes(docs, doc_id, text, length, bits), doc_id)
    return pairs.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"))


def shared_stretches(docs: DataFrame, doc_id: str, text: str, length: int = 300, bits: int | None = None) -> DataFrame:
    """`doc_id`, `start` (0-based), `length`, `other_id`, `other_start`: stretches of each record that are verbatim in
    another. Every window of `length` code points that is in another record lies in one of them.

    A window's other record is the least that holds it, for the least itself the greatest; a stretch goes on while
    the next window is at the next place of the same other record, so that its whole text stands there. Stretches of
    a record can overlap by up to length - 1 characters where the other record changes. Cases as in shared_classes;
    different texts of one id have stretches of their own. The texts of a stretch and of the other record are compared;
    where windows of one hash differ, the stretch is cut to those that agree.
    """
    windows = materialised(repeated_windows(docs, doc_id, text, length, bits).distinct(), "windows")
    total = windows.count()
    place = F.struct("id", "pos", "v")
    classes = windows.where("first").groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("low"), F.max(place).alias("high")).where("low.id < high.id")
    met = _met(windows.select("id", "v", "pos", "h"), cut(classes), total)
    other = F.when(F.col("id") == F.col("low.id"), F.col("high")).otherwise(F.col("low"))

    def spans(at: DataFrame) -> DataFrame:
        w = Window.partitionBy("id", "v").orderBy("pos")
        on = (F.col("pos") == F.lag("pos").over(w) + 1) & (F.col("o.id") == F.lag("o.id").over(w)) & (F.col("o.v") == F.lag("o.v").over(w)) & (F.col("o.pos") == F.lag("o.pos").over(w) + 1)
        no = F.sum(F.when(F.coalesce(on, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
        return at.withColumn("no", no).groupBy("id", "v", "no").agg(F.min("pos").alias("start"), (F.max("pos") - F.min("pos") + length).alias("length"), F.min_by("o", "pos").alias("o"))

    found = cut(spans(met.select("id", "v", "pos", other.alias("o"))))
    texts = _texts(docs, doc_id, text, length).withColumn("v", F.xxhash64("text"))
    own = found.join(texts, ["id", "v"]).select("id", "v", "start", "length", "o", F.substring("text", F.col("start") + 1, F.col("length")).alias("s"))
    there = texts.select(F.struct("id", "v").alias("k"), F.col("text").alias("there"))
    met = attached(own.withColumn("k", F.struct("o.id", "o.v")), "k", there.withColumnRenamed("k", "__k").dropDuplicates(["__k"]), "__k", found.count())
    met = met.withColumn("there", F.substring("there", F.col("o.pos") + 1, F.col("length")))
    alike = F.expr(f"filter(sequence(0, length - {length}), k -> substring(s, k + 1, {length}) = substring(there, k + 1, {length}))")
    checked = cut(met.select("id", "v", "start", "length", "o", F.when(F.col("s") != F.col("there"), alike).alias("alike")).distinct())
    good = checked.where("alike IS NULL").select("id", "start", "length", "o")
    split = checked.where("alike IS NOT NULL").select("id", "v", "start", "o", F.explode("alike").alias("k"))
    if not split.isEmpty():
        at = split.select("id", "v", (F.col("start") + F.col("k")).alias("pos"), F.struct("o.id", (F.col("o.pos") + F.col("k")).alias("pos"), "o.v").alias("o"))
        good = good.unionByName(spans(at).select("id", "start", "length", "o"))
    return good.select(F.col("id").alias(doc_id), "start", "length", F.col("o.id").alias("other_id"), F.col("o.pos").alias("other_start")).distinct()


def shared_shares(docs: DataFrame, doc_id: str, text: str, length: int = 300, bits: int | None = None) -> DataFrame:
    """`doc_id`, `chars`, `stretches`, `shared_chars`, `share` of every record with a text, 0 where nothing is shared:
    the characters that lie in any of its shared_stretches, each once."""
    spans = shared_stretches(docs, doc_id, text, length, bits)
    w = Window.partitionBy(doc_id).orderBy("start", "length").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.max(F.col("start") + F.col("length")).over(w), F.lit(0))
    fresh = F.greatest(F.col("start") + F.col("length") - F.greatest("start", "ahead"), F.lit(0))
    spans = spans.withColumn("ahead", ahead).groupBy(doc_id).agg(F.count(F.lit(1)).alias("stretches"), F.sum(fresh).alias("shared_chars"))
    sizes = docs.where(F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(F.length(text)).alias("chars")).where("chars > 0")
    out = sizes.join(spans, doc_id, "left").fillna(0, ["stretches", "shared_chars"])
    return out.withColumn("share", F.col("shared_chars") / F.col("chars"))
