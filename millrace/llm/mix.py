"""Mixing sources to target shares of tokens, with capped repetition."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import cut

BUCKET_TOKENS = 1 << 24
# Fixed value: the public byte-level tokenizers' pattern of pieces
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def tokenized(docs: DataFrame, doc_id: str, text: str, source: str, path: str) -> DataFrame:
    """`id`, `source` (without case and outer blanks), `tokens` of every document with id, text and source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer(path).encode_ordinary
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "source": b["source"], "tokens": [np.array(encode(x), np.int32) for x in b["text"]]})

    src = docs.select(F.col(doc_id).alias("id"), F.lower(F.btrim(F.col(source))).alias("source"), F.col(text).alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    return src.where("id IS NOT NULL AND source IS NOT NULL AND text <> ''").mapInPandas(run, f"id {kind}, source string, tokens array<int>")


def plan_blocks(available: dict[str, int], shares: dict[str, float], repeats: dict[str, int], total: int, short: float = 0.1) -> dict[str, int]:
    """Tokens (or any other unit) of each source in a mix of at most `total`, given what it has.

    The total is the largest, up to `total`, of which all sources can fill their share with what they have times
    their repeats, not counting sources that hold it down most, as long as these have less than `short` of all
    shares together: those give all they can up to their share, and the others keep their shares to each other.
    A source without anything to give is none of these: it is left out, whatever its share.
    """
    cap = {s: available.get(s, 0) * max(0, repeats[s]) for s in shares}
    mass = sum(shares.values()) or 1.0
    norm = {s: x / mass for s, x in shares.items()}
    tight = sorted((s for s in shares if norm[s] > 0), key=lambda s: cap[s] / norm[s])
    left_out = {s for s in tight if cap[s] == 0}
    lacking = 0.0
    for s in tight[len(left_out) :]:
        lacking += norm[s]
        if cap[s] / norm[s] >= total or lacking >= short:
            break
        left_out.add(s)
    full = [s for s in tight if s not in left_out]
    weight = sum(norm[s] for s in full)
    given = {s: min(cap[s], int(total * norm[s])) for s in left_out}
    size = min([total - sum(given.values()), *(cap[s] * weight / norm[s] for s in full)]) if full else 0
    return {s: given[s] if s in left_out else min(cap[s], int(size * norm[s] / weight + 1e-9)) if s in full else 0 for s in shares}


def _permuted(x: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1 for each key: a Feistel network on the next power of four, walked
    again until it falls below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))).astype(np.int64) + 1) // 2).astype(np.uint64)
    low = (np.uint64(1) << half) - np.uint64(1)
    out, open_ = x.astype(np.uint64), np.ones(len(x), bool)
    while open_.any():
        i = np.flatnonzero(open_)
        left, right = out[i] >> half[i], out[i] & low[i]
        for r in range(4):
            f = (right + key[i] + np.uint64(r + 1)) * np.uint64(0x9E3779B97F4A7C15)
            f = (f ^ (f >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(29)) & low[i])
        out[i] = (left << half[i]) | right
        open_[i] = out[i] >= n[i].astype(np.uint64)
    return out.astype(np.int64)


@dataclass(frozen=True)
class Slots:
    """Planned slots of a mix: for each source, in order, its slots' end, its blocks and a key."""

    ends: np.ndarray
    blocks: np.ndarray
    keys: np.ndarray
    seed: int

    def placed(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Source number, block and use of each slot."""
        n = self.ends[-1]
        x = _permuted(slots, np.full(len(slots), n), np.full(len(slots), self.seed, np.uint64))
        s = np.searchsorted(self.ends, x, side="right")
        number = x - np.r_[0, self.ends[:-1]][s]
        use = number // self.blocks[s]
        key = self.keys[s] + use.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return s, _permuted(number % self.blocks[s], self.blocks[s], key), use


def mixed(
    docs: DataFrame, targets: DataFrame, *, doc_id: str, text: str, source: str, share: str, repeats: str,
    tokenizer_path: str, block: int = 1024, total_tokens: int | None = None, shard_blocks: int = 256, seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(mix, shares). mix: `shard`, `slot`, `source`, `block`, `use`, `n_tokens`, `doc_ids`, `tokens`, one row for
    each block of the mix. shares: of every target source `target_share`, `documents`, `available_tokens`,
    `max_repeats`, `mix_tokens`, `actual_share` of the mix's tokens, and `uses` of its most used block.

    Sources compare without case and outer blanks; documents of other or null sources, with null id or without
    text are not in the mix; a target named twice counts with its first share. Targets without documents, with
    null or negative share or repeats get nothing. total_tokens: default all tokens of target sources; for what
    a mix of it can hold see plan_blocks. Copies of a document are documents.

    The plan is made in tokens; a source gives the number of blocks whose mean length fills its part.

    Method: the documents of a source, in the order of a seeded hash, are one stream of tokens, cut in blocks of
    `block` tokens (the last may be shorter); offsets are sums over hash buckets of about BUCKET_TOKENS tokens and
    within them, so no source is in one task. All slots of the mix pass through one pseudorandom permutation of the
    planned totals: the counts of the sources in a shard are so a multinomial draw conditioned on these totals,
    made on the executors slot by slot, for any number of shards and blocks. The slots of a source pass through
    pseudorandom permutations of its blocks, another one for each round of repetition, so no block, and no
    document's token, comes more often than the rounds; slots and blocks are joined by index. The targets are a
    control table: they alone, with a sum for each, come to the driver.
    """
    spark = docs.sparkSession
    wanted: dict[str, tuple[float, int]] = {}
    for r in targets.select(F.lower(F.btrim(F.col(source))).alias("s"), F.col(share).cast("double").alias("x"), F.col(repeats).cast("int").alias("r")).collect():
        if r.s is not None and r.s not in wanted:
            wanted[r.s] = (max(0.0, r.x or 0.0), max(0, r.r or 0))
    names = spark.createDataFrame([(s,) for s in wanted], "source string")
    known = docs.join(F.broadcast(names.select(F.col("source").alias("__target"))), F.lower(F.btrim(docs[source])) == F.col("__target"), "left_semi")
    toks = tokenized(known, doc_id, text, source, tokenizer_path)
    toks = cut(toks.where(F.size("tokens") > 0).withColumns({"n": F.size("tokens"), "h": F.xxhash64("id", F.lit(seed))}))
    have = {r.source: r for r in toks.groupBy("source").agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("docs")).collect()}
    blocks_of = {s: -(-r.t // block) for s, r in have.items()}
    total = total_tokens if total_tokens is not None else sum(r.t for r in have.values())
    plan = plan_blocks({s: r.t for s, r in have.items()}, {s: x for s, (x, _) in wanted.items()}, {s: r for s, (_, r) in wanted.items()}, total)
    slots_of = {s: min(round(n * blocks_of[s] / have[s].t), blocks_of[s] * wanted[s][1]) for s, n in plan.items() if n}

    parts = {s: r.t // BUCKET_TOKENS + 1 for s, r in have.items()}
    number = F.element_at(F.create_map(*[F.lit(x) for kv in (parts or {"": 1}).items() for x in kv]), F.col("source"))
    toks = toks.withColumn("bucket", F.pmod("h", number))
    per = toks.groupBy("source", "bucket").agg(F.sum("n").alias("t"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = per.select("source", "bucket", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("ahead"))
    run = Window.partitionBy("source", "bucket").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0)
    placed = toks.join(ahead, ["source", "bucket"]).withColumn("start", F.col("ahead") + F.sum("n").over(run) - F.col("n"))
    size = F.lit(block)
    first, last = F.floor(F.col("start") / size), F.floor((F.col("start") + F.col("n") - 1) / size)
    cuts = placed.select("source", "id", "start", "n", "tokens", F.explode(F.sequence(first, last)).alias("block"))
    frm = F.greatest(F.col("block") * size - F.col("start"), F.lit(0))
    upto = F.least((F.col("block") + 1) * size - F.col("start"), F.col("n"))
    piece = F.struct((F.col("start") + frm).alias("at"), F.col("id").alias("id"), F.slice("tokens", (frm + 1).cast("int"), (upto - frm).cast("int")).alias("tokens"))
    packed = cuts.groupBy("source", "block").agg(F.sort_array(F.collect_list(piece)).alias("p"))  # at most `block` pieces
    packed = packed.select("source", "block", F.col("p.id").alias("doc_ids"), F.flatten("p.tokens").alias("tokens"))

    order = [s for s, n in slots_of.items() if n]
    slots = sum(slots_of[s] for s in order)
    held = Slots(np.cumsum([slots_of[s] for s in order] or [0]), np.array([blocks_of[s] for s in order] or [1]), np.array([zlib.crc32(s.encode()) for s in order] or [0], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed), seed)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b["id"].to_numpy(np.int64)
            s, own, use = held.placed(x)
            yield pd.DataFrame({"shard": x // shard_blocks, "slot": (x % shard_blocks).astype(np.int32), "source": np.array(order, object)[s], "block": own, "use": use})

    each = spark.range(0, slots, 1, slots // 65_536 + 1).mapInPandas(draw, "shard long, slot int, source string, block long, use long")
    mix = each.join(packed, ["source", "block"]).select("shard", "slot", "source", "block", "use", F.size("tokens").alias("n_tokens"), "doc_ids", "tokens")

    final = spark.createDataFrame(
        [(s, x, have[s].docs if s in have else 0, have[s].t if s in have else 0, r) for s, (x, r) in wanted.items()],
        "source string, target_share double, documents long, available_tokens long, max_repeats int",
    )
    # all blocks of a source are full but its last
    ends = spark.createDataFrame([(s, n - 1, have[s].t - (n - 1) * block) for s, n in blocks_of.items()], "source string, last long, short long")
    length = F.when(F.col("block") == F.col("last"), F.col("short")).otherwise(F.lit(block))
    used = each.join(F.broadcast(ends), "source").groupBy("source").agg(F.sum(length).alias("mix_tokens"), (F.max("use") + 1).cast("int").alias("uses"))
    final = final.join(F.broadcast(used), "source", "left").fillna(0, ["mix_tokens", "uses"])
    everything = F.sum("mix_tokens").over(Window.partitionBy(F.lit(0)))
    return mix, final.withColumn("actual_share", F.when(everything > 0, F.col("mix_tokens") / everything).otherwise(0.0))
