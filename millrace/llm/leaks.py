"""Held-out evaluation texts inside a training corpus."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.words import _WORD, words
from millrace.session import cut

MAX_TEST_WORDS = 4_000_000
FILTER_BITS = 29
CHARS = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class TestGrams:
    """All n-grams of the test texts: the words of all tests in a row, and for every distinct gram its hash, sorted,
    the place of its words, and the tests that hold it."""

    n: int
    vocabulary: dict[str, int] = field(repr=False)
    line: np.ndarray = field(repr=False)
    hashes: np.ndarray = field(repr=False)
    places: np.ndarray = field(repr=False)
    starts: np.ndarray = field(repr=False)
    tests: np.ndarray = field(repr=False)

    @classmethod
    def build(cls, tests: list[tuple[int, str]], n: int) -> TestGrams:
        vocabulary: dict[str, int] = {}
        ids, lines, places, size = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)], 0
        for test_id, text in tests:
            own = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words(text)], np.int32)
            if len(own) >= n:
                places.append(size + np.arange(len(own) - n + 1))
                ids.append(np.full(len(own) - n + 1, test_id, np.int64))
                lines.append(own)
                size += len(own)
        line, at, i = np.concatenate(lines), np.concatenate(places), np.concatenate(ids)
        h = _fold([line[at + k] for k in range(n)])
        # distinct grams in the order of their hashes; equal hashes of different grams stay apart
        order = np.lexsort((i, *(line[at + k] for k in range(n - 1, -1, -1)), h))
        at, i, h = at[order], i[order], h[order]
        new = np.ones(len(at), bool)
        new[1:] = np.logical_or.reduce([line[at[1:] + k] != line[at[:-1] + k] for k in range(n)])
        starts = np.flatnonzero(new)
        return cls(n, vocabulary, line, h[starts], at[starts].astype(np.int32), np.r_[starts, len(at)], i)

    def hits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text number, word number and gram number of every verified occurrence of a test gram."""
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held, size, first = [], 0, 0
        for k, text in enumerate([*texts, None]):
            if k == len(texts) or size > CHARS:  # so many characters at a time
                at, word, gram = self._hits(held)
                parts.append((at + first, word, gram))
                held, size, first = [], 0, k
            held.append(text)
            size += len(text or "")
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _hits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        get, tokens = self.vocabulary.get, [words(t) if t else [] for t in texts]
        sizes = np.array([len(x) for x in tokens], np.int64)
        w = np.fromiter((get(x, 0) for own in tokens for x in own), np.int32, int(sizes.sum()))
        none = np.empty(0, np.int64)
        if len(w) < self.n or not len(self.hashes):
            return none, none, none
        count = len(w) - self.n + 1
        unknown = np.cumsum(np.r_[0, w == 0])
        text = np.repeat(np.arange(len(sizes)), sizes)
        at = np.flatnonzero((unknown[self.n :] == unknown[:count]) & (text[self.n - 1 :] == text[:count]))
        h = _fold([w[at + k] for k in range(self.n)])
        k = np.searchsorted(self.hashes, h)
        found, gram = [], []
        live = np.flatnonzero((k < len(self.hashes)) & (self.hashes[np.minimum(k, len(self.hashes) - 1)] == h))
        while len(live):  # more than once only where grams collide
            same = (self.line[self.places[k[live]][:, None] + np.arange(self.n)] == w[at[live][:, None] + np.arange(self.n)]).all(axis=1)
            found.append(at[live[same]])
            gram.append(k[live[same]])
            live = live[~same]
            k[live] += 1
            live = live[(k[live] < len(self.hashes))]
            live = live[self.hashes[k[live]] == h[live]]
        f, g = (np.concatenate(found), np.concatenate(gram)) if found else (none, none)
        starts = np.cumsum(np.r_[0, sizes])
        return text[f], f - starts[text[f]], g


def _fold(columns) -> np.ndarray:
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = (out ^ np.asarray(c).astype(np.uint64)) * _BASE
        out ^= out >> np.uint64(29)
    return out


def _scan(grams: TestGrams) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text, word, gram = grams.hits(batch["text"].tolist())
            ids = batch["id"].to_numpy()
            n_tests = grams.starts[gram + 1] - grams.starts[gram]
            each = np.repeat(np.arange(len(gram)), n_tests)
            tests = grams.tests[np.repeat(grams.starts[gram], n_tests) + np.arange(len(each)) - np.repeat(np.cumsum(n_tests) - n_tests, n_tests)]
            t, d, p = tests, text[each], word[each]
            order = np.lexsort((p, d, t))
            t, d, p = t[order], d[order], p[order]
            new = np.r_[True, (t[1:] != t[:-1]) | (d[1:] != d[:-1]) | (p[1:] > p[:-1] + grams.n)][: len(t)]
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(t)][: len(first)] - 1
            yield pd.DataFrame({
                "test_id": t[first], "id": ids[d[first]], "first_word": p[first], "n_words": p[last] - p[first] + grams.n
            })

    return run


def _tests(tests: DataFrame, test_id: str, text: str) -> tuple[DataFrame, bool]:
    """Distinct tests (`t`, `x`), and whether their words, counted before anything is collected, are few enough to be
    broadcast. Characters / 2 bound the number of words."""
    t = tests.select(F.col(test_id).cast("long").alias("t"), F.col(text).alias("x")).where("t IS NOT NULL AND x IS NOT NULL").distinct()
    return t, (t.agg(F.sum((F.length("x") / 2 + 1).cast("long"))).first()[0] or 0) <= MAX_TEST_WORDS


def _held(t: DataFrame, n: int):
    return t.sparkSession.sparkContext.broadcast(TestGrams.build([(r.t, r.x) for r in t.collect()], n))


def _grams(n: int, keep: np.ndarray | None = None):
    """Rows id, p, h, g of the n-grams of texts: word number, hash and words of each; with a filter, of those only
    whose hash is in it."""
    from xxhash import xxh3_64_intdigest

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, text in zip(batch["id"], batch["text"]):
                own = words(text)
                if len(own) < n:
                    continue
                each = np.array([xxh3_64_intdigest(w) for w in own], np.uint64)
                h = _fold([each[k : len(own) - n + 1 + k] for k in range(n)])
                at = np.arange(len(h))
                if keep is not None:
                    cells = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                    at = np.flatnonzero((keep.value[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1)
                for k in range(0, len(at), 100_000):
                    p = at[k : k + 100_000]
                    yield pd.DataFrame({"id": key, "p": p, "h": h[p].view(np.int64), "g": [" ".join(own[i : i + n]) for i in p]})

    return run


_GRAM = "id long, p long, h long, g string"


def _joined_hits(src: DataFrame, t: DataFrame, n: int) -> DataFrame:
    """`test_id`, `id`, `p` where the tests are too many to be broadcast: one scan of the documents sends the grams
    whose hash is in a bit set of the tests' (2^FILTER_BITS bits, 64 MB) to meet the tests' grams by hash and words."""
    own = cut(t.select(F.col("t").alias("id"), F.col("x").alias("text")).mapInPandas(_grams(n), _GRAM).select(F.col("id").alias("test_id"), "h", "g").distinct())
    cells = own.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).alias("c")).select(F.floor(F.col("c") / 64).alias("w"), F.expr("shiftleft(1L, CAST(63 - c % 64 AS INT))").alias("b"))
    bits = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    for r in cells.groupBy("w").agg(F.bit_or("b").alias("b")).toLocalIterator():  # at most 2^(FILTER_BITS - 6) numbers
        bits[r.w] = np.uint64(r.b & 0xFFFFFFFFFFFFFFFF)
    held = src.sparkSession.sparkContext.broadcast(bits.astype(">u8").view(np.uint8))
    found = src.mapInPandas(_grams(n, held), _GRAM)
    return found.join(own, ["h", "g"]).select("test_id", "id", "p")


def leaked_passages(docs: DataFrame, tests: DataFrame, *, doc_id: str, text: str, test_id: str, test_text: str, n: int = 12) -> DataFrame:
    """`test_id`, `doc_id`, `first_word`, `n_words`: every stretch of a document made of test n-grams of one
    test, where at least n consecutive words of the test are consecutive words of the document. Stretches of
    one test that touch or overlap are one. Ids are integers.

    Words: see millrace.llm.words. Null or short texts hold nothing (short_tests reports the tests that cannot be
    found); rows with null id are left out; repeated documents are reported by their rows, repeated tests once each;
    other columns are ignored; empty tables give an empty result. Whole texts are scanned, whatever their length.

    Method: the test n-grams are hashed once on the driver and broadcast, behind a check of their size: at most
    MAX_TEST_WORDS words of test text (counted in Spark before anything is collected), of 20 bytes each beside the
    distinct words. Scanning numbers the words by the test vocabulary, hashes windows vectorised, and compares the
    words of every hit. A larger test set meets the documents by a join, see _joined_hits; either way the documents
    are scanned once.
    """
    t, few = _tests(tests, test_id, test_text)
    src = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    if few:
        held = _held(t, n)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            return _scan(held.value)(batches)

        out = src.mapInPandas(scan, "test_id long, id long, first_word long, n_words long")
    else:
        w = Window.partitionBy("test_id", "id").orderBy("p")
        hits = _joined_hits(src, t, n).distinct().withColumn("new", F.coalesce((F.col("p") > F.lag("p").over(w) + n).cast("int"), F.lit(1)))
        hits = hits.withColumn("no", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        out = hits.groupBy("test_id", "id", "no").agg(F.min("p").alias("first_word"), (F.max("p") - F.min("p") + n).alias("n_words"))
    return out.select("test_id", F.col("id").alias(doc_id), "first_word", "n_words")


def short_tests(tests: DataFrame, *, test_id: str, test_text: str, n: int = 12) -> DataFrame:
    """`test_id`, `n_words` of the distinct tests with an id that have under n words, null texts 0: no passage of n
    words can be found of them, and leaked_passages and without_leaks do not look for them."""

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(words(t)) if t else 0).astype("int64")

    t = tests.select(F.col(test_id).alias("test_id"), F.col(test_text).alias("x")).where("test_id IS NOT NULL").distinct()
    return t.select("test_id", count("x").alias("n_words")).where(F.col("n_words") < n)


def without_leaks(docs: DataFrame, tests: DataFrame, *, doc_id: str, text: str, test_id: str, test_text: str, n: int = 12, remove: str = "spans") -> DataFrame:
    """docs without leaked passages. remove="documents": without the rows that hold any. remove="spans": the
    text composed (NFC) and the words of leaked stretches, with what stands between them, cut out; texts without
    a leak stay as they are. All columns stay. Tests of under n words are not looked for, see short_tests.

    Tests of more than MAX_TEST_WORDS words meet the documents by a join, and the places found come back to the texts
    by document id and hash of the text; rows with null id are then looked up by their text alone."""
    t, few = _tests(tests, test_id, test_text)
    if few:
        held = _held(t, n)

        @F.pandas_udf("string")
        def clean(texts: pd.Series) -> pd.Series:
            plain = texts.tolist()
            at, word, _ = held.value.hits(plain)
            out = list(plain)
            order = np.argsort(at, kind="stable")
            at, word = at[order], word[order]
            each, first = np.unique(at, return_index=True)
            for k, own in zip(each, np.split(word, first[1:])):
                out[k] = _without(plain[k], own, n) if remove == "spans" else None
            return pd.Series(out, dtype=object)

        cleaned = docs.withColumn("__clean", clean(F.col(text)))
    else:
        # texts by two hashes of their own, so that repeated texts are looked up once and ids play no part
        key = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.reverse(text)).alias("b"))
        src = docs.select(key.alias("k"), F.col(text).alias("text")).where("text IS NOT NULL").dropDuplicates(["k"])
        src = cut(src.select("k", F.monotonically_increasing_id().alias("id"), "text"))
        spans = _joined_hits(src.select("id", "text"), t, n).groupBy("id").agg(F.collect_set("p").alias("p"))  # at most the words of a text

        @F.pandas_udf("string")
        def clean(texts: pd.Series, places: pd.Series) -> pd.Series:
            return pd.Series([_without(x, p, n) if remove == "spans" else None for x, p in zip(texts, places)], dtype=object)

        found = src.join(spans, "id").select(F.col("k").alias("__k"), clean("text", "p").alias("__new"), F.lit(True).alias("__hit"))
        joined = docs.withColumn("__key", key).join(found, F.col("__key") == F.col("__k"), "left")
        cleaned = joined.withColumn("__clean", F.when(F.col("__hit"), F.col("__new")).otherwise(F.col(text))).drop("__key", "__k", "__new", "__hit")
    if remove == "documents":
        return cleaned.where(F.col(text).isNull() | F.col("__clean").isNotNull()).drop("__clean")
    return cleaned.withColumn(text, F.col("__clean")).drop("__clean")


def _without(text: str, grams: np.ndarray, n: int) -> str:
    """The composed text without the characters of the n words that begin at each of the given words."""
    composed = unicodedata.normalize("NFC", text)
    places = [m.span() for m in _WORD.finditer(composed)]
    keep, end = [], 0
    for p in np.unique(grams):
        start = places[p][0]
        if start > end:
            keep.append(composed[end:start])
        end = max(end, places[p + n - 1][1])
    return "".join([*keep, composed[end:]])
