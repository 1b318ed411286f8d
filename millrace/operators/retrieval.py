"""Text retrieval: chunks, tokens, BM25 and TF-IDF as tables, dense scores, hybrids, context windows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from millrace.operators.quality import running_counts
from millrace.operators.ranking import best
from millrace.session import materialised


def char_chunks(docs: DataFrame, doc_id: str, text: str, size: int = 800, overlap: int = 100, least: int = 1) -> DataFrame:
    """doc_id, chunk (from 0), start, end, text of windows of `size` characters that overlap; the last ends with
    the text. Null and empty texts have none."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    n, step = F.length(text), size - overlap
    last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("int")
    out = docs.where(n > 0).select(doc_id, F.col(text).alias("__t"), F.posexplode(F.sequence(F.lit(0), last)).alias("chunk", "__k"))
    start = F.col("__k") * step
    out = out.select(doc_id, "chunk", start.alias("start"), F.least(start + size, F.length("__t")).alias("end"), F.substring("__t", start + 1, F.lit(size)).alias("text"))
    return out.where(F.col("end") - F.col("start") >= least)


def paragraph_chunks(docs: DataFrame, doc_id: str, text: str, least: int = 1) -> DataFrame:
    """doc_id, chunk, start, end, text of the stripped parts between blank lines, with their 0-based places."""
    blanks = F.lit(" \t\n\r")
    parts = F.split(F.col(text), "\n\n", -1)
    # the place of a part is the length of those before it, and two characters between each two
    ends = F.transform(parts, lambda x, i: F.aggregate(F.slice(parts, 1, i), F.lit(0), lambda n, y: n + F.length(y) + 2))
    rows = docs.where(F.col(text).isNotNull()).select(doc_id, F.posexplode(F.arrays_zip(parts.alias("part"), ends.alias("at"))).alias("chunk", "x"))
    rows = rows.select(doc_id, "chunk", F.col("x.part").alias("part"), F.col("x.at").alias("at"))
    head = F.length("part") - F.length(F.ltrim(F.col("part"), blanks))
    rows = rows.select(doc_id, "chunk", (F.col("at") + head).alias("start"), F.btrim("part", blanks).alias("text"))
    return rows.where(F.length("text") >= least).select(doc_id, "chunk", "start", (F.col("start") + F.length("text")).alias("end"), "text")


def numbered_chunks(chunks: DataFrame, doc_id: str) -> DataFrame:
    """chunks with chunk_idx, a number from 0 over all documents, by document, then chunk."""
    keys = chunks.select(F.struct(doc_id, "chunk").alias("__v"), F.lit(1).cast("long").alias("__n"))
    numbers = running_counts(keys, "__v", ["__n"]).select(F.col(f"__v.{doc_id}").alias("__d"), F.col("__v.chunk").alias("__c"), (F.col("cum___n") - 1).alias("chunk_idx"))
    return chunks.join(numbers, (F.col(doc_id) == F.col("__d")) & (F.col("chunk") == F.col("__c"))).drop("__d", "__c")


def word_chunks(docs: DataFrame, doc_id: str, text: str, size: int = 256, overlap: int = 32) -> DataFrame:
    """doc_id, chunk, n_words, text of windows of words between white space."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    rows = docs.select(doc_id, words.alias("__w")).where(F.size("__w") > 0)
    last = F.greatest(F.ceil((F.size("__w") - size) / F.lit(size - overlap)), F.lit(0)).cast("int")
    out = rows.select(doc_id, "__w", F.posexplode(F.sequence(F.lit(0), last)).alias("chunk", "__k"))
    piece = F.slice("__w", F.col("__k") * (size - overlap) + 1, F.lit(size))
    return out.select(doc_id, "chunk", F.size(piece).alias("n_words"), F.concat_ws(" ", piece).alias("text"))


def tokens(text: Column) -> Column:
    """Lower-case runs of word characters of any script."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1)


def postings(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, term, tf, len: of every term of a document its count, and the document's length in terms."""
    t = docs.select(F.col(doc_id).alias("doc"), tokens(F.col(text)).alias("__t")).where(F.size("__t") > 0)
    return t.select("doc", F.size("__t").alias("len"), F.explode("__t").alias("term")).groupBy("doc", "len", "term").agg(F.count(F.lit(1)).alias("tf"))


def bm25(index: DataFrame, queries: DataFrame, query_id: str, text: str, k: int | None, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """query, doc, score (9 places), rank of the k best documents; a term counts as often as the query has it. The
    postings are materialised once for all that is drawn from them; they meet query terms by an equi-join, frequent
    terms split by adaptive execution."""
    index = materialised(index, "postings")
    sizes = index.groupBy("doc").agg(F.first("len").alias("len")).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean")).first()
    n, mean = F.lit(sizes.n), F.lit(sizes.mean)
    q = queries.select(F.col(query_id).alias("query"), F.explode(tokens(F.col(text))).alias("term")).groupBy("query", "term").agg(F.count(F.lit(1)).alias("qtf"))
    hits = index.join(q, "term")
    # only the query's terms need their number of documents
    df = index.join(q.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("qtf") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / mean))
    scores = hits.join(df, "term").groupBy("query", "doc").agg(F.round(F.sum(part), 9).alias("score"))
    return scores if k is None else best(scores, "query", "score", "doc", k)


def tfidf(index: DataFrame, min_df: int = 1) -> DataFrame:
    """doc, term, w: tf (ln((1 + N) / (1 + df)) + 1), brought to length 1 in each document."""
    index = materialised(index, "postings")
    n = index.agg(F.count_distinct("doc")).scalar()
    df = index.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= min_df)
    raw = index.join(df, "term").select("doc", "term", (F.col("tf") * (F.log((1 + n) / (1 + F.col("df"))) + 1)).alias("x"))
    norm = F.sqrt(F.sum(F.col("x") * F.col("x")).over(Window.partitionBy("doc")))
    return raw.select("doc", "term", (F.col("x") / norm).alias("w"))


def content_top(weights: DataFrame, k: int) -> DataFrame:
    """doc, score: the k documents of the greatest sum of tf-idf weights, the same for every query."""
    return weights.groupBy("doc").agg(F.round(F.sum("w"), 9).alias("score")).orderBy(F.col("score").desc(), "doc").limit(k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-12))


ROWS_A_PART = 20_000


def dense(index: DataFrame, queries: DataFrame, k: int | None, block: int = 1024, spread: int | None = None) -> DataFrame:
    """query, doc, score, rank by exact cosine. index: doc, vector; queries: query, vector, a stated set that is
    met by all vectors: it is cut in blocks of about `block` queries, each beside `spread` parts of the index (default: of
    about ROWS_A_PART vectors, 32 at least), so that a task holds one block and one part, and no vector travels more
    often than there are blocks."""
    blocks = queries.count() // block + 1
    spread = spread or max(32, index.count() // ROWS_A_PART)

    def unit(df: DataFrame, key: str, name: str) -> DataFrame:
        n = df.select(key, "vector", F.greatest(F.sqrt(dot(F.col("vector"), F.col("vector"))), F.lit(1e-12)).alias("n"))
        return n.select(key, F.transform("vector", lambda x: x.cast("double") / F.col("n")).alias(name))

    numbers = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    q = unit(queries, "query", "qv").groupBy(F.pmod(F.xxhash64("query"), F.lit(blocks)).alias("b")).agg(F.collect_list(F.struct("query", "qv")).alias("qs"))
    q = q.select("b", "qs", F.explode(numbers(spread)).alias("part"))
    d = unit(index, "doc", "dv").select("doc", "dv", F.pmod(F.xxhash64("doc"), F.lit(spread)).alias("part"), F.explode(numbers(blocks)).alias("b"))
    pairs = d.join(q, ["b", "part"]).select("doc", "dv", F.explode("qs").alias("q"))
    scores = pairs.select(F.col("q.query").alias("query"), "doc", F.round(dot(F.col("dv"), F.col("q.qv")), 9).alias("score"))
    return scores if k is None else best(scores, "query", "score", "doc", k)


def nearest(index: DataFrame, queries: DataFrame, k: int, block: int | None = None, tile: int = 4_000_000) -> DataFrame:
    """query, doc, score, rank: the k best by exact cosine, as dense gives them, for short vectors and many queries:
    each block of queries meets each part of the index as one product of matrices, of which only what can be among
    the k best is a row. Scores that are equal after rounding to 9 digits fall by doc."""
    asked, parts = queries.count(), index.count() // ROWS_A_PART + 1
    blocks = asked // (block or min(32_768, max(2048, asked // 16))) + 1
    q = queries.select("query", F.col("vector").cast("array<double>").alias("vector"), F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    d = index.select("doc", F.col("vector").cast("array<double>").alias("vector"), F.pmod(F.xxhash64("doc"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    kinds = dict(q.dtypes) | dict(d.dtypes)

    def unit(df: pd.DataFrame) -> np.ndarray:
        v = np.stack(df["vector"].to_numpy())
        return v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-12)

    def meet(asked: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        found = [pd.DataFrame({"query": asked["query"][:0], "doc": docs["doc"][:0], "score": np.empty(0)})]
        if len(asked) and len(docs):
            qv, dv = unit(asked), unit(docs).T
            wide = max(1, tile // len(docs))
            for a in range(0, len(asked), wide):
                s = qv[a : a + wide] @ dv
                least = np.partition(s, len(docs) - k, axis=1)[:, len(docs) - k] if len(docs) > k else np.full(len(s), -np.inf)
                i, j = np.nonzero(s >= least[:, None] - 2e-9)
                found.append(pd.DataFrame({"query": asked["query"].to_numpy()[a + i], "doc": docs["doc"].to_numpy()[j], "score": s[i, j]}))
        return pd.concat(found, ignore_index=True)

    # as many tasks as there are pairs of block and part, whatever their bytes
    many = max(1, blocks * parts)
    left, right = (x.repartition(many, "b", "part").groupBy("b", "part") for x in (q, d))
    met = left.cogroup(right).applyInPandas(meet, f"query {kinds['query']}, doc {kinds['doc']}, score double")
    return best(met.withColumn("score", F.round("score", 9)), "query", "score", "doc", k)


def hybrid(sparse: DataFrame, dense_scores: DataFrame, alpha: float, k: int) -> DataFrame:
    """query, doc, score, rank: alpha sparse + (1 - alpha) dense, each brought to 0..1 over the query's documents
    (constant: 0), which are those with either score, the one that is missing being 0."""
    both = dense_scores.select("query", "doc", F.col("score").alias("d")).join(sparse.select("query", "doc", F.col("score").alias("s")), ["query", "doc"], "full").fillna(0.0, ["s", "d"])
    w = Window.partitionBy("query")

    def unit(c: str) -> Column:
        lo, hi = F.min(c).over(w), F.max(c).over(w)
        return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(0.0)

    mixed = both.select("query", "doc", unit("s").alias("s"), unit("d").alias("d"))
    return best(mixed.select("query", "doc", F.round(alpha * F.col("s") + (1 - alpha) * F.col("d"), 9).alias("score")), "query", "score", "doc", k)


def context_window(hits: DataFrame, docs: DataFrame, doc_id: str, text: str, budget: int, joiner: str = "\n\n") -> DataFrame:
    """query, n, total_tokens, context: texts in rank order while their words fit the budget; a first text that
    is over it is cut to its first words; the first later one that does not fit ends the window."""
    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    rows = hits.join(docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text"), F.size(words).alias("n"), words.alias("words")), "doc")
    run = F.sum("n").over(Window.partitionBy("query").orderBy("rank"))
    first = (F.col("rank") == 1) & (F.col("n") > budget)
    cut = rows.withColumn("run", run).where((F.col("run") <= budget) | first)
    cut = cut.withColumns({"text": F.when(first, F.concat_ws(" ", F.slice("words", 1, budget))).otherwise(F.col("text")), "n": F.least("n", F.lit(budget))})
    out = cut.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("total_tokens"), F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("p"))
    return out.select("query", "n", "total_tokens", F.concat_ws(joiner, F.transform("p", lambda x: x["text"])).alias("context"))


def text_statistics(text: Column) -> dict[str, Column]:
    """chars, words, unique words, mean word length, sentences, punctuation marks, capitals."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.size(words)
    letters = F.aggregate(F.transform(words, F.length), F.lit(0), lambda a, x: a + x)
    return {
        "chars": F.length(text), "words": n, "unique_words": F.size(F.array_distinct(words)), "word_len": F.when(n > 0, letters / n).otherwise(0.0),
        "sentences": F.regexp_count(text, F.lit(r"[.!?]+")), "marks": F.regexp_count(text, F.lit(r"[!-/:-@\[-`{-~]")), "capitals": F.regexp_count(text, F.lit(r"[A-Z]")),
    }


def normalised_answer(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", " "), r"\s+", " "))


def answer_scores(answer: Column, truth: Column) -> dict[str, Column]:
    """Exact match and token F1 of normalised answers; common words as a set, lengths as lists."""
    a, t = (F.filter(F.split(normalised_answer(x), " "), lambda w: w != "") for x in (answer, truth))
    common = F.size(F.array_intersect(a, t))
    p, r = common / F.size(a), common / F.size(t)
    return {"em": (normalised_answer(answer) == normalised_answer(truth)).cast("int"), "f1": F.when(common > 0, 2 * p * r / (p + r)).otherwise(0.0)}


@F.pandas_udf(StringType())
def first_json(texts: pd.Series) -> pd.Series:
    """The first object in a text that is whole JSON, as it stands there; null where there is none."""
    decode = json.JSONDecoder().raw_decode

    def find(text: str | None) -> str | None:
        at = -1 if text is None else text.find("{")
        while at >= 0:
            try:
                return text[at : decode(text, at)[1]]
            except ValueError:
                at = text.find("{", at + 1)
        return None

    return texts.map(find).astype(object)


def json_answer(reply: Column) -> Column:
    """The answer and citations of a model's reply, in a code fence or not: of its first whole JSON object; where that
    has no answer, or there is none, the text itself without fences is the answer, and the citations are the numbers
    in square brackets."""
    got = F.from_json(first_json(reply), "answer STRING, citations ARRAY<INT>")
    plain = F.btrim(F.regexp_replace(reply, r"```(?:json)?", ""))
    cited = F.transform(F.regexp_extract_all(plain, F.lit(r"\[(\d{1,9})\]"), 1), lambda x: x.cast("int"))
    own = F.coalesce(got["answer"], plain)
    return F.when(reply.isNotNull(), F.struct(own.alias("answer"), F.coalesce(got["citations"], F.when(got["answer"].isNull(), cited), F.array().cast("array<int>")).alias("citations")))


def cut_at_stops(text: Column, stops: list[str]) -> Column:
    """The text up to the first of any stop string."""
    at = [F.when(F.instr(text, s) > 0, F.instr(text, s)) for s in stops]
    first = F.least(*at) if len(at) > 1 else at[0]
    return F.when(first.isNull(), text).otherwise(F.substring(text, F.lit(1), first - 1))


def neighbour_statistics(index: DataFrame, queries: DataFrame, targets: DataFrame, k: int) -> DataFrame:
    """query, n, mean_score, mean_target, std_target (population) over the k nearest other vectors by cosine;
    targets: doc, target."""
    near = dense(index, queries, k + 1).where("query <> doc").withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).where(F.col("place") <= k)
    joined = near.join(targets, "doc")
    return joined.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("mean_score"), F.avg("target").alias("mean_target"), F.stddev_pop("target").alias("std_target"))


def encoded(df: DataFrame, key: str, text: str, encode: Callable[[list[str]], np.ndarray], batch: int = 256) -> DataFrame:
    """key, vector: an encoder over texts, some at a time, in Arrow batches. encode takes a list of texts and gives a
    matrix; it is sent to the workers once for each task. Rows with a null key or text have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for i in range(0, len(part), batch):
                own = part.iloc[i : i + batch]
                yield pd.DataFrame({"k": own["k"].to_numpy(), "vector": list(np.asarray(encode(own["t"].tolist()), float))})

    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k IS NOT NULL AND t IS NOT NULL")
    return rows.mapInPandas(run, f"k {dict(rows.dtypes)['k']}, vector array<double>").withColumnRenamed("k", key)


def reranked(hits: DataFrame, queries: DataFrame, docs: DataFrame, predict: Callable[[list[str], list[str]], Sequence[float]], k: int, batch: int = 256) -> DataFrame:
    """query, doc, score, rank: candidates ordered again by a scorer of (query text, document text), some pairs at a time
    in Arrow batches. queries: query, text; docs: doc, text; hits: query, doc."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for i in range(0, len(part), batch):
                own = part.iloc[i : i + batch]
                yield pd.DataFrame({"query": own["query"], "doc": own["doc"], "score": np.asarray(predict(own["a"].tolist(), own["b"].tolist()), float)})

    pairs = hits.select("query", "doc").join(queries.select("query", F.col("text").alias("a")), "query").join(docs.select("doc", F.col("text").alias("b")), "doc").where("a IS NOT NULL AND b IS NOT NULL")
    kinds = dict(pairs.dtypes)
    scored = pairs.select("query", "doc", "a", "b").mapInPandas(run, f"query {kinds['query']}, doc {kinds['doc']}, score double")
    return best(scored, "query", "score", "doc", k)


def stage_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """query, doc, rank_before, rank_after, change (places won), status (kept, new, gone) between two stages of lists."""
    both = before.select("query", "doc", F.col("rank").alias("rank_before")).join(after.select("query", "doc", F.col("rank").alias("rank_after")), ["query", "doc"], "full")
    status = F.when(F.col("rank_before").isNull(), "new").when(F.col("rank_after").isNull(), "gone").otherwise("kept")
    return both.withColumns({"change": F.col("rank_before") - F.col("rank_after"), "status": status})
