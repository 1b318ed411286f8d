"""Queries of text retrieval, models and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import retrieval as V
from millrace.operators.ranking import best, mmr
from millrace.plans.registry import Registry
from millrace.session import cut
from millrace.sources.frames import CLICKS
from millrace.sources.tables import table
from millrace.streaming import live

R = Registry()
queries, oracle_sql = R.queries, R.oracle_sql


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


@R.add("WITH k AS (SELECT doc_id, text, unnest(range(0, 1 + greatest(CAST(ceil((length(text) - 800) / 700) AS BIGINT), 0))) AS k FROM documents WHERE length(text) > 0) SELECT doc_id, CAST(k AS INT) AS chunk, CAST(k * 700 AS INT) AS start, CAST(least(k * 700 + 800, length(text)) AS INT) AS end, md5(substr(text, CAST(k * 700 + 1 AS BIGINT), 800)) AS digest FROM k")
def j2_char_chunks(spark: SparkSession, d: str) -> DataFrame:
    return V.char_chunks(_docs(spark, d), "doc_id", "text").withColumn("digest", F.md5("text")).drop("text")


_PARAS = r"""p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS t, unnest(range(len(string_split(text, chr(10) || chr(10))))) AS chunk FROM documents), o AS (SELECT *, coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM p),
 q AS (SELECT doc_id, chunk, off + length(t) - length(ltrim(t, ' ' || chr(9) || chr(10) || chr(13))) AS start, trim(t, ' ' || chr(9) || chr(10) || chr(13)) AS s FROM o)"""


@R.add(f"WITH {_PARAS} SELECT doc_id, CAST(chunk AS INT) AS chunk, CAST(start AS INT) AS start, CAST(start + length(s) AS INT) AS end, md5(s) AS digest FROM q WHERE length(s) >= 1")
def j3_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return V.paragraph_chunks(_docs(spark, d), "doc_id", "text").withColumn("digest", F.md5("text")).drop("text")


@R.add(f"WITH {_PARAS} SELECT doc_id, CAST(chunk AS INT) AS chunk, row_number() OVER (ORDER BY doc_id, chunk) - 1 AS chunk_idx FROM q WHERE length(s) >= 1")
def j5_numbered_chunks(spark: SparkSession, d: str) -> DataFrame:
    return V.numbered_chunks(V.paragraph_chunks(_docs(spark, d), "doc_id", "text").select("doc_id", "chunk"), "doc_id")


@R.add(r"WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents), k AS (SELECT doc_id, w, unnest(range(0, 1 + greatest(CAST(ceil((len(w) - 64) / 56) AS BIGINT), 0))) AS k FROM w WHERE len(w) > 0) SELECT doc_id, CAST(k AS INT) AS chunk, CAST(least(64, len(w) - k * 56) AS INT) AS n_words, md5(array_to_string(w[k * 56 + 1 : k * 56 + 64], ' ')) AS digest FROM k")
def j4_word_chunks(spark: SparkSession, d: str) -> DataFrame:
    return V.word_chunks(_docs(spark, d), "doc_id", "text", 64, 8).select("doc_id", "chunk", "n_words", F.md5("text").alias("digest"))


_POST = r"""tok AS (SELECT doc_id AS doc, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM documents), post AS (SELECT doc, term, len, count(*) AS tf FROM (SELECT doc, unnest(t) AS term, len(t) AS len FROM tok WHERE len(t) > 0) GROUP BY ALL)"""
_BM = _POST + r""", qs AS (SELECT test_id AS query, term, count(*) AS qtf FROM (SELECT test_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM eval_items WHERE test_id % 20 = 0) GROUP BY ALL),
 st AS (SELECT count(*) AS n, avg(len) AS mean FROM (SELECT doc, any_value(len) AS len FROM post GROUP BY 1)), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
 bm AS (SELECT query, doc, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))), 9) AS score FROM qs JOIN dfs USING (term) JOIN post USING (term), st GROUP BY ALL)"""


@R.add(f"WITH {_POST} SELECT doc, term, tf, CAST(len AS INT) AS len FROM post")
def j6_postings(spark: SparkSession, d: str) -> DataFrame:
    return V.postings(_docs(spark, d), "doc_id", "text")


@R.add(f"WITH {_BM}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INT) AS rank FROM bm) SELECT query, doc, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def j7_bm25(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "eval_items").where("test_id % 20 = 0")
    return V.bm25(V.postings(_docs(spark, d), "doc_id", "text"), q, "test_id", "text", 10).withColumn("score", F.round("score", 6))


@R.add(f"WITH {_POST}, n AS (SELECT count(DISTINCT doc) AS n FROM post), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1 HAVING count(*) >= 5), x AS (SELECT doc, term, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM post JOIN dfs USING (term), n) SELECT doc, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY doc)), 6) AS w FROM x")
def j12_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return V.tfidf(V.postings(_docs(spark, d), "doc_id", "text"), 5).withColumn("w", F.round("w", 6))


_COS = "cosn AS (SELECT a.vec_id AS query, b.vec_id AS doc, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)"


def _dense(spark: SparkSession, d: str, k: int | None) -> DataFrame:
    e = table(spark, d, "embeddings")
    return V.dense(e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector")), e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), k)


@R.add(f"WITH {_COS}, r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INT) AS rank FROM cosn) SELECT query, doc, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def j9_dense(spark: SparkSession, d: str) -> DataFrame:
    return _dense(spark, d, 10).withColumn("score", F.round("score", 6))


@R.add(f"WITH {_BM}, {_COS}, b AS (SELECT coalesce(c.query, bm.query) AS query, coalesce(c.doc, bm.doc) AS doc, coalesce(c.score, 0) AS d, coalesce(bm.score, 0) AS s FROM cosn c FULL JOIN bm ON bm.query = c.query AND bm.doc = c.doc), m AS (SELECT *, min(s) OVER w AS sl, max(s) OVER w AS sh, min(d) OVER w AS dl, max(d) OVER w AS dh FROM b WINDOW w AS (PARTITION BY query)), x AS (SELECT query, doc, round(CAST(0.4 AS DOUBLE) * CASE WHEN sh > sl THEN (s - sl) / (sh - sl) ELSE 0 END + CAST(0.6 AS DOUBLE) * CASE WHEN dh > dl THEN (d - dl) / (dh - dl) ELSE 0 END, 9) AS score FROM m), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INT) AS rank FROM x) SELECT query, doc, round(score, 6) AS score, rank FROM r WHERE rank <= 10")
def j10_hybrid(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "eval_items").where("test_id % 20 = 0")
    sparse = V.bm25(V.postings(_docs(spark, d), "doc_id", "text"), q, "test_id", "text", None)
    return V.hybrid(sparse, _dense(spark, d, None), 0.4, 10).withColumn("score", F.round("score", 6))


@R.add(rf"WITH {_BM}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm), t AS (SELECT r.query, r.rank, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM r JOIN documents ON doc_id = doc WHERE rank <= 10), c AS (SELECT *, len(w) AS n, sum(len(w)) OVER (PARTITION BY query ORDER BY rank) AS run FROM t) SELECT query, count(*) AS n, CAST(sum(least(n, 300)) AS BIGINT) AS total_tokens, md5(string_agg(CASE WHEN n > 300 THEN array_to_string(w[1:300], ' ') ELSE text END, chr(10) || chr(10) ORDER BY rank)) AS digest FROM c WHERE run <= 300 OR (rank = 1 AND n > 300) GROUP BY query")
def j16_context(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "eval_items").where("test_id % 20 = 0")
    hits = V.bm25(V.postings(_docs(spark, d), "doc_id", "text"), q, "test_id", "text", 10)
    return V.context_window(hits, _docs(spark, d), "doc_id", "text", 300).withColumn("digest", F.md5("context")).drop("context")


@R.add(f"WITH {_POST}, n AS (SELECT count(DISTINCT doc) AS n FROM post), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY 1 HAVING count(*) >= 2), x AS (SELECT doc, term, tf * (ln((1 + n) / (1 + df)) + 1) AS x FROM post JOIN dfs USING (term), n), w AS (SELECT doc, x / sqrt(sum(x * x) OVER (PARTITION BY doc)) AS w FROM x), s AS (SELECT doc, round(sum(w), 9) AS score FROM w GROUP BY 1) SELECT doc, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc LIMIT 50")
def k7_content(spark: SparkSession, d: str) -> DataFrame:
    return V.content_top(V.tfidf(V.postings(_docs(spark, d), "doc_id", "text"), 2), 50).withColumn("score", F.round("score", 6))


def _letters(texts: list[str]) -> np.ndarray:
    """A small encoder for tests: shares of a few letters and blanks in a text."""
    return np.array([[t.count(c) / max(len(t), 1) for c in "aeinorst "] for t in texts])


_ENC = "[" + ", ".join(f"(length(text) - length(replace(text, '{c}', ''))) / greatest(length(text), 1)" for c in "aeinorst ") + "]"


@R.add(f"WITH i AS (SELECT doc_id AS doc, {_ENC} AS v FROM documents WHERE text IS NOT NULL AND text <> ''), q AS (SELECT test_id AS query, {_ENC} AS v FROM eval_items WHERE test_id % 20 = 0 AND text IS NOT NULL), s AS (SELECT query, doc, round(list_dot_product(q.v, i.v) / (greatest(sqrt(list_dot_product(q.v, q.v)), 1e-12) * greatest(sqrt(list_dot_product(i.v, i.v)), 1e-12)), 9) AS score FROM q, i), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS INT) AS rank FROM s) SELECT query, doc, rank, round(score, 6) AS score FROM r WHERE rank <= 10")
def j8_encoded_index(spark: SparkSession, d: str) -> DataFrame:
    index = V.encoded(_docs(spark, d).where("text <> ''"), "doc_id", "text", _letters).withColumnRenamed("doc_id", "doc")
    asked = V.encoded(table(spark, d, "eval_items").where("test_id % 20 = 0"), "test_id", "text", _letters).withColumnRenamed("test_id", "query")
    return V.dense(cut(index), cut(asked), 10).withColumn("score", F.round("score", 6))


def _common(asked: list[str], texts: list[str]) -> list[float]:
    """A small scorer for tests: the share of the query's different words, between blanks, that the text has."""
    words = [(set(a.split(" ")), set(b.split(" "))) for a, b in zip(asked, texts)]
    return [len(a & b) / max(len(a), 1) for a, b in words]


_RERANK = f"""{_BM}, r10 AS (SELECT * FROM (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM bm) WHERE rank <= 10),
 rr AS (SELECT query, doc, len(list_intersect(list_distinct(string_split(e.text, ' ')), list_distinct(string_split(t.text, ' ')))) / len(list_distinct(string_split(e.text, ' '))) AS score FROM r10 JOIN eval_items e ON e.test_id = query JOIN documents t ON t.doc_id = doc),
 r5 AS (SELECT * FROM (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM rr) WHERE rank <= 5)"""


def _stages(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = table(spark, d, "eval_items").where("test_id % 20 = 0")
    first = cut(V.bm25(V.postings(_docs(spark, d), "doc_id", "text"), q, "test_id", "text", 10))
    docs = _docs(spark, d).withColumnRenamed("doc_id", "doc")
    return first, V.reranked(first, q.select(F.col("test_id").alias("query"), "text").distinct(), docs, _common, 5)


@R.add(f"WITH {_RERANK} SELECT query, doc, CAST(rank AS INT) AS rank, round(score, 6) AS score FROM r5")
def j13_reranked(spark: SparkSession, d: str) -> DataFrame:
    return _stages(spark, d)[1].withColumn("score", F.round("score", 6))


@R.add(f"WITH {_RERANK} SELECT coalesce(a.query, b.query) AS query, coalesce(a.doc, b.doc) AS doc, CAST(a.rank AS INT) AS rank_before, CAST(b.rank AS INT) AS rank_after, CAST(a.rank - b.rank AS INT) AS change, CASE WHEN a.rank IS NULL THEN 'new' WHEN b.rank IS NULL THEN 'gone' ELSE 'kept' END AS status FROM r10 a FULL JOIN r5 b ON a.query = b.query AND a.doc = b.doc")
def j18_stage_change(spark: SparkSession, d: str) -> DataFrame:
    return V.stage_change(*_stages(spark, d))


def _mmr_sql(k: int) -> str:
    unit = "CAST(embedding AS DOUBLE[])"
    out = f"""{_COS}, top AS (SELECT * FROM (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS place FROM cosn WHERE query <> doc) WHERE place <= 30), c AS (SELECT top.*, {unit} AS v FROM top JOIN embeddings ON vec_id = doc),
 t1 AS (SELECT query, doc, v, 1 AS rank FROM c WHERE place = 1)"""
    for i in range(2, k + 1):
        out += f""", g{i} AS (SELECT c.query, c.doc, c.v, c.score, round(0.7 * c.score - 0.3 * max(list_cosine_similarity(c.v, t.v)), 9) AS gain FROM c JOIN t{i - 1} t ON t.query = c.query GROUP BY c.query, c.doc, c.v, c.score HAVING count(*) FILTER (t.doc = c.doc) = 0),
 t{i} AS (SELECT * FROM t{i - 1} UNION ALL SELECT query, doc, v, {i} FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY gain DESC, score DESC, doc) AS n FROM g{i}) WHERE n = 1)"""
    return out


@R.add(f"WITH {_mmr_sql(4)} SELECT query AS query_id, doc AS item_id, CAST(rank AS INT) AS rank FROM t4")
def j14_vector_mmr(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    near = _dense(spark, d, 31).where("query <> doc")
    near = best(near.drop("rank"), "query", "score", "doc", 30)
    vectors = e.select(F.col("vec_id").alias("doc"), F.col("embedding").cast("array<double>").alias("v"))
    return mmr(near.join(vectors, "doc").select(F.col("query").alias("query_id"), F.col("doc").alias("item_id"), "score", "v"), 4, 0.7, "v").select("query_id", "item_id", "rank")


@R.add(r"WITH t AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, length(text) AS chars, len(w) AS words, len(list_distinct(w)) AS unique_words, round(CASE WHEN len(w) > 0 THEN coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / len(w) ELSE 0 END, 6) AS word_len, len(regexp_extract_all(text, '[.!?]+')) AS sentences, len(regexp_extract_all(text, '[!-/:-@\[-`{-~]')) AS marks, len(regexp_extract_all(text, '[A-Z]')) AS capitals FROM t")
def h28_text_statistics(spark: SparkSession, d: str) -> DataFrame:
    s = V.text_statistics(F.col("text"))
    out = _docs(spark, d).where("text IS NOT NULL").select("doc_id", *[c.alias(k) for k, c in s.items()])
    return out.withColumns({c: F.col(c).cast("long") for c in s if c != "word_len"} | {"word_len": F.round("word_len", 6)})


@R.add(r"SELECT doc_id, trim(regexp_replace(regexp_replace(lower(title), '[!-/:-@\[-`{-~]', ' ', 'g'), '\s+', ' ', 'g')) AS answer FROM documents")
def h21_normalised(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", V.normalised_answer(F.col("title")).alias("answer"))


@R.add(f"WITH {_COS}, r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM cosn WHERE query <> doc) SELECT query, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(label), 6) AS mean_target, round(stddev_pop(label), 6) AS std_target FROM r JOIN embeddings ON vec_id = doc WHERE rank <= 5 GROUP BY query")
def i33_neighbours(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    index = e.select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    out = V.neighbour_statistics(index, asked, e.select(F.col("vec_id").alias("doc"), F.col("label").alias("target")), 5)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_score", "mean_target", "std_target")})


_NORM = lambda c: rf"trim(regexp_replace(regexp_replace(lower({c}), '[!-/:-@\[-`{{-~]', ' ', 'g'), '\s+', ' ', 'g'))"


@R.add(f"WITH x AS (SELECT item_id, {_NORM('title')} AS a, {_NORM('description')} AS t FROM (SELECT DISTINCT item_id, title, description FROM tiny_items WHERE title IS NOT NULL AND description IS NOT NULL)), w AS (SELECT item_id, a = t AS em, string_split(a, ' ') AS a, string_split(t, ' ') AS t FROM x), c AS (SELECT *, len(list_intersect(list_distinct(a), list_distinct(t))) AS c FROM w) SELECT item_id, CAST(em AS INT) AS em, CASE WHEN c > 0 THEN round(2 * (c / len(a)) * (c / len(t)) / (c / len(a) + c / len(t)), 6) ELSE 0 END AS f1 FROM c")
def l18_answers(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "tiny_items").where("title IS NOT NULL AND description IS NOT NULL").select("item_id", "title", "description").distinct()
    s = V.answer_scores(F.col("title"), F.col("description"))
    return x.select("item_id", s["em"].alias("em"), F.round(s["f1"], 6).alias("f1"))


@R.add("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, split_part(props, ':', 1) AS head FROM events")
def h24_json_and_stops(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select("event_id", F.from_json("props", "k LONG").getField("k").alias("k"), V.cut_at_stops(F.col("props"), [":", "}"]).alias("head"))


@R.add("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'see ' || event_type || ' [7] and [' || CAST(event_id AS VARCHAR) || ']' END AS answer, CASE WHEN event_id % 2 = 0 THEN '3 5' ELSE '7 ' || CAST(event_id AS VARCHAR) END AS citations FROM events")
def h26_json_answers(spark: SparkSession, d: str) -> DataFrame:
    """Replies of two forms: JSON in a fence between other braces, and plain text with citations in brackets."""
    kind, key = F.col("event_type"), F.col("event_id").cast("string")
    fenced = F.concat(F.lit("I {think} so: ```json\n{\"answer\": \""), kind, F.lit("\", \"citations\": [3, 5]}\n``` and {\"answer\": \"no\"}"))
    plain = F.concat(F.lit("see "), kind, F.lit(" [7] and ["), key, F.lit("]"))
    reply = F.when(F.col("event_id") % 2 == 0, fenced).otherwise(plain)
    got = table(spark, d, "events").select("event_id", V.json_answer(reply).alias("x"))
    return got.select("event_id", "x.answer", F.array_join(F.transform("x.citations", lambda c: c.cast("string")), " ").alias("citations"))


def _source(spark: SparkSession, d: str, name: str) -> DataFrame:
    # the folder holds other tables too: the glob takes this one only, a file or a folder of files
    return spark.readStream.schema(table(spark, d, name).schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/{name}.parquet*")


def _stream(spark: SparkSession, d: str) -> DataFrame:
    return _source(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_GAPS = f"""WITH {CLICKS}, l AS (SELECT *, CASE WHEN us - lag(us) OVER w > 1800000000 THEN 1 ELSE 0 END AS new FROM clicks WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)), n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id) AS no FROM l)"""


@R.add(f"{_GAPS} SELECT user_id, min(us) AS start_us, max(us) + 1800000000 AS end_us, count(*) AS events FROM n GROUP BY user_id, no")
def s1_stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = live.run_available(spark, live.sessions(_stream(spark, d), "user_id", "ts", late="30 days"), "complete")
    return out.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


@R.add(f"WITH {CLICKS} SELECT event AS event_type, epoch_us(date_trunc('day', ts)) AS start_us, count(*) AS n FROM clicks GROUP BY ALL")
def s2_stream_days(spark: SparkSession, d: str) -> DataFrame:
    out = live.run_available(spark, live.windowed_counts(_stream(spark, d), "event_type", "ts", "1 day"), "complete")
    return out.select("event_type", F.unix_micros("start").alias("start_us"), "n")


@R.add(f"WITH {CLICKS}, w AS (SELECT event, us // 86400000000 - unnest(range(7)) AS day FROM clicks) SELECT event AS event_type, day * 86400000000 AS start_us, count(*) AS n FROM w GROUP BY ALL")
def s3_stream_sliding(spark: SparkSession, d: str) -> DataFrame:
    out = live.run_available(spark, live.windowed_counts(_stream(spark, d), "event_type", "ts", "7 days", "1 day"), "complete")
    return out.select("event_type", F.unix_micros("start").alias("start_us"), "n")


@R.add("SELECT DISTINCT event_id FROM tiny_interactions WHERE loaded_at IS NOT NULL")
def s4_stream_without_copies(spark: SparkSession, d: str) -> DataFrame:
    """Re-delivered events once each, by their arrival, copies up to a year apart."""
    stream = _source(spark, d, "tiny_interactions").where("loaded_at IS NOT NULL")
    return live.run_available(spark, live.without_copies(stream, "event_id", "loaded_at", "365 days"), "append").select("event_id")


@R.add(f"WITH {CLICKS}, d AS (SELECT date_trunc('day', ts) AS day, count(*) AS n FROM clicks GROUP BY 1) SELECT epoch_us(day) AS start_us, n, day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 2 DAY FROM clicks) AS final FROM d")
def s5_late_policy(spark: SparkSession, d: str) -> DataFrame:
    """Daily counts, and whether a day is final: over two days before the last event, so that later rows of it would be
    dropped and an append-mode sink has it."""
    counts = live.windowed_counts(_stream(spark, d).withColumn("all", F.lit(1)), "all", "ts", "1 day", late="2 days")
    every = live.run_available(spark, counts, "complete").select(F.unix_micros("start").alias("start_us"), "n")
    final = live.run_available(spark, counts, "append").select(F.unix_micros("start").alias("start_us"), F.lit(True).alias("f"))
    return every.join(final, "start_us", "left").select("start_us", "n", F.coalesce("f", F.lit(False)).alias("final"))


@R.add("SELECT user_id, count(*) AS n FROM events GROUP BY user_id")
def s6_stream_counters(spark: SparkSession, d: str) -> DataFrame:
    out = live.run_available(spark, live.running_counters(_stream(spark, d), "user_id", "ts", "60 days"), "update")
    return out.groupBy("user_id").agg(F.max("n").alias("n"))
