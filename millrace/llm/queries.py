"""Queries of the problems tagged llm, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.leaks import leaked_passages, short_tests, without_leaks
from millrace.llm.mix import mixed
from millrace.llm.shared import shared_pairs, shared_shares, shared_stretches
from millrace.llm.splits import attached, deal_splits, tied_records
from millrace.llm.together import items_together
from millrace.llm.topn import top_n
from millrace.session import cut
from millrace.sources.tables import table


# Devices that name none; where the public tokenizer lies
NO_DEVICE = ["", "unknown", "00000000"]
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Chi squared of one degree of freedom at 0.5 %. A pair of p4_found has n >= 6 and n N >= 5 a b, so by the first
# term and its expectation alone an llr of at least 2 (6 ln 5 - 6 + 6 / 5) = 9.7: the bound loses none of them.
SIGNIFICANT = 7.88
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}


def _ties(queries_: DataFrame, record: Column) -> DataFrame:
    """Record and key of every tie of a query: its user, its device."""
    device = F.lower(F.btrim("device_id"))
    keys = F.array(
        F.concat(F.lit("u"), F.col("user_id")), F.when(~device.isin(NO_DEVICE), F.concat(F.lit("d"), device))
    )
    return queries_.select(record.alias("record"), F.explode(keys).alias("key")).where("key IS NOT NULL AND record IS NOT NULL")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    tied = tied_records(_ties(table(spark, d, "tiny_queries"), F.col("query_id")), "record", "key", alone=False)
    return tied.select(F.col("record").alias("query_id"), F.col("root").alias("lead_id"))


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    def of(name: str) -> DataFrame:
        # a row without query_id is a record of its own
        df = table(spark, d, name)
        plain = F.lower(F.btrim("query_id"))
        own = F.concat(F.lit("?"), F.sha2(F.to_json(F.struct(*df.columns)), 256))
        return df.withColumn("record", F.when(F.length(plain) > 0, plain).otherwise(own))

    queries_, ranker = of("tiny_queries"), of("ranker_x_train")
    tied = tied_records(_ties(queries_, F.col("record")), "record", "key")
    rows = queries_.select(F.lit("tiny_queries").alias("src"), "query_id", F.lit(None).cast("string").alias("item_id"), "record")
    rows = rows.unionAll(ranker.select(F.lit("ranker_x_train").alias("src"), "query_id", "item_id", "record"))
    records = rows.groupBy("record").agg(F.count(F.lit(1)).alias("n")).join(tied, "record", "left")
    records = cut(records.withColumn("root", F.coalesce("root", F.concat(F.lit("="), "record"))))
    groups = records.groupBy("root").agg(F.sum("n").alias("n"))
    splits = deal_splits(groups, "root", "n", SHARES).withColumnRenamed("root", "__root")
    count = records.count()
    dealt = attached(records, "root", splits, "__root", count).select(F.col("record").alias("__record"), "split")
    return rows.join(dealt, F.col("record") == F.col("__record")).select("src", "query_id", "item_id", "split")


def p3_checks(spark: SparkSession, d: str) -> DataFrame:
    """Rows of p3_splits, query ids and tied groups in more than one split, and whether every split is within a point
    of its share."""
    rows = cut(p3_splits(spark, d).withColumn("record", F.lower(F.btrim("query_id"))))
    torn = lambda df, key, name: df.groupBy(key).agg(F.count_distinct("split").alias("k")).agg(F.count_if(F.col("k") > 1).alias(name))
    own = rows.where("src = 'tiny_queries'").select(F.col("query_id").alias("q"), "split")
    groups = own.join(p3_found(spark, d), F.col("q") == F.col("query_id")).select("lead_id", "split")
    near = [F.abs(F.count_if(F.col("split") == k) / F.count(F.lit(1)) - x) < 0.01 for k, x in SHARES.items()]
    out = rows.agg(F.count(F.lit(1)).alias("rows"), (near[0] & near[1] & near[2]).alias("near"))
    return out.crossJoin(torn(rows.where("record <> ''"), "record", "torn_records")).crossJoin(torn(groups, "lead_id", "torn_groups"))  # one row each


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = items_together(table(spark, d, "tiny_interactions"), "session_id", "item_id", min_together=6, min_ratio=5, min_cosine2=1 / 16, min_llr=SIGNIFICANT)
    return pairs.select("item_a", "item_b")


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = items_together(table(spark, d, "tiny_interactions"), "session_id", "item_id")
    return pairs.withColumns({"ratio": F.round("ratio", 6), "llr": F.round("llr", 4)})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_top5(spark, d).select("query_id", "place", "item_id")


def p6_top5(spark: SparkSession, d: str) -> DataFrame:
    return top_n(table(spark, d, "tiny_predictions"), "query_id", "item_id", "score", 5)


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"), doc_id="doc_id", text="text", test_id="test_id", test_text="text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("test_id", "doc_id").distinct()


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p8_short_tests(spark: SparkSession, d: str) -> DataFrame:
    return short_tests(table(spark, d, "eval_items"), test_id="test_id", test_text="text")


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    """All documents with their leaked spans cut out, by id and digest of the text."""
    clean = without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), doc_id="doc_id", text="text", test_id="test_id", test_text="text")
    return clean.select("doc_id", F.md5("text").alias("digest"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixed(
        table(spark, d, "documents"), table(spark, d, "mix_targets"), doc_id="doc_id", text="text", source="source",
        share="target_share", repeats="max_repeats", tokenizer_path=TOKENIZER,
    )


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """The mix checked: blocks used too often, slots filled twice, blocks over 1024 tokens or of another length than
    reported, and whether every source that is not used up is within 1.5 points of its target."""
    mix, shares = _mix(spark, d)
    mix = cut(mix.select("shard", "slot", "source", "block", "n_tokens", F.size("tokens").alias("size")))
    most = shares.select(F.col("source").alias("s"), "max_repeats")
    blocks = mix.groupBy("source", "block").agg(F.count(F.lit(1)).alias("n")).join(most, F.col("source") == F.col("s")).agg(F.count_if(F.col("n") > F.col("max_repeats")).alias("over_repeats"))
    slots = mix.groupBy("shard", "slot").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_slots"))
    sizes = mix.agg(F.count_if((F.col("n_tokens") > 1024) | (F.col("n_tokens") != F.col("size"))).alias("wrong_sizes"))
    left = F.col("mix_tokens") < F.col("available_tokens") * F.col("max_repeats")
    near = shares.agg(F.coalesce(F.bool_and(F.when(left, F.abs(F.col("actual_share") - F.col("target_share")) < 0.015)), F.lit(True)).alias("near"))
    return blocks.crossJoin(slots).crossJoin(sizes).crossJoin(near)  # one row each


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return shared_pairs(table(spark, d, "documents"), "doc_id", "text")


def p10_stretches(spark: SparkSession, d: str) -> DataFrame:
    return shared_stretches(table(spark, d, "documents"), "doc_id", "text")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return shared_shares(table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        p3_found, p3_splits, p3_checks, p4_found, p4_pairs, p6_found, p6_top5, p8_found, p8_passages, p8_short_tests, p8_cleaned,
        p9_mix, p9_shares, p9_checks, p10_found, p10_stretches, p10_shares,
    )
    return {f.__name__: f for f in own}


_SETS = """WITH r AS (SELECT DISTINCT session_id AS s, item_id AS i FROM tiny_interactions WHERE session_id IS NOT NULL AND item_id IS NOT NULL),
 t AS (SELECT count(DISTINCT s) AS baskets FROM r), c AS (SELECT i, count(*) AS k FROM r GROUP BY i),
 p AS (SELECT x.i AS item_a, y.i AS item_b, count(*) AS n FROM r x JOIN r y ON x.s = y.s AND x.i < y.i GROUP BY ALL),
 j AS (SELECT p.*, a.k AS n_a, b.k AS n_b, baskets FROM p JOIN c a ON a.i = item_a JOIN c b ON b.i = item_b, t)"""
_XLX = lambda x, t: f"(CASE WHEN {x} > 0 THEN {x} * ln(CAST({x} AS DOUBLE) / {t}) ELSE 0 END)"
_LLR = "greatest(0, 2 * (" + " + ".join(_XLX(x, "baskets") for x in ("n", "(n_a - n)", "(n_b - n)", "(baskets - n_a - n_b + n)")) + " - " + " - ".join(_XLX(x, "baskets") for x in ("n_a", "(baskets - n_a)", "n_b", "(baskets - n_b)")) + "))"
_TOP = """WITH b AS (SELECT query_id, item_id, max(CASE WHEN score = 0 THEN 0.0 ELSE score END) AS score FROM tiny_predictions
   WHERE score IS NOT NULL AND NOT isnan(score) AND query_id IS NOT NULL AND item_id IS NOT NULL GROUP BY ALL),
 k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INT) AS place FROM b)"""


_TIES = """WITH RECURSIVE q AS (SELECT DISTINCT query_id, user_id, CASE WHEN lower(trim(device_id)) NOT IN ('', 'unknown', '00000000') THEN lower(trim(device_id)) END AS dev FROM tiny_queries WHERE query_id IS NOT NULL),
 e AS (SELECT a.query_id AS a, b.query_id AS b FROM q a JOIN q b ON a.user_id = b.user_id UNION SELECT a.query_id, b.query_id FROM q a JOIN q b ON a.dev = b.dev),
 r AS (SELECT a AS s, b AS v FROM e UNION SELECT r.s, e.b FROM r JOIN e ON e.a = r.v)"""
_GRAMS = """WITH t AS (SELECT id, list_transform(regexp_extract_all(nfc_normalize(text), '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS w, side FROM
  (SELECT test_id AS id, text, 't' AS side FROM eval_items UNION ALL SELECT doc_id, text, 'd' FROM documents)),
 g AS (SELECT DISTINCT id, side, unnest(list_transform(range(1, len(w) - 10), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM t WHERE len(w) >= 12)"""


_PLACES = """WITH t AS (SELECT id, list_transform(regexp_extract_all(nfc_normalize(text), '[\\p{L}\\p{N}]+'), lambda x: lower(x)) AS w, side FROM
  (SELECT DISTINCT test_id AS id, text, 't' AS side FROM eval_items UNION ALL SELECT doc_id, text, 'd' FROM documents) WHERE id IS NOT NULL),
 g AS (SELECT DISTINCT id, side, p, array_to_string(w[p + 1:p + 12], ' ') AS g FROM (SELECT id, side, w, unnest(range(0, len(w) - 11)) AS p FROM t WHERE len(w) >= 12)),
 hits AS (SELECT DISTINCT a.id AS test_id, b.id AS doc_id, b.p FROM g a JOIN g b ON a.side = 't' AND b.side = 'd' AND a.g = b.g)"""
_WINDOWS = """WITH w AS (SELECT id, CAST(i - 1 AS INT) AS pos, substr(text, i, 300) AS s FROM (SELECT DISTINCT doc_id AS id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300 AND doc_id IS NOT NULL)),
 f AS (SELECT s, id, min(pos) AS pos FROM w GROUP BY ALL), c AS (SELECT s, min(id) AS lo, arg_min(pos, id) AS lop, max(id) AS hi, arg_max(pos, id) AS hip FROM f GROUP BY s HAVING min(id) < max(id)),
 m AS (SELECT w.id, w.pos, CASE WHEN w.id = lo THEN hi ELSE lo END AS oid, CASE WHEN w.id = lo THEN hip ELSE lop END AS opos FROM w JOIN c USING (s)),
 n AS (SELECT *, CASE WHEN pos = lag(pos) OVER v + 1 AND oid = lag(oid) OVER v AND opos = lag(opos) OVER v + 1 THEN 0 ELSE 1 END AS new FROM m WINDOW v AS (PARTITION BY id ORDER BY pos)),
 k AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY pos) AS no FROM n),
 st AS (SELECT id AS doc_id, CAST(min(pos) AS INT) AS start, CAST(max(pos) - min(pos) + 300 AS INT) AS length, any_value(oid) AS other_id, CAST(min(opos) AS INT) AS other_start FROM k GROUP BY id, no)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_checks": "SELECT (SELECT count(*) FROM tiny_queries) + (SELECT count(*) FROM ranker_x_train) AS rows, true AS near, 0::BIGINT AS torn_records, 0::BIGINT AS torn_groups",
        "p8_passages": f"{_PLACES}, n AS (SELECT *, CASE WHEN p <= lag(p) OVER v + 12 THEN 0 ELSE 1 END AS new FROM hits WINDOW v AS (PARTITION BY test_id, doc_id ORDER BY p)), k AS (SELECT *, sum(new) OVER (PARTITION BY test_id, doc_id ORDER BY p) AS no FROM n) SELECT test_id, doc_id, min(p) AS first_word, max(p) - min(p) + 12 AS n_words FROM k GROUP BY test_id, doc_id, no",
        "p8_short_tests": "SELECT test_id, n AS n_words FROM (SELECT DISTINCT test_id, text, len(coalesce(regexp_extract_all(nfc_normalize(text), '[\\p{L}\\p{N}]+'), [])) AS n FROM eval_items WHERE test_id IS NOT NULL) WHERE n < 12",
        "p8_cleaned": f"""{_PLACES}, leaked AS (SELECT doc_id, regexp_extract_all(nfc_normalize(text), '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+') AS x FROM documents WHERE doc_id IN (SELECT doc_id FROM hits)),
 pieces AS (SELECT doc_id, i, x[i] AS piece, CASE WHEN regexp_full_match(x[i], '[\\p{{L}}\\p{{N}}]+') THEN 1 ELSE 0 END AS word FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM leaked)),
 numbered AS (SELECT *, sum(word) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM pieces),
 kept AS (SELECT * FROM numbered n WHERE NOT EXISTS (SELECT 1 FROM hits h WHERE h.doc_id = n.doc_id AND h.p <= n.k AND n.k <= h.p + 10 + n.word)),
 cleaned AS (SELECT doc_id, string_agg(piece, '' ORDER BY i) AS t FROM kept GROUP BY 1)
 SELECT d.doc_id, md5(CASE WHEN l.doc_id IS NULL THEN text ELSE coalesce(t, '') END) AS digest FROM documents d LEFT JOIN leaked l ON l.doc_id = d.doc_id LEFT JOIN cleaned c ON c.doc_id = d.doc_id""",
        "p9_checks": "SELECT 0::BIGINT AS over_repeats, 0::BIGINT AS repeated_slots, 0::BIGINT AS wrong_sizes, true AS near",
        "p10_stretches": f"{_WINDOWS} SELECT * FROM st",
        "p10_shares": f"{_WINDOWS}, cov AS (SELECT id, 300 + sum(CASE WHEN gap IS NULL THEN 0 ELSE least(300, gap) END) AS c FROM (SELECT id, pos - lag(pos) OVER (PARTITION BY id ORDER BY pos) AS gap FROM m) GROUP BY id), cnt AS (SELECT doc_id, count(*) AS n FROM st GROUP BY 1) SELECT d.doc_id, CAST(length(text) AS INT) AS chars, coalesce(n, 0) AS stretches, CAST(coalesce(c, 0) AS BIGINT) AS shared_chars, coalesce(c, 0) / length(text) AS share FROM documents d LEFT JOIN cov ON cov.id = d.doc_id LEFT JOIN cnt ON cnt.doc_id = d.doc_id WHERE length(text) > 0",
        "p3_found": f"{_TIES} SELECT s AS query_id, min(v) AS lead_id FROM r GROUP BY s HAVING count(*) > 1",
        "p8_found": f"{_GRAMS} SELECT DISTINCT a.id AS test_id, b.id AS doc_id FROM g a JOIN g b ON a.side = 't' AND b.side = 'd' AND a.g = b.g",
        "p10_found": "WITH w AS (SELECT DISTINCT doc_id, substr(text, i, 300) AS s FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300)) SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM w a JOIN w b ON a.s = b.s AND a.doc_id < b.doc_id",
        "p4_found": f"{_SETS} SELECT item_a, item_b FROM j WHERE n >= 6 AND n * baskets >= 5 * n_a * n_b AND 16 * n * n >= n_a * n_b",
        "p4_pairs": f"{_SETS} SELECT item_a, item_b, n, n_a, n_b, baskets, round(n * baskets / (n_a * n_b), 6) AS ratio, round({_LLR}, 4) AS llr FROM j",
        "p6_found": f"{_TOP} SELECT query_id, place, item_id FROM k WHERE place <= 5",
        "p6_top5": f"{_TOP} SELECT query_id, place, item_id, score FROM k WHERE place <= 5",
    }
