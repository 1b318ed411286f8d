import pytest
from pyspark.sql import functions as F

from millrace.operators import encoders as E
from millrace.operators import quality as Q
from millrace.operators import ranking as K
from millrace.operators import retrieval as V
from millrace.operators import timeline as T
from millrace.sources import frames


def test_metrics_of_a_hit_at_the_top(spark):
    truth = spark.createDataFrame([("q", "i1"), ("r", "i9")], "query_id string, item_id string")
    preds = spark.createDataFrame([("q", "i1", 1), ("q", "i2", 2), ("q", "i3", 3)], "query_id string, item_id string, rank int")
    m = {r.query_id: r for r in K.query_metrics(truth, preds, 3).collect()}
    assert (m["q"].recall, m["q"].hit, m["q"].ndcg, m["q"].ap, m["q"].rr) == (1, 1, 1, 1, 1)
    assert (m["r"].recall, m["r"].precision, m["r"].ndcg, m["r"].rr) == (0, 0, 0, 0)


def test_mmr_takes_two_categories(spark):
    df = spark.createDataFrame([("q", "a", 0.9, "c1"), ("q", "b", 0.85, "c1"), ("q", "c", 0.8, "c2")], "query_id string, item_id string, score double, cat string")
    assert [r.item_id for r in K.mmr_by_category(df, "cat", 2, 0.5).orderBy("rank").collect()] == ["a", "c"]


def test_padding_reaches_k(spark):
    own = spark.createDataFrame([("q", "a", 1.0)], "query_id string, item_id string, score double")
    pool = spark.createDataFrame([("a", 9.0), ("b", 8.0), ("c", 7.0)], "item_id string, score double")
    queries = spark.createDataFrame([("q",), ("z",)], "query_id string")
    got = sorted((r.query_id, r.rank, r.item_id) for r in K.padded(own, queries, pool, 2).collect())
    assert got == [("q", 1, "a"), ("q", 2, "b"), ("z", 1, "a"), ("z", 2, "b")]


def test_split_bounds_and_embargo(spark):
    df = spark.createDataFrame([(d,) for d in ("2024-01-04", "2024-01-05", "2024-01-08", "2024-01-09")], "ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    at = lambda x: F.lit(x).cast("timestamp")
    split = T.time_split(F.col("ts"), at("2024-01-04"), at("2024-01-08"), 2 * T.DAY_US)
    assert [r[0] for r in df.orderBy("ts").select(split).collect()] == ["train", None, "val", None]


def test_asof_takes_equal_moments_unless_strict(spark):
    left = spark.createDataFrame([(1, "k", 5), (2, "k", 4), (3, None, 9)], "id int, k string, t long")
    right = spark.createDataFrame([("k", 5, 1.0), ("k", 3, 2.0)], "k string, t long, v double")
    take = lambda strict: {r.id: r.v_asof for r in T.asof_join(left, right, "k", "t", ["v"], strict).collect()}
    assert take(False) == {1: 1.0, 2: 2.0, 3: None}
    assert take(True) == {1: 2.0, 2: 2.0, 3: None}


def test_future_events_change_no_feature(spark):
    log = spark.createDataFrame([("u", "i", "2024-01-01"), ("u", "j", "2024-01-02")], "user_id string, item_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    later = log.unionByName(spark.createDataFrame([("u", "i", "2024-01-05")], "user_id string, item_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp")))
    pairs = spark.createDataFrame([("q", "u", "i", "2024-01-03")], "query_id string, user_id string, item_id string, ts_query string").withColumn("ts_query", F.col("ts_query").cast("timestamp"))
    a, b = T.pair_features(pairs, log, [7]).first(), T.pair_features(pairs, later, [7]).first()
    assert a == b and a.recency_item_h == 48.0 and a.recency_user_h == 24.0


def test_numeric_fit_ignores_nan_and_infinity(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (float("inf"),), (None,)], "x double")
    f = E.NumericFit.of(df, ["x"])
    assert f.stats["x"]["mean"] == 2.0 and [r[0] for r in df.select(f.imputed("x")).collect()] == [1.0, 3.0, 2.0, 2.0, 2.0]


def test_folds_leave_the_own_fold_out(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 0, 1), (None, 1, 0), (None, 1, 1)], "c string, y int, fold int")
    got = {(r.c, r.fold): r.c_te for r in E.target_encoded_by_folds(df, "c", "y", "fold", 0.0).collect()}
    assert got == {("a", 0): 0.0, ("a", 1): 1.0, (None, 0): 1.0, (None, 1): 1.0}


def test_quality_of_perfect_scores(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.2)], "y int, p double")
    assert tuple(Q.ranking_quality(df, "y", "p").first()) == (1.0, 1.0)
    assert Q.confusion(df, "y", "p").first().f1 == 1.0


def test_chunks_cover_the_text(spark):
    df = spark.createDataFrame([(1, "x" * 1500), (2, ""), (3, None), (4, "x" * 800)], "id int, text string")
    got = sorted((r.id, r.start, r.end) for r in V.char_chunks(df, "id", "text").collect())
    assert got == [(1, 0, 800), (1, 700, 1500), (4, 0, 800)]
    with pytest.raises(ValueError):
        V.char_chunks(df, "id", "text", 10, 10)


def test_context_window_cuts_a_first_text_over_budget(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (2, "f g")], "doc_id int, text string")
    hits = spark.createDataFrame([("q", 1, 1), ("q", 2, 2), ("r", 2, 1), ("r", 1, 2)], "query string, doc int, rank int")
    got = {r["query"]: (r.n, r.total_tokens, r.context) for r in V.context_window(hits, docs, "doc_id", "text", 3).collect()}
    assert got == {"q": (1, 3, "a b c"), "r": (1, 2, "f g")}


def test_hybrid_keeps_documents_and_queries_with_one_score(spark):
    sparse = spark.createDataFrame([("q", 1, 4.0), ("q", 2, 2.0), ("no vector", 1, 3.0)], "query string, doc int, score double")
    dense = spark.createDataFrame([("q", 2, 0.5), ("q", 3, 1.0), ("no terms", 3, 0.2)], "query string, doc int, score double")
    got = sorted((r["query"], r["rank"], r.doc, r.score) for r in V.hybrid(sparse, dense, 0.4, 2).collect())
    # q: sparse 4, 2, 0 and dense 0, 0.5, 1 of documents 1, 2, 3
    assert got == [("no terms", 1, 3, 0.0), ("no vector", 1, 1, 0.0), ("q", 1, 3, 0.6), ("q", 2, 2, 0.5)]
    assert [(r.doc, r.score) for r in V.hybrid(sparse.where("doc = 1"), dense, 0.8, 1).where("query = 'q'").collect()] == [(1, 0.8)]


def test_json_answers_and_stops(spark):
    rows = [('x ```json\n{"answer": "a", "citations": [1, 2]}\n``` y',), ("no json",), (None,)]
    df = spark.createDataFrame(rows, "r string").select(V.json_answer(F.col("r")).alias("j"), V.cut_at_stops(F.col("r"), ["{", "js"]).alias("c"))
    got = df.collect()
    assert (got[0].j.answer, got[0].j.citations, got[0].c) == ("a", [1, 2], "x ```")
    assert got[1].c == "no " and got[2].c is None and (got[1].j is None or got[1].j.answer is None)


def test_adapting_reads_epochs_and_requires_columns(spark):
    df = spark.createDataFrame([("u", "i", 1704067200000), ("u", "i", 1704067200000)], "uid string, item_id string, ts long")
    out = frames.adapt_interactions(df, {"user_id": "uid"}).collect()
    assert len(out) == 1 and out[0].ts.year == 2024
    with pytest.raises(ValueError):
        frames.adapt_interactions(df, {})


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("q", "b", 2), ("q", "a", 1)], "query_id string, item_id string, rank int")
    frames.write_ranked_lists(df, f"{tmp_path}/l.json", "query_id", "item_id", "rank")
    assert frames.read_table(spark, f"{tmp_path}/l.json").first()["items"] == ["a", "b"]
    frames.write_feature_set(df, f"{tmp_path}/set", ["query_id"])
    assert frames.read_table(spark, f"{tmp_path}/set/matrix.parquet").count() == 2
    with pytest.raises(ValueError):
        frames.read_table(spark, "x.bin")


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names)
    assert entry.entry(spark).limit(1).count() == 1
