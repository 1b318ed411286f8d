from datetime import datetime

from pyspark.sql import functions as F

from millrace.operators import summaries as U
from millrace.operators import timeline as T


def test_reports_of_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([("q", "a", 1, "s"), ("q", "b", 2, "s"), ("q", "b", 1, "r"), (None, "c", 1, "s")], "query_id string, item_id string, rank int, source string")
    truth = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "b"), ("z", "c")], "query_id string, item_id string")
    assert {(r.source, r.hits) for r in U.source_attribution(df, truth, 2).collect()} == {("s", 1), ("r", 1), (None, 1)}
    assert U.source_attribution(df.limit(0), truth.limit(0), 2).count() == 0
    assert {(r.feature, r.distinct) for r in U.distinct_counts(df, ["query_id", "source"]).collect()} == {("query_id", 1), ("source", 2)}
    assert {(r.feature, r.distinct) for r in U.distinct_counts(df.limit(0), ["query_id"]).collect()} == {("query_id", 0)}
    assert {(r.source, r.n, r.share) for r in U.split_report(df, "source").collect()} == {("s", 3, 0.75), ("r", 1, 0.25)}
    assert sorted((r.item_id, r.copies) for r in U.repeated_rows(df, ["query_id", "item_id"]).collect()) == [("b", 2), ("b", 2)]
    assert sorted(r.rank for r in U.first_rows(df, ["item_id"], [F.col("rank")]).collect()) == [1, 1, 1]
    runs = df.select(F.col("source").alias("run"), "query_id", "item_id")
    assert [(r.a, r.b, r.common) for r in U.run_overlaps(runs, ["query_id", "item_id"]).collect()] == [("r", "s", 1)]


def test_vectors_lists_and_names(spark):
    v = spark.createDataFrame([("a", [1.0, -2.0]), ("a", [3.0, 2.0]), (None, [9.0, 9.0])], "k string, v array<double>")
    assert [r.v for r in U.vector_aggregate(v, "k", "v", "mean").collect()] == [[2.0, 0.0]] and [r.v for r in U.vector_aggregate(v, "k", "v", "max").collect()] == [[3.0, 2.0]]
    assert [[round(x, 6) for x in r.v] for r in U.vector_aggregate(v, "k", "v", "gem").collect()] == [[round(14 ** (1 / 3), 6), 2.0]]
    s = U.list_statistics(F.col("t"))
    rows = spark.createDataFrame([("a, b,a,,",), ("",), (None,)], "t string").select(*[c.alias(k) for k, c in s.items()]).collect()
    assert [(r.len, r.distinct, round(r.top1_share, 6), round(r.entropy, 6)) for r in rows] == [(3, 2, 0.666667, 0.918296), (0, 0, 0.0, 0.0), (0, 0, 0.0, 0.0)]
    assert [r.n for r in spark.createDataFrame([(" Ä-b  c!",), (None,)], "t string").select(U.plain_name(F.col("t")).alias("n")).collect()] == ["ä_b_c", None]
    assert U.embargo_us("1d 2h") == 26 * 3_600_000_000
    assert U.repeated_columns(spark.createDataFrame([(1, "1", None), (2, "2", 5)], "a int, b string, c int")) == [["a", "b"]]


def test_coverage_and_capped_sessions(spark):
    df = spark.createDataFrame([("u", datetime(2024, 1, d), d * T.DAY_US, d) for d in (1, 1, 9)] + [("u", None, None, 0)], "user string, ts timestamp, us long, id int")
    r = T.coverage(df, "ts", [7]).first()
    assert (r.span_days, r.missing_days, r.busiest) == (9, 7, 2) and abs(r.recent_7 - 1 / 3) < 1e-12
    got = sorted((r.no, r.piece, r.n) for r in T.capped_sessions(df, "user", "us", "id", most=1).collect())
    assert got == [(0, 0, 1), (0, 1, 1), (1, 0, 1)]
    assert T.coverage(df.limit(0), "ts").first().span_days is None and T.session_lengths(df.limit(0), "user").first().sessions == 0
