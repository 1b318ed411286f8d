import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import blending as W
from millrace.operators import blocks as B
from millrace.operators import encoders as E
from millrace.operators import quality as Q
from millrace.operators import timeline as T
from millrace.session import named_folder
from millrace.sources import sets as S
from millrace.streaming import live

DAY = T.DAY_US
NAN, INF = float("nan"), float("inf")
LOG = "user_id string, item_id string, ts timestamp, line int"


def _log(spark, n=120, seed=1):
    rng, start = random.Random(seed), datetime(2024, 1, 1)
    rows = [(rng.choice(["u", "v", "w", None]), rng.choice("abcd"), start + timedelta(hours=rng.randrange(2400)), i % 3) for i in range(n)]
    return rows, spark.createDataFrame(rows, LOG)


def test_sums_up_to_a_moment_against_brute_force(spark):
    rng = random.Random(2)
    events = [(rng.choice(["a", "b", None]), rng.randrange(5 * DAY), rng.choice([1, -1, 3])) for _ in range(60)] + [("a", None, 5)]
    probes = [(i, rng.choice(["a", "b", "c", None]), rng.randrange(6 * DAY)) for i in range(40)] + [(99, "a", None), (98, "a", events[0][1])]
    ev = spark.createDataFrame(events, "k string, t long, n long").withColumn("own", F.lit(True))
    got = {r.id: (r.n, r.own) for r in T.totals_at(spark.createDataFrame(probes, "id int, k string, t long"), ev, "k", "t", ["n"], "own").collect()}
    for i, k, t in probes:
        own = [(x, n) for e, x, n in events if e == k and k is not None and x is not None and t is not None and x <= t]
        assert got[i] == (sum(n for _, n in own), max((x for x, _ in own), default=None))


def test_history_is_the_last_events_of_each_query(spark):
    rows, log = _log(spark)
    asked = [(f"q{i}", u, datetime(2024, 1, 1) + timedelta(days=d)) for i, (u, d) in enumerate([("u", 50), ("u", 10), ("v", 99), ("x", 50), (None, 50)])] + [("q9", "u", None)]
    queries = spark.createDataFrame(asked, "query_id string, user_id string, ts_query timestamp")
    got = {}
    for r in T.history(log, queries, 5).collect():
        got.setdefault(r.query_id, {})[r.pos] = r.item_id
    for q, u, t in asked:
        own = sorted(((ts, line, item) for user, item, ts, line in rows if user == u and u and t and ts <= t), reverse=True)[:5]
        assert got.get(q, {}) == {k: x[2] for k, x in enumerate(own)}


def test_last_events_are_the_history_at_the_last_moment(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["u", "v", "w", None]), rng.randrange(9), f"2024-01-0{rng.randrange(1, 6)}", rng.randrange(3)) for _ in range(60)]
    log = spark.createDataFrame([*rows, ("x", 1, None, 1)], "user_id string, item_id int, ts string, line int").withColumn("ts", F.to_timestamp("ts"))
    queries = T.latest(log.where("ts IS NOT NULL"), "user_id").withColumn("query_id", F.col("user_id"))
    want = sorted(T.history(log, queries, 4).select("query_id", "item_id", "pos").collect())
    found = T.last_events(log, 4)
    assert len(want) == 12 and sorted(found.collect()) == want
    plan = found._jdf.queryExecution().executedPlan().toString().rpartition("Initial Plan")[2]
    assert plan.count("WindowGroupLimit") == 2 and plan.count("Exchange") == 1  # history has an exchange of all events and two more


def test_pair_features_against_brute_force(spark):
    rows, log = _log(spark, 200)
    pairs = [(f"q{i}", u, x, datetime(2024, 1, 1) + timedelta(hours=h)) for i, (u, x, h) in enumerate([("u", "a", 2000), ("u", "z", 900), ("v", "b", 5), ("w", "c", 2400), ("x", "a", 700)])]
    got = {r.query_id: r for r in T.pair_features(spark.createDataFrame(pairs + pairs[:1], "query_id string, user_id string, item_id string, ts_query timestamp"), log, [7, 30]).collect()}
    assert len(got) == len(pairs)
    for q, u, x, t in pairs:
        own, item = [r for r in rows if r[0] == u and r[2] <= t], [r for r in rows if r[1] == x and r[2] <= t]
        r = got[q]
        assert r.seen_before == int(any(e[1] == x for e in own))
        for d in (7, 30):
            near = [e for e in own if e[2] >= t - timedelta(days=d)]
            assert (r[f"user_count_{d}d"], r[f"user_items_{d}d"], r[f"item_count_{d}d"]) == (len(near), len({e[1] for e in near}), sum(e[2] >= t - timedelta(days=d) for e in item))
        assert r.recency_user_h == (round((t - max(e[2] for e in own)).total_seconds() / 3600, 6) if own else None)


def test_blocks_joiner_and_alignment(spark):
    _, log = _log(spark)
    items = spark.createDataFrame([("a", "x", 2.0), ("b", "y", None), (None, "y", 1.0)], "item_id string, category string, size double")
    pairs = spark.createDataFrame([("q", "u", "a", datetime(2024, 3, 1)), ("q", "u", "zz", datetime(2024, 3, 1))], "query_id string, user_id string, item_id string, ts_query timestamp")
    made = B.build_blocks({"user_agg": {}, "item_agg": {}, "similarity": {}, "attributes": {"columns": ["size"]}, "cross": {}, "pairwise_core": {"windows": [7]}, "sequence": {"enabled": False}}, {"item_agg": {"windows": [30]}})
    out = B.FeatureJoiner(made).fit(log, items).transform(pairs, pairs.limit(0))
    rows = {r.item_id: r for r in out["train"].collect()}
    assert set(rows) == {"a", "zz"} and rows["zz"].item_pop_30d == 0 and rows["a"]["size"] == 2.0 and rows["zz"].cat_match_share == 0
    assert out["test"].count() == 0 and out["test"].columns == out["columns"] == ["query_id", "item_id", *sorted(out["columns"][2:])]
    assert {c["block"] for c in out["catalog"]} == set(made)
    with pytest.raises(ValueError):
        B.build_blocks({"nothing": {}})


def test_late_rows_and_column_problems(spark):
    q = spark.createDataFrame([("q", datetime(2024, 1, 2)), ("r", None)], "query_id string, ts_query timestamp")
    rows = spark.createDataFrame([("q", datetime(2024, 1, 2)), ("q", datetime(2024, 1, 3)), ("r", datetime(2030, 1, 1)), (None, datetime(2030, 1, 1))], "query_id string, ts timestamp")
    assert B.late_rows(rows, q).count() == 1
    with pytest.raises(AssertionError):
        B.assert_time_safe(rows, q)
    a = spark.createDataFrame([("q", "i", 1.0, None), ("q", "j", NAN, 2)], "query_id string, item_id string, x double, y int")
    b = spark.createDataFrame([("q", "i", "t")], "query_id string, item_id string, x string")
    assert {(r.column, r.side, r.problem) for r in B.column_problems(a, b).collect()} == {("y", "test", "missing"), ("x", "test", "type string for double"), ("y", "train", "null"), ("x", "train", "not finite")}


def test_training_pairs_of_few_items(spark):
    rows, log = _log(spark)
    q = spark.createDataFrame([("q", "u", datetime(2030, 1, 1)), ("none", "x", datetime(2030, 1, 1))], "query_id string, user_id string, ts_query timestamp")
    got = B.build_pairs(log, q, 10, "uniform").collect()
    last = max((r[2], r[3], r[1]) for r in rows if r[0] == "u")[2]
    assert {(r.query_id, r.item_id, r.label) for r in got} == {("q", x, int(x == last)) for x in "abcd"}
    with pytest.raises(ValueError):
        B.build_pairs(log, q, 1, "hard")


def test_exact_quantiles_by_group(spark):
    rng = random.Random(4)
    rows = [(g, rng.choice([None, rng.randrange(20)]) if g else 1.0) for g in ("a", "b", None) for _ in range(57)] + [("one", 7.0), ("empty", None)]
    df = spark.createDataFrame([(g, None if x is None else float(x)) for g, x in rows], "g string, x double")
    probs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r.g: r.q for r in Q.grouped_quantiles(df, "g", "x", probs).collect()}
    for g in ("a", "b", "one"):
        assert np.allclose(got[g], np.quantile([x for k, x in rows if k == g and x is not None], probs))
    assert set(got) == {"a", "b", "one"} and Q.quantiles(df.limit(0), "x", [0.5]) == []


def test_blends_and_thresholds(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    df = spark.createDataFrame([(i, int(t), float(0.6 * t + 0.4 * rng.random()), float(rng.random()), i % 3) for i, t in enumerate(y)], "key long, y int, a double, b double, fold int")
    m = W.moments(df, ["a", "b"], "y")[0]
    w = W.convex_weights(m)
    assert abs(w.sum() - 1) < 1e-9 and (w >= 0).all() and w[0] > 0.8
    pdf = df.toPandas()
    assert np.allclose(W.squared_error(m, [0, *w]), ((pdf[["a", "b"]].to_numpy() @ w - pdf["y"]) ** 2).mean())
    x = np.c_[np.ones(300), pdf[["a", "b"]]]
    assert np.allclose(W.ridge_weights(m, 3.0), np.linalg.solve(x.T @ x + np.diag([0, 3, 3]), x.T @ pdf["y"]))
    assert np.allclose(W.simplex(np.array([0.5, 0.5])), [0.5, 0.5]) and np.allclose(W.simplex(np.array([2.0, -1.0])), [1, 0])
    nulls = spark.createDataFrame([(1, 0.2, None), (2, None, None), (3, 0.2, 0.6)], "k int, a double, b double")
    got = {r.k: (r.blend, r.median) for r in W.median_blend(W.blended(nulls, {"a": 1, "b": 3}), ["a", "b"], "median").collect()}
    assert got[2] == (None, None) and got[1] == (0.2, 0.2) and abs(got[3][0] - 0.5) < 1e-12 and abs(got[3][1] - 0.4) < 1e-12


def test_sets_are_checked_and_read_back(spark):
    path = named_folder(spark, "test-set")
    train = spark.createDataFrame([(1, 2.0, 1), (2, NAN, 0)], "id int, x double, y int")
    test = spark.createDataFrame([(3, 1.0)], "id int, x double")
    S.write_set(path, train, test, ["id"], "y")
    got = S.read_set(spark, path)
    assert got["train"].count() == 2 and got["test"].columns == ["id", "x"] and got["features"] == ["x"] and got["folds"] is None
    for a, b in ((train, test.drop("x")), (train.unionByName(train), test), (train, test.withColumn("x", F.col("x").cast("string")))):
        with pytest.raises(ValueError):
            S.write_set(path, a, b, ["id"], "y")
    with pytest.raises(ValueError):
        S.write_set(path, train, test, ["id"], "y", train.where("id = 1").select("id", F.lit(0).alias("fold")))
    made = S.Indexers.of({"user_id": spark.createDataFrame([("b",), ("a",), (None,), ("a",)], "user_id string")})
    rows = made.apply(spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "user_id string")).collect()
    assert {(r.user_id, r.user_idx) for r in rows} == {("a", 0), ("b", 1), ("z", -1), (None, -1)}


def test_samples_and_encoders(spark):
    df = spark.createDataFrame([(i, "a" if i < 30 else "b" if i < 40 else None) for i in range(50)], "id int, c string")
    n = lambda x: {r.c: r["count"] for r in x.groupBy("c").count().collect()}
    assert n(E.balanced(df, "c", "id")) == {"a": 10, "b": 10, None: 10} and n(E.stratified_sample(df, "c", "id", 0.25)) == {"a": 8, "b": 3, None: 3}
    x = spark.createDataFrame([(v, float(v > 3)) for v in [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]] + [(NAN, 1.0), (None, 0.0), (INF, 1.0)], "x double, y double")
    assert E.tree_edges(x, "x", "y", 2) == [3.0] and E.tree_edges(x.limit(0), "x", "y", 4) == []


def test_neighbours_across_the_meridian(spark):
    rows = [(1, 0.0, 179.99), (2, 0.0, -179.99), (3, 0.0, 179.5), (4, 60.0, 179.99), (5, 60.01, -179.97), (6, None, 1.0), (7, 89.99, 0.0), (8, 89.99, 180.0)]
    df = spark.createDataFrame(rows, "k int, la double, lo double")
    got = {r.k: r.n for r in E.radius_neighbours(df, "k", "la", "lo", 5000).collect()}
    assert got == {1: 1, 2: 1, 3: 0, 4: 1, 5: 1, 7: 1, 8: 1}


def test_radius_counts_points_of_one_place_without_pairing_them(spark):
    # 60 000 points on two near places: their pairs would be 3.6e9 rows
    df = spark.range(60_000).selectExpr("id AS k", "45.0D + (id % 2) * 0.01D AS la", "7.0D AS lo")
    got = E.radius_neighbours(df, "k", "la", "lo", 5000).selectExpr("count(*) AS c", "min(n) AS lo", "max(n) AS hi").first()
    assert (got.c, got.lo, got.hi) == (60_000, 59_999, 59_999)
    rows = [(1, 45.0, 7.0), (1, 45.0, 7.0), (1, 46.0, 7.0), (2, 45.0, 7.0), (3, 46.0, 7.0), (3, 46.0, 7.0), (None, 45.0, 7.0)]
    got = {r.k: r.n for r in E.radius_neighbours(spark.createDataFrame(rows, "k int, la double, lo double"), "k", "la", "lo", 5000).collect()}
    assert got == {1: 4, 2: 2, 3: 2, None: 0}  # pairs of points of different keys, as in SQL


def test_asof_over_slots_against_brute_force(spark):
    rng = random.Random(7)
    right = [(rng.choice("ab"), rng.randrange(60), rng.randrange(5)) for _ in range(40)] + [("a", None, 1), (None, 3, 1)]
    left = [(i, rng.choice(["a", "b", "c", None]), rng.randrange(70)) for i in range(40)] + [(99, "a", None)]
    for strict in (False, True):
        out = T.asof_join(spark.createDataFrame(left, "id int, k string, t long"), spark.createDataFrame(right, "k string, t long, v int"), "k", "t", ["v"], strict, slot=7)
        got = {r.id: r.v_asof for r in out.collect()}
        for i, k, t in left:
            own = [(x, v) for e, x, v in right if k and t is not None and e == k and x is not None and (x < t or (x == t and not strict))]
            assert got[i] == (max(own)[1] if own else None)


def test_json_answers(spark):
    from millrace.operators.retrieval import json_answer

    rows = [(1, 'x {a} {"answer": "yes", "citations": [2]} {"answer": "no"}'), (2, "plain [1] text [22]"), (3, None), (4, ""), (5, '```json\n{"answer": null}\n```'), (6, '{"a": {"answer": "deep"}}')]
    got = {r.id: r.x and (r.x.answer, r.x.citations) for r in spark.createDataFrame(rows, "id int, t string").select("id", json_answer(F.col("t")).alias("x")).collect()}
    assert got[1] == ("yes", [2]) and got[2] == ("plain [1] text [22]", [1, 22]) and got[3] is None and got[4] == ("", []) and got[5][1] == [] and got[6][1] == []


def test_streams_drop_late_rows_of_closed_windows(spark):
    path = named_folder(spark, "stream-in")
    at = lambda d, h=0: datetime(2024, 1, d, h)
    for k, rows in enumerate([[("u", at(1)), ("u", at(1, 5)), ("v", at(9))], [("u", at(20))], [("u", at(1, 6)), ("v", at(30))]]):
        spark.createDataFrame(rows, "user_id string, ts timestamp").coalesce(1).write.parquet(f"{path}/{k}")
    files = [spark.read.parquet(f"{path}/{k}") for k in range(3)]
    for k, f in enumerate(files):
        f.coalesce(1).write.mode("append").parquet(f"{path}/all")
    stream = lambda: spark.readStream.schema("user_id string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{path}/all")
    got = {(r.user_id, r.start): r.n for r in live.run_available(spark, live.windowed_counts(stream(), "user_id", "ts", "1 day", late="2 days"), "append").collect()}
    # the row of 06:00 on the first came a batch after its day was closed
    assert got[("u", at(1))] == 2 and got[("v", at(9))] == 1 and ("v", at(30)) not in got
    counters = live.run_available(spark, live.running_counters(stream(), "user_id", "ts", "365 days"), "update").collect()
    assert max(r.n for r in counters if r.user_id == "u") in (3, 4)
