import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import candidates as C
from millrace.operators import models as M
from millrace.operators import neighbours as N
from millrace.operators import products as X
from millrace.operators import retrieval as V
from millrace.operators.ranking import best
from millrace.plans import recommend as P


@pytest.fixture
def orders(spark, tmp_path):
    """Writes baskets of (user, items), each an order of its own on one day before the cutoff, and gives the folder."""

    def write(baskets, day="1999-12-01"):
        heads = [(k, u, day) for k, (u, _) in enumerate(baskets)]
        lines = [(k, i, 1.0, "N", n) for k, (_, items) in enumerate(baskets) for n, i in enumerate(items)]
        spark.createDataFrame(heads, "o_orderkey long, o_custkey long, o_orderdate string").selectExpr("o_orderkey", "o_custkey", "CAST(o_orderdate AS DATE) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
        spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double, l_returnflag string, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
        return str(tmp_path)

    return write


def test_walks_reach_items_many_links_away_and_beyond_20_links(spark, orders):
    folder = orders([(1, [1]), *[(2, [i, i + 1]) for i in range(1, 6)]])
    got = {r.item_id: r.score for r in P.k6_walks(spark, folder).where("query_id = 1").collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6} and abs(sum(got.values()) - 1) < 1e-9


def test_walks_take_all_links_of_an_item(spark, orders):
    folder = orders([(1, [1]), *[(2, [1, i]) for i in range(2, 25)]])
    got = {r.item_id: r.score for r in P.k6_walks(spark, folder).where("query_id = 1").collect()}
    assert len(got) == 20 and abs(got[1] + 23 * got[2] - 1) < 1e-9  # 23 equal links share what is not at item 1


def test_walks_follow_old_links(spark, orders):
    folder = orders([(1, [1]), (2, [1, 2]), (2, [2, 3])], day="1992-01-01")
    got = {r.item_id: r.score for r in P.k6_walks(spark, folder).where("query_id = 1").collect()}
    assert set(got) == {1, 2, 3} and abs(sum(got.values()) - 1) < 1e-9


def test_neighbour_sets_are_whole(spark, orders):
    folder = orders([*[(1, [0, i]) for i in range(1, 206)], *[(1, [500, i]) for i in range(1, 101)], (1, [0, 500])])
    got = P.k6_neighbour_jaccard(spark, folder).where("item_i IN (0, 500) AND jaccard > 0.4").collect()
    assert sorted((r.item_i, r.item_j, r.jaccard) for r in got) == [(0, 500, round(100 / 207, 6)), (500, 0, round(100 / 207, 6))]


def test_common_neighbours_against_brute_force(spark):
    rng = random.Random(3)
    links = {tuple(sorted(rng.sample(range(25), 2))) for _ in range(90)} | {(0, i) for i in range(1, 25)}
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    got = {(r.item_i, r.item_j): r.jaccard for r in C.neighbour_jaccard(spark.createDataFrame(sorted(links), "item_i long, item_j long")).collect()}
    assert set(got) == links | {(b, a) for a, b in links}
    assert all(abs(x - len(near[a] & near[b]) / len(near[a] | near[b])) < 1e-12 for (a, b), x in got.items())
    assert C.neighbour_jaccard(spark.createDataFrame([], "item_i long, item_j long")).count() == 0


def test_common_neighbours_without_rows_of_wedges(spark, monkeypatch):
    rng = random.Random(6)
    sets = [rng.sample(range(0, 300, 3), rng.choice([1, 2, 3, 9])) for _ in range(120)] + [list(range(0, 120, 3))]
    near = defaultdict(set)
    for x in sets:
        for i in x:
            near[i] |= {*x} - {i}
    value = {(a, b): len(near[a] & near[b]) / len(near[a] | near[b]) for a in near for b in near[a]}
    rows = spark.createDataFrame([(s, i) for s, x in enumerate(sets) for i in x], "session_id long, item_id long")
    monkeypatch.setattr(N, "MET", 50)  # scopes and neighbours in pieces
    graph, _ = N.graph_of(rows, "session_id")
    for tasks in (1, 5):
        graph = N._graph(rows.groupBy("session_id").agg(F.collect_list("item_id").alias("x")).where(F.size("x") > 1).select("x"), tasks)
        got = N.nearest_neighbours(graph, tasks, "bigint", 7).collect()
        best7 = {(a, b, k + 1, value[a, b]) for a in near for k, b in enumerate(sorted(near[a], key=lambda b: (-value[a, b], b))[:7])}
        assert len(got) == len(best7) and {(r.item_i, r.item_j, r["rank"], r.jaccard) for r in got} == best7
    hist = [(q, p, rng.choice([*near, 1])) for q in range(9) for p in range(4)]
    want = defaultdict(float)
    for q, _, i in hist:
        for b in near.get(i, ()):
            want[q, b] += value[i, b]
    found = N.neighbour_candidates(graph, 5, "bigint", spark.createDataFrame(hist, "query_id long, pos int, item_id long")).collect()
    assert {(r.query_id, r.item_id): r.score for r in found} == want and len(found) == len(want)
    assert N.nearest_neighbours(*N.graph_of(rows.limit(0), "session_id"), "bigint", 7).count() == 0


def test_pairs_of_long_scopes_in_blocks(spark):
    rows = [("s", i) for i in range(40)] + [("t", 1), ("t", 1), (None, 3), ("u", 9)]
    got = C.paired(spark.createDataFrame(rows, "s string, x int"), "s", ["x"], block=7).collect()
    assert sorted(tuple(sorted((r.x_a, r.x_b))) for r in got) == sorted([(a, b) for a in range(40) for b in range(a + 1, 40)] + [(1, 1)])


def test_covisits_decay_by_the_days_between(spark):
    rows = [("u", 1, "2024-01-01"), ("u", 2, "2024-01-11"), ("u", 1, "2024-01-11"), ("v", 3, "2023-01-01"), ("v", 4, "2023-01-01"), (None, 5, "2024-01-11"), ("w", None, "2024-01-11")]
    log = spark.createDataFrame(rows, "user_id string, item_id int, ts string").withColumn("ts", F.to_timestamp("ts"))
    got = {(r.item_i, r.item_j): r.w for r in C.covisit_edges(log, "2024-01-20", "user_id", min_weight=0).collect()}
    far = math.exp(-0.5)
    assert set(got) == {(1, 2), (2, 1), (1, 1)} and abs(got[1, 2] - (1 + far)) < 1e-12 and abs(got[1, 1] - 2 * far) < 1e-12
    assert {(r.item_i, r.item_j) for r in C.covisit_edges(log, "2024-01-20", "user_id", min_weight=1.5).collect()} == {(1, 2), (2, 1)}


def test_walks_by_joins_equal_walks_beside_the_graph(spark, monkeypatch):
    rng = random.Random(5)
    links = {tuple(rng.sample(range(12), 2)): rng.random() for _ in range(40)}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()] + [(3, 11, 0.0)], "item_i long, item_j long, w double")
    seeds = spark.createDataFrame([("p", 1), ("p", 1), ("p", 5), ("q", 99), ("q", 2)], "query_id string, item_id long")
    take = lambda: {(r.query_id, r.item_id): r.score for r in C.personalised_rank(edges, seeds).collect()}
    beside = take()
    monkeypatch.setattr(C, "MAX_LINKS", 0)
    joined = take()
    assert set(beside) == set(joined) and all(abs(beside[k] - joined[k]) < 1e-12 for k in joined) and beside["q", 99] > 0


def test_walks_leave_out_what_cannot_be_among_the_best(spark, monkeypatch):
    rng = random.Random(8)
    links = {tuple(rng.sample(range(40), 2)): rng.choice([1.0, 2.0]) for _ in range(300)} | {(50, i): 1.0 for i in range(60, 90)}
    edges = spark.createDataFrame([(a, b, w) for (a, b), w in links.items()], "item_i long, item_j long, w double")
    seeds = spark.createDataFrame([(q, rng.randrange(40)) for q in range(30) for _ in range(3)] + [(30, 50), (31, 99), (31, 2)], "query_id long, item_id long")
    top = lambda df: sorted((r.query_id, r["rank"], r.item_id, r.score) for r in best(df.withColumn("score", F.round("score", 9)), "query_id", "score", "item_id", 4).collect())
    whole = top(C.personalised_rank(edges, seeds))
    monkeypatch.setattr(C, "GATHERED", 7)  # links of an item in pieces
    few = C.personalised_rank(edges, seeds, k=4, apart=2e-9)
    assert top(few) == whole and few.count() < 32 * 8 < C.personalised_rank(edges, seeds).count()
    assert [x[2] for x in whole if x[0] == 30] == [50, 60, 61, 62]  # 30 ties: the least items


def test_nearest_are_those_of_all_scores_without_a_row_a_pair(spark, monkeypatch):
    rng = random.Random(4)
    vector = lambda: [rng.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)]
    index = spark.createDataFrame([(str(i), vector()) for i in range(150)], "doc string, vector array<float>")
    asked = spark.createDataFrame([(i, vector()) for i in range(70)], "query long, vector array<double>")
    whole = sorted(V.dense(index, asked, 5).collect())
    monkeypatch.setattr(V, "ROWS_A_PART", 60)
    got = V.nearest(index, asked, 5, block=30, tile=500)
    assert len(whole) == 350 and [tuple(r) for r in sorted(got.collect())] == [tuple(r) for r in whole]
    assert V.nearest(index.limit(0), asked, 5).count() == 0 and V.nearest(index.limit(3), asked, 5).count() == 210
    # item vectors of four million pairs: in seconds, where each pair was a row
    many = spark.range(2000).selectExpr("CAST(id AS string) AS item_id", "array(sin(id), cos(id), 1D) AS vector")
    near = M.vector_candidates(spark.range(2000).selectExpr("id AS query_id", "id AS item_id"), many, 10)
    assert near.groupBy("query_id").count().where("count = 10").count() == 2000
    assert near.where("query_id = item_id AND score = 1").count() == 2000


def test_negatives_come_from_all_items_by_weight(spark):
    items = spark.createDataFrame([(i, 1000.0 if i == 0 else 1.0) for i in range(2001)], "item_id long, weight double")
    own = {q: {2000 - q} for q in range(300)} | {"heavy": set(range(1994)), "all but two": set(range(1999))}
    positives = spark.createDataFrame([(str(q), i) for q, x in own.items() for i in x], "query_id string, item_id long")
    drawn = C.sampled_negatives(positives, items, 5)
    got = defaultdict(list)
    for r in drawn.collect():
        got[r.query_id].append(r.item_id)
    for q, x in own.items():
        assert len(set(got[str(q)])) == len(got[str(q)]) == (2 if q == "all but two" else 5) and not x & set(got[str(q)])
    # item 0 has a third of the weight: 1 - (2/3)^5 = 0.87 of the queries have it
    assert 0.8 < sum(0 in got[str(q)] for q in range(300)) / 300 < 0.93
    others = {i for q in range(300) for i in got[str(q)]}
    assert len(others) > 700 and sorted(drawn.collect()) == sorted(C.sampled_negatives(positives, items, 5).collect())


def test_greatest_products_are_those_of_all_pairs_and_few_are_multiplied(spark, monkeypatch):
    rng, n = np.random.default_rng(3), 30_000
    items = (rng.normal(size=(n, 6)) * rng.uniform(0.2, 1, (n, 1))).astype(np.float32)
    items[5], items[7:9] = items[6], 0
    asked = rng.normal(size=(300, 6)).astype(np.float32)
    asked[4] = 0
    norms = np.sqrt((items.astype(float) ** 2).sum(1))
    order = np.lexsort((np.arange(n), -norms))
    whole = asked.astype(float) @ items[order].astype(float).T
    want = [[order[p] for p in np.argsort(-s.round(13), kind="stable")[:7]] for s in whole]
    cells, product = [], np.matmul
    monkeypatch.setattr(np, "matmul", lambda a, b, **x: cells.append(len(a) * b.shape[1]) or product(a, b, **x))
    row, place, score = X.greatest(asked, items[order], norms[order], 7)
    got = {q: order[place[row == q]].tolist() for q in range(300)}
    assert got == dict(enumerate(want)) and sum(cells) < 0.5 * 300 * n
    assert np.abs(score - whole[row, place]).max() < 1e-12
    few = X.greatest(asked, items[order][:3], norms[order][:3], 7)
    assert len(few[0]) == 900 and (np.bincount(few[0]) == 3).all()
    table = lambda x, c: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], f"{c} int, vector array<float>")
    found = X.greatest_products(table(items, "doc").repartition(5), table(asked, "query"), 7).collect()
    per = {q: [] for q in range(300)}
    for r in sorted(found, key=lambda r: (-r.score, -norms[r.doc], r.doc)):
        per[r.query].append(r.doc)
    assert per == {q: [int(i) for i in x] for q, x in enumerate(want)}
    assert X.greatest_products(table(items[:0], "doc"), table(asked, "query"), 7).count() == 0


def test_factor_candidates_are_the_best_products_of_the_factors(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(f"u{rng.randrange(40)}", rng.randrange(300) * 10**12) for _ in range(1500)] + [(None, 1), ("u1", None)]
    log, held = spark.createDataFrame(rows, "user_id string, item_id long"), []
    monkeypatch.setattr(M, "greatest_products", lambda items, users, k: held.append((items.collect(), users.collect())) or X.greatest_products(items, users, k))
    asked = spark.createDataFrame([("u1", 1), ("u1", 2), ("u2", 3), ("stranger", 4)], "user_id string, query_id int")
    got = M.factor_candidates(log, asked, 10, rank=4).collect()
    items, users = held[0]
    scores = [sorted(r.score for r in got if r.query_id == q) for q in (1, 2, 3)]
    best = [sorted(sorted((float(np.dot(u.vector, i.vector)) for i in items), reverse=True)[:10]) for u in users]
    assert len(users) == 2 and len(items) == len({i for u, i in rows if u and i is not None}) and len(got) == 30 and scores[0] == scores[1]
    assert all(min(max(abs(a - b) for a, b in zip(s, x)) for x in best) < 1e-6 for s in scores)
    assert {r.item_id for r in got} <= {i for _, i in rows} and len({(r.query_id, r.item_id) for r in got}) == 30
