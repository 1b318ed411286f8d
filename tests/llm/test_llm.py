import random
import unicodedata
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest

from millrace.llm import leaks, together
from millrace.llm.leaks import leaked_passages, short_tests, without_leaks
from millrace.llm.mix import _permuted, mixed, plan_blocks
from millrace.llm.shared import shared_pairs, shared_shares, shared_stretches
from millrace.llm.splits import deal_splits, spanning_forest, tied_records
from millrace.llm.together import items_together
from millrace.llm.topn import top_n
from millrace.llm.words import words

NAN, INF = float("nan"), float("inf")
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def test_top_n_ties_nan_zeros_and_clashing_columns(spark):
    rows = [("q", "a", 1.0), ("q", "a", 2.0), ("q", "b", 2.0), ("q", "c", NAN), ("q", "d", None), ("q", "e", -0.0), ("q", "d2", 0.0), ("q", None, 9.0), (None, "a", 9.0), ("r", "z", INF), ("r", "y", -INF)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "query string, item string, score double, g string, s string")
    got = [(r["query"], r.place, r.item) for r in top_n(df, "query", "item", "score", 3).orderBy("query", "place").collect()]
    assert got == [("q", 1, "a"), ("q", 2, "b"), ("q", 3, "d2"), ("r", 1, "z"), ("r", 2, "y")]
    assert top_n(df.limit(0), "query", "item", "score").count() == 0


def test_top_n_limits_groups_before_the_exchange(spark):
    df = spark.createDataFrame([("q", "a", 1.0)], "query string, item string, score double")
    plan = top_n(df, "query", "item", "score", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def _together(rows, least):
    sets = defaultdict(set)
    for s, i in rows:
        if s is not None and i is not None:
            sets[s].add(i)
    single, pairs = Counter(i for x in sets.values() for i in x), Counter(p for x in sets.values() for p in combinations(sorted(x), 2))
    return {p: (n, single[p[0]], single[p[1]], len(sets)) for p, n in pairs.items() if n >= least}


@pytest.mark.parametrize("least", [1, 2, 3])
@pytest.mark.parametrize("giants", [1024, 2])
def test_pairs_with_long_baskets_against_brute_force(spark, monkeypatch, least, giants):
    monkeypatch.setattr(together, "GIANTS", giants)
    rng = random.Random(11)
    rows = [(f"s{rng.randrange(30)}", f"i{min(rng.randrange(60), rng.randrange(60)):02d}") for _ in range(150)]
    rows += [(f"long{k}", f"i{i:02d}") for k in range(5) for i in rng.sample(range(60), 25)]
    rows += [(None, "i01"), ("s1", None), ("alone", "i99")] + rows[:10]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "basket string, item string, s int, i int")
    got = {(r.item_a, r.item_b): (r.n, r.n_a, r.n_b, r.baskets) for r in items_together(df, "basket", "item", min_together=least, block=8, hot_baskets=6).collect()}
    assert got == _together(rows, least)


def test_pairs_bounds_and_empty(spark):
    rows = [(s, i) for s in range(10) for i in ("a", "b")] + [(s, "c") for s in range(10, 30)] + [(3, "c")]
    df = spark.createDataFrame(rows, "basket int, item string")
    got = items_together(df, "basket", "item", min_together=2, min_ratio=2).collect()
    assert [(r.item_a, r.item_b, r.n, round(r.ratio, 6)) for r in got] == [("a", "b", 10, 3.0)] and got[0].llr > 30
    assert items_together(df.limit(0), "basket", "item").count() == 0


def test_forest_and_ties(spark):
    rng = random.Random(2)
    links = [(f"v{rng.randrange(60)}", f"v{rng.randrange(60)}") for _ in range(40)] + [("p0", "p1"), ("p1", None), (None, None), ("x", "x")]
    links += [(f"p{i}", f"p{i + 1}") for i in range(30)] + links[:5]  # a long path
    labels, forest = spanning_forest(spark.createDataFrame(links, "a string, b string"), "a", "b")
    root = {r.vertex: r.root for r in labels.collect()}
    group: dict = {}

    def find(x):
        while group.setdefault(x, x) != x:
            x = group[x]
        return x

    for a, b in links:
        if a and b and a != b:
            group[find(a)] = find(b)
    assert set(root) == set(group)
    assert {frozenset(v for v in group if find(v) == r) for r in map(find, list(group))} == {frozenset(v for v in root if root[v] == r) for r in root.values()}
    assert forest.count() == len(root) - len(set(root.values()))
    empty, _ = spanning_forest(spark.createDataFrame([], "a string, b string"), "a", "b")
    assert empty.count() == 0
    tied = tied_records(spark.createDataFrame([("1", "u"), ("2", "u"), ("3", None), ("4", "w")], "r string, k string"), "r", "k").collect()
    assert {r.r for r in tied} == {"1", "2", "4"} and len({r.root for r in tied}) == 2


def test_splits_reach_their_shares(spark):
    rng = random.Random(4)
    sizes = [("big", 300)] + [(f"m{i}", rng.randrange(2, 30)) for i in range(60)] + [(f"s{i}", 1) for i in range(1500)]
    shares = {"train": 0.8, "validation": 0.1, "test": 0.1}
    out = {r.root: r.split for r in deal_splits(spark.createDataFrame(sizes, "root string, n long"), "root", "n", shares).collect()}
    assert len(out) == len(sizes)
    total = sum(n for _, n in sizes)
    for k, x in shares.items():
        assert abs(sum(n for r, n in sizes if out[r] == k) / total - x) < 0.01
    assert deal_splits(spark.createDataFrame([], "root string, n long"), "root", "n", shares).count() == 0


def test_words():
    assert words("Été, foo_bar 3x! ШОВ") == ["été", "foo", "bar", "3x", "шов"]


@pytest.mark.parametrize("most", [4_000_000, 10])
def test_leaks_against_brute_force_and_removal(spark, monkeypatch, most):
    monkeypatch.setattr(leaks, "MAX_TEST_WORDS", most)
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(12)] + ["café"]
    tests = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(2, 12)))) for i in range(20)] + [(50, None), (51, ""), (52, "w1 w2")]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(0, 30)))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "PRE " + unicodedata.normalize("NFD", tests[0][1]).upper().replace(" ", " - ") + " post"), (103, docs[0][1]), (None, tests[0][1])]
    t = spark.createDataFrame(tests, "test_id long, text string")
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, test_id int")
    n = 3
    grams = lambda x: {tuple(w[i : i + n]) for w in [words(x or "")] for i in range(len(w) - n + 1)}
    want = {(a, b) for a, x in tests for b, y in docs if b is not None and grams(x) & grams(y)}
    args = dict(doc_id="doc_id", text="text", test_id="test_id", test_text="text", n=n)
    hits = leaked_passages(d, t, **args).collect()
    assert {(r.test_id, r.doc_id) for r in hits} == want and all(r.n_words >= n for r in hits)
    rows = sorted((r.test_id, r.doc_id, r.first_word, r.n_words) for r in hits)
    spans = []
    for a, x in tests:
        for b, y in docs:
            w, own = words(y or ""), {tuple(g) for g in grams(x)}
            at = [i for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in own] if b is not None else []
            for i in at:
                if spans and spans[-1][:2] == [a, b] and i <= spans[-1][3] + n:
                    spans[-1][3] = i
                else:
                    spans.append([a, b, i, i])
    assert rows == sorted((a, b, i, j - i + n) for a, b, i, j in spans)
    short = {(r.test_id, r.n_words) for r in short_tests(t, test_id="test_id", test_text="text", n=n).collect()}
    assert short == {(a, len(words(x or ""))) for a, x in tests if len(words(x or "")) < n}
    clean = without_leaks(d, t, **args, remove="spans").collect()
    bad = {b for _, b in want}
    assert len(clean) == len(docs) and {r.doc_id: r.text for r in clean if r.doc_id not in bad and r.doc_id} == {b: y for b, y in docs if b not in bad and b}
    assert next(r.text for r in clean if r.doc_id == 102).startswith("PRE ")
    assert {r.doc_id for r in without_leaks(d, t, **args, remove="documents").collect()} - {None} == {b for b, _ in docs if b is not None} - bad
    assert leaked_passages(d.limit(0), t, **args).count() == 0 and leaked_passages(d, t.limit(0), **args).count() == 0


def test_shared_stretches_against_brute_force(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abж\U0001f600") for _ in range(n))
    common = [text(40) for _ in range(3)]
    docs = [(i, text(rng.randrange(0, 30)) + rng.choice(common)[rng.randrange(0, 12) :] + text(rng.randrange(0, 30))) for i in range(25)]
    docs += [(100, None), (101, ""), (102, docs[0][1]), (102, docs[0][1]), (103, "z" * 200), (None, docs[0][1])]
    df = spark.createDataFrame([(*r, 0, 0) for r in docs], "doc_id long, text string, h int, pos int")
    length = 24
    holders = defaultdict(set)
    for i, x in docs:
        for k in range(len(x or "") - length + 1):
            if i is not None:
                holders[x[k : k + length]].add(i)
    want = {p for v in holders.values() for p in combinations(sorted(v), 2)}
    got = [(r.doc_a, r.doc_b) for r in shared_pairs(df, "doc_id", "text", length, bits=12).collect()]
    assert sorted(got) == sorted(want) and want
    cover = {}
    for i, x in docs:
        if x and i is not None:
            c = set()
            for k in range(len(x) - length + 1):
                if len(holders[x[k : k + length]]) > 1:
                    c |= set(range(k, k + length))
            cover[i] = (len(c), len(x))
    assert {r.doc_id: (r.shared_chars, r.chars) for r in shared_shares(df, "doc_id", "text", length, bits=12).collect()} == cover
    assert shared_stretches(df.limit(0), "doc_id", "text", length, bits=12).count() == 0
    assert shared_pairs(df.limit(0), "doc_id", "text", length, bits=12).count() == 0


def test_a_full_sketch_loses_nothing(spark):
    df = spark.createDataFrame([(i, f"{i:03d}" * 30 + "common stretch of text") for i in range(20)], "id int, text string")
    assert shared_pairs(df, "id", "text", 20, bits=3).count() == 190


def test_permutations():
    for n in (1, 2, 3, 7, 100, 1000):
        x = np.arange(n)
        assert sorted(_permuted(x, np.full(n, n), np.full(n, 5, np.uint64))) == list(range(n))


def test_plan_keeps_shares_and_caps():
    plan = plan_blocks({"a": 100, "b": 10, "c": 0}, {"a": 0.6, "b": 0.35, "c": 0.05}, {"a": 2, "b": 3, "c": 4}, 1000)
    assert plan["c"] == 0 and plan["b"] == 30 and abs(plan["a"] / plan["b"] - 0.6 / 0.35) < 0.1
    assert plan_blocks({}, {"a": 1.0}, {"a": 1}, 10) == {"a": 0}


def test_absent_sources_do_not_empty_the_mix():
    have = {"a": 1_000_000, "b": 1_000_000, "unused": 1_000_000}
    plan = plan_blocks(have, {"a": 0.5, "b": 0.4, "none": 0.1}, {"a": 1, "b": 1, "none": 4}, 900)
    assert plan == {"a": 500, "b": 400, "none": 0}
    # two absent ones, one of them for want of repeats; a scarce source beside them still has its own tenth
    shares = {"a": 0.8, "none": 0.06, "unused": 0.06, "few": 0.08}
    plan = plan_blocks(have | {"few": 3}, shares, {"a": 1, "none": 1, "unused": 0, "few": 1}, 1000)
    assert plan == {"a": 997, "none": 0, "unused": 0, "few": 3}


def test_mix(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["one", "two", "three", "два"]) for _ in range(rng.randrange(0, 60))), rng.choice(["A", " a", "b", "B ", "c", None]), 1) for i in range(200)]
    docs += [(300, None, "a", 1), (None, "x", "a", 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string, tokens int")
    t = spark.createDataFrame([("a", 0.5, 1), ("B", 0.45, 3), ("none", 0.05, 2), (None, 0.1, 1)], "source string, share double, repeats int")
    mix, shares = mixed(d, t, doc_id="doc_id", text="text", source="source", share="share", repeats="repeats", tokenizer_path=TOKENIZER, block=16, shard_blocks=8)
    rows = mix.collect()
    uses = Counter((r.source, r.block) for r in rows)
    assert max(n for (s, _), n in uses.items() if s == "a") == 1 and max(n for (s, _), n in uses.items() if s == "b") <= 3
    assert all(len(r.tokens) == r.n_tokens <= 16 for r in rows) and len({(r.shard, r.slot) for r in rows}) == len(rows)
    got = {r.source: r for r in shares.collect()}
    assert got["none"].mix_tokens == 0 and abs(sum(r.actual_share for r in got.values()) - 1) < 1e-9
    assert abs(got["a"].actual_share / got["b"].actual_share - 0.5 / 0.45) < 0.15
    mix, shares = mixed(d.limit(0), t, doc_id="doc_id", text="text", source="source", share="share", repeats="repeats", tokenizer_path=TOKENIZER)
    assert mix.count() == 0 and {r.mix_tokens for r in shares.collect()} == {0}


def test_blocks_hold_each_token_of_a_source_once(spark):
    import base64

    import tiktoken

    from millrace.llm.mix import PIECES

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZER, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
    docs = [(i, f"text number {i} " * (i % 7), "a") for i in range(50)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, share double, repeats int")
    mix, _ = mixed(d, t, doc_id="doc_id", text="text", source="source", share="share", repeats="repeats", tokenizer_path=TOKENIZER, block=10)
    got = Counter(x for r in mix.collect() for x in r.tokens)
    assert got == Counter(x for _, text, _ in docs for x in enc.encode_ordinary(text))


def test_hot_keys_and_classes_apart_give_the_same(spark, monkeypatch):
    from millrace.llm import shared, splits

    rng = random.Random(12)
    links = [(f"r{i}", f"k{min(rng.randrange(40), rng.randrange(40))}") for i in range(200) for _ in range(2)] + [(f"r{i}", "hub") for i in range(60)]
    df = spark.createDataFrame(links, "r string, k string")
    docs = spark.createDataFrame([(i, f"{i:04d}" * 3 + ("a long licence text " * 3 if i % 2 else f"{i % 5} other words here ") + f"{i:04d}") for i in range(60)], "id long, text string")
    plain = {r.r: r.root for r in tied_records(df, "r", "k").collect()}
    pairs = sorted((r.doc_a, r.doc_b) for r in shared_pairs(docs, "id", "text", 16, bits=12).collect())
    stretches = sorted(shared_stretches(docs, "id", "text", 16, bits=12).collect())
    for module in (splits, shared):
        monkeypatch.setattr(module, "HOT_ROWS", 8)
    assert {r.r: r.root for r in tied_records(df, "r", "k").collect()} == plain
    assert sorted((r.doc_a, r.doc_b) for r in shared_pairs(docs, "id", "text", 16, bits=12).collect()) == pairs and pairs
    assert sorted(shared_stretches(docs, "id", "text", 16, bits=12).collect()) == stretches


def test_stretches_are_verbatim_and_cover_all(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("ab") for _ in range(n))
    docs = {i: text(rng.randrange(20, 60)) for i in range(12)}
    docs[20] = docs[3][:30] + docs[4][-25:]
    rows = shared_stretches(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), "doc_id", "text", 10, bits=10).collect()
    assert rows
    for r in rows:
        own = docs[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length >= 10 and r.doc_id != r.other_id and docs[r.other_id][r.other_start : r.other_start + r.length] == own


def test_long_texts_in_pieces(spark, monkeypatch):
    from millrace.llm.shared import _pieces, fingerprints

    rng = random.Random(10)
    texts = ["", "short", "".join(rng.choice("abc\U0001f600") for _ in range(137)), "".join(rng.choice("abc") for _ in range(50))]
    monkeypatch.setattr("millrace.llm.shared.STEP", 20)
    got = defaultdict(dict)
    for owner, _, pos, whole, least in _pieces(texts, 12):
        for k, p, h, m in zip(owner, pos, whole, least):
            assert p not in got[k]
            got[k][p] = (h, m)
    for k, t in enumerate(texts):
        whole, least = fingerprints(t, 12)
        assert got[k] == {p: (h, m) for p, (h, m) in enumerate(zip(whole, least))}


def test_forest_is_read_back_and_grows(spark):
    from millrace.llm.splits import read_forest
    from millrace.session import named_folder

    path = named_folder(spark, "test-forest")
    labels, forest = spanning_forest(spark.createDataFrame([("b", "c"), ("c", "d"), ("x", "y"), ("b", "d")], "a string, b string"), "a", "b", path)
    again, links = read_forest(spark, path)
    assert {(r.vertex, r.root) for r in again.collect()} == {("b", "b"), ("c", "b"), ("d", "b"), ("x", "x"), ("y", "x")} and links.count() == 3
    more, _ = spanning_forest(links.unionByName(spark.createDataFrame([("d", "a"), ("y", "z")], "u string, v string")), "u", "v")
    assert {(r.vertex, r.root) for r in more.collect()} == {("a", "a"), ("b", "a"), ("c", "a"), ("d", "a"), ("x", "x"), ("y", "x"), ("z", "x")}


def test_pairs_of_low_significance_are_left_out(spark):
    rows = [(s, i) for s in range(40) for i in ("a", "b")[: 1 + s % 2]] + [(s, "c") for s in range(40, 44)] + [(43, "a")]
    df = spark.createDataFrame(rows, "basket int, item string")
    llr = {(r.item_a, r.item_b): r.llr for r in items_together(df, "basket", "item").collect()}
    limit = sum(llr.values()) / len(llr)
    kept = {(r.item_a, r.item_b) for r in items_together(df, "basket", "item", min_llr=limit).collect()}
    assert kept == {p for p, x in llr.items() if x >= limit} and kept and kept != set(llr)


def test_plan_of_tokens_not_blocks(spark):
    # a source whose last block is nearly empty keeps its share all the same
    docs = [(i, "one two three four", "a") for i in range(400)] + [(1000 + i, "one two", "b") for i in range(9)]
    d = spark.createDataFrame(docs, "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 0.9, 1), ("b", 0.1, 20)], "source string, share double, repeats int")
    _, shares = mixed(d, t, doc_id="doc_id", text="text", source="source", share="share", repeats="repeats", tokenizer_path=TOKENIZER, block=16)
    got = {r.source: r.actual_share for r in shares.collect()}
    assert abs(got["b"] - 0.1) < 0.012 and abs(sum(got.values()) - 1) < 1e-9
