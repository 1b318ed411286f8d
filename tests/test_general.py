import random
from collections import defaultdict

from millrace.operators.asof import attributes_as_known
from millrace.operators.rolling import trailing_totals
from millrace.operators.sessions import gap_sessions


def test_trailing_totals_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc") if rng.random() < 0.95 else None, rng.choice([0, 1, 2, 5, 6, 9, 40, 41]), rng.choice(["u", "v", "w", None]), 1) for _ in range(120)]
    # extra columns with the operator's own names
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "item string, day int, user string, e int, d int, n int")
    got = {(r.item, r.day): r for r in trailing_totals(df, "item", "day", "user", (7, 30)).collect()}
    by = defaultdict(list)
    for item, day, user, _ in rows:
        if item is not None:
            by[item].append((day, user))
    assert set(got) == {(k, d) for k, v in by.items() for d in range(min(x[0] for x in v), max(x[0] for x in v) + 1)}
    for (item, day), r in got.items():
        for p in (7, 30):
            near = [(d, u) for d, u in by[item] if day - p < d <= day]
            users = {u for _, u in near if u}
            daily = sum(len({u for d, u in near if d == x and u}) for x in {d for d, _ in near})
            assert (r[f"events_{p}"], r[f"users_{p}"]) == (len(near), len(users))
            assert abs(r[f"avg_events_{p}"] - len(near) / p) < 1e-12
            assert abs(r[f"avg_users_{p}"] - daily / p) < 1e-12
    assert trailing_totals(df.limit(0), "item", "day", "user").count() == 0


def test_gap_sessions_bounds_and_nulls(spark):
    gap = 1_800_000_000
    rows = [("a", 0), ("a", gap), ("a", 2 * gap + 1), ("b", -5), ("b", -5), (None, 3), ("c", None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "u string, us long, a int")
    got = sorted((r.u, r.start_us, r.end_us, r.events) for r in gap_sessions(df, "u", "us", gap).collect())
    assert got == [("a", 0, gap, 2), ("a", 2 * gap + 1, 2 * gap + 1, 1), ("b", -5, -5, 2)]
    assert gap_sessions(df.limit(0), "u", "us").count() == 0


def test_gap_sessions_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(rng.choice("xy"), rng.randrange(0, 4000)) for _ in range(300)]
    got = sorted((r.u, r.start_us, r.end_us, r.events) for r in gap_sessions(spark.createDataFrame(rows, "u string, us long"), "u", "us", 12).collect())
    want = []
    for u in "xy":
        run = []
        for t in sorted(t for x, t in rows if x == u):
            if run and t - run[-1] > 12:
                want.append((u, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        want.append((u, run[0], run[-1], len(run)))
    assert got == sorted(want)


def _best(versions, item, t):
    known = [(v, k, i) for x, v, k, i in versions if x == item and item and v is not None and k is not None and v <= t and k <= t]
    return max(known)[2] if known else None


def test_attributes_as_known_with_hot_entity_in_slices(spark):
    rng = random.Random(7)
    day = lambda: rng.randrange(0, 60)
    versions = [(rng.choice(["h", "c", "none"]), day(), day() if rng.random() < 0.9 else None, i) for i in range(80)] + [(None, 1, 1, 900)]
    versions += versions[:5]
    events = [(i, rng.choice(["h", "h", "h", "c", "lost"]), rng.randrange(-5, 120)) for i in range(300)] + [(1000, None, 5), (1001, "h", None)]
    ev = spark.createDataFrame(events, "id int, item string, t long")
    vs = spark.createDataFrame(versions, "item string, vf long, ka long, id int")
    args = dict(entity="item", moment="t", keep=["id", "t"], valid_from="vf", known_at="ka", version_id="version", attributes=["price"])
    vs = vs.withColumnRenamed("id", "version").withColumn("price", vs["ka"] * 2)
    for hot_rows, width in ((10**9, 10), (50, 10), (1, 7)):
        got = {r.id: r for r in attributes_as_known(ev, vs, slice_us=width, hot_rows=hot_rows, **args).collect()}
        assert len(got) == len(events)
        for i, item, t in events:
            assert got[i].version == (None if t is None else _best(versions, item, t)), (i, item, t, hot_rows)
    assert attributes_as_known(ev.limit(0), vs, **args).count() == 0
    assert all(r.version is None for r in attributes_as_known(ev, vs.limit(0), **args).collect())
