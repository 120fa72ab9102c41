"""History, nearest places, as-of and interval joins against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from startline.operators import history, places, runs

CHANGE = "entity long, field string, version long, contributor string, at long, old string, new string"


def changes(rnd, entities):
    rows = []
    for e in range(entities):
        now, version = {}, 0
        for _ in range(rnd.randrange(1, 9)):
            version += 1
            f, new = rnd.choice("xy"), rnd.choice(["a", "b", "c", None])
            old = now.get(f, "first") if rnd.random() < 0.7 else rnd.choice("abc")
            rows.append((e, f, version, rnd.choice(["ann", "bad", None]), version * 10, old, new))
            now[f] = new
    return rows


def test_reverts_against_a_loop(spark):
    rows = changes(random.Random(1), 120)
    want = {}
    for key in {r[:2] for r in rows}:
        own = sorted((r for r in rows if r[:2] == key), key=lambda r: r[2])
        theirs = [r for r in own if r[3] == "bad"]
        if not theirs:
            continue
        others = [r for r in own if r[3] != "bad"]
        later = [r for r in others if r[2] > theirs[-1][2]]
        if not later:
            want[key] = (others[-1][6] if others else own[0][5], "restored", own[-1][2])
        else:
            want[key] = (own[-1][6], "conflict" if later[0][5] == theirs[-1][6] else "kept", own[-1][2])
    df = spark.createDataFrame(rows, CHANGE).repartition(3)
    found = history.reverted(df, F.lit("bad"))
    assert {(r["entity"], r["field"]): (r["value"], r["action"], r["version"]) for r in found.collect()} == want
    now = history.as_of(df, F.lit(10_000))
    more = history.taking_back(found, now, F.lit("moderator"), F.lit(20_000).cast("long"))
    after = {(r["entity"], r["field"]): r["value"] for r in history.as_of(df.unionByName(more), F.lit(30_000)).collect()}
    assert all(after[k] == v for k, (v, action, _) in want.items() if action == "restored")
    assert history.reverted(df.where("contributor = 'ann'"), F.lit("bad")).isEmpty()


def test_intervals_and_moments(spark):
    df = spark.createDataFrame([(1, "x", 1, "a", 10, None, "p"), (1, "x", 3, "a", 30, "p", "q"), (1, "y", 2, "b", 20, None, None)], CHANGE)
    got = sorted((r["field"], r["version"], r["valid_from"], r["valid_to"]) for r in history.intervals(df).collect())
    assert got == [("x", 1, 10, 30), ("x", 3, 30, None), ("y", 2, 20, None)]
    assert sorted(map(tuple, history.as_of(df, F.lit(29)).collect())) == [(1, "x", "p"), (1, "y", None)]


def test_edits_of_a_version(spark):
    stored = spark.createDataFrame([(1, 4), (2, 7), (3, None)], "entity long, version long")
    writes = spark.createDataFrame([(1, 4, 5, 11), (1, 4, 5, 10), (1, 3, 1, 12), (2, 8, 1, 13), (9, 1, 1, 14), (2, 7, 9, 15), (3, None, 1, 16)], "entity long, base long, at long, id long")
    got = {r["id"]: r["outcome"] for r in history.accepted(writes, stored).collect()}
    assert got == {10: "stored", 11: "changed since", 12: "changed since", 13: "changed since", 14: "unknown", 15: "stored", 16: "unknown"}


def kilometres(a, b):
    (p, q), (r, s) = (tuple(map(math.radians, x)) for x in (a, b))
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return round(2 * 6371.0 * math.asin(min(1.0, math.sqrt(h))), 6)


@pytest.mark.parametrize(("n", "k"), [(200, 4), (2, 5), (0, 3)])
def test_nearest_against_all_pairs(spark, n, k):
    """Crowded, lonely, polar and date-line places, equal ones, and fewer than are asked for."""
    rnd = random.Random(n)
    venues = [(v, rnd.choice([51.5 + rnd.random(), rnd.uniform(-90, 90), 90.0]), rnd.choice([rnd.random(), rnd.uniform(-180, 180), 179.999])) for v in range(n)]
    venues += [(1000 + v, *venues[0][1:]) for v in range(3 * (n > 0))] + [(2000, None, 1.0)]
    points = [(p, rnd.choice([51.5 + rnd.random(), rnd.uniform(-90, 90), -89.9]), rnd.choice([rnd.random(), rnd.uniform(-180, 180), -180.0])) for p in range(40)] + [(99, None, None)]
    want = {(p, r + 1): place for p, *at in points if at[0] is not None for r, (_, place) in enumerate(sorted((kilometres(at, x), v) for v, *x in venues if x[0] is not None)[:k])}
    found = places.nearest(spark.createDataFrame(points, "id int, lat double, lon double"), spark.createDataFrame(venues, "place int, lat double, lon double"), k)
    assert {(r["id"], r["rank"]): r["place"] for r in found.collect()} == want


def test_nearest_of_many_at_the_same_coordinates(spark, monkeypatch):
    """Work goes by coordinates: of 900 places at three of them, k of each are looked at, and 300 points ask twice."""
    settle, sizes = places.store.settle, []

    def counted(rows):
        sizes.append(rows.count())
        return settle(rows)

    monkeypatch.setattr(places.store, "settle", counted)
    at = [(0.0, 0.0), (0.0, 90.0), (45.0, 10.0)]
    venues = spark.createDataFrame([(v, *at[v % 3]) for v in range(900)], "place int, lat double, lon double")
    points = spark.createDataFrame([(p, 1.0 + p % 2, 2.0) for p in range(300)], "id int, lat double, lon double")
    found = {(r["id"], r["rank"]): r["place"] for r in places.nearest(points, venues, 4).collect()}
    assert found == {(p, r + 1): 3 * r for p in range(300) for r in range(4)}
    assert max(sizes) <= 12


def test_as_of_and_intervals_against_loops(spark):
    rnd = random.Random(6)
    key = lambda: rnd.choice(["hot", "hot", "hot", "b", None])
    facts = [(key(), rnd.randrange(60), n) for n in range(150)]
    points = [(key(), rnd.randrange(70), n) for n in range(150)]
    left, right = (spark.createDataFrame(x, f"k string, t int, {c} int").repartition(5) for x, c in ((points, "p"), (facts, "f")))
    got = {r["p"]: r["found"] and r["found"]["f"] for r in runs.as_of_join(left, right, "k", "t", tie="f").collect()}
    assert got == {p: max(((u, f) for j, u, f in facts if j == k and u <= t), default=(0, None))[1] for k, t, p in points}

    spans = [(n, rnd.randrange(80), rnd.randrange(-3, 40)) for n in range(60)]
    spans = [(n, a, a + w) for n, a, w in spans]
    df = spark.createDataFrame(spans, "n int, a int, z int")
    got = sorted((r["p"], r["n"]) for r in runs.within(left.select("p", "t"), df, "t", "a", "z", 7.0).collect())
    assert got == sorted((p, n) for _, t, p in points for n, a, z in spans if a <= t < z)
    got = sorted((r["n"], r["other"]["n"]) for r in runs.overlapping(df, df, "a", "z", 7.0).collect())
    assert got == sorted((n, m) for n, a, z in spans for m, b, y in spans if a < z and b < y and a < y and b < z)


def test_values_carried_over_ranges(spark):
    rows = [("a", n, None if n % 7 else n, n // 3) for n in range(100)] + [("b", n, None, 0) for n in range(5)] + [(None, n, n, n) for n in range(5)]
    df = spark.createDataFrame(rows, "k string, t int, v int, w int").repartition(4)
    got = {(r["k"], r["t"]): r["v_known"] for r in runs.carried_forward(df, "k", "t", "v").collect()}
    assert got == {(k, t): {"a": t // 7 * 7, "b": None, None: t}[k] for k, t, *_ in rows}
    got = {(r["k"], r["t"]): r["changed"] for r in runs.changed(df, "k", "t", "w").collect()}
    assert got == {(k, t): t == 0 or (k == "a" and t % 3 == 0) or k is None for k, t, *_ in rows}
