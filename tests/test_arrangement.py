"""Unions and repairs at any angle, against areas that are known and JTS; reading by batch against the kernels."""

import resource

import numpy as np
import pytest

from plinth.functions import kernels as K
from plinth.functions import ragged
from plinth.functions.arrangement import near_pairs

PLACES = [np.zeros(2), np.array([500_000.0, 6_600_000.0]), np.array([30.0, 59.8])]


@pytest.fixture(scope="module")
def jts(spark):
    return spark.sparkContext._jvm.org.locationtech.jts.io.WKTReader()


def box(x, y, w, h):
    return np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)], float)


def turned(r, angle, place):
    c, s = np.cos(angle), np.sin(angle)
    return r @ np.array([[c, s], [-s, c]]) + place


def star(rng, x, y):
    n = int(rng.integers(4, 12))
    a, r = np.sort(rng.uniform(0, 2 * np.pi, n)), rng.uniform(1, 5, n)
    ring = np.stack([x + r * np.cos(a), y + r * np.sin(a)], axis=1)
    return [[np.vstack([ring, ring[:1]])]]


def test_turned_terraces_become_one_building(jts):
    rng = np.random.default_rng(0)
    for k in range(1000):
        angle, place, x, houses, want = rng.uniform(0, 6.3), PLACES[k % 2], 0.0, [], 0.0
        for _ in range(int(rng.integers(2, 6))):
            w, h = rng.uniform(3, 12, 2)
            houses.append([[turned(box(x, rng.uniform(0, 2), w, h), angle, place)]])
            x, want = x + w, want + w * h
        got = K.union(houses)
        assert len(got) == 1 and len(got[0]) == 1 and K.is_valid(got)
        assert K.area(got) == pytest.approx(want, rel=1e-6)
        if k % 10 == 0:
            assert jts.read(K.to_wkt(got)).isValid()
            theirs = jts.read(K.to_wkt(houses[0]))
            for g in houses[1:]:
                theirs = theirs.union(jts.read(K.to_wkt(g)))
            assert K.area(got) == pytest.approx(theirs.getArea(), rel=1e-6)


def test_turned_rings_that_run_back_along_themselves(jts):
    rng = np.random.default_rng(1)
    for k in range(1000):
        a, b, c = rng.uniform(2, 9, 3)
        ring = np.array([(0, 0), (a + b, 0), (a + b, c), (a, c), (a, 0), (a / 2, 0), (a / 2, -1), (0, -1), (0, 0)])
        g = [[turned(ring, rng.uniform(0, 6.3), PLACES[k % 2])]]
        got = K.repair(g)
        assert K.is_valid(got) and K.area(got) == pytest.approx(b * c + a / 2, rel=1e-6)
        if k % 10 == 0:
            assert jts.read(K.to_wkt(got)).isValid()


def test_random_unions_equal_jts(jts):
    rng = np.random.default_rng(2)
    for k in range(80):
        stars = [s for s in (star(rng, *rng.uniform(-6, 6, 2)) for _ in range(6)) if K.is_valid(s)]
        if len(stars) < 2:
            continue
        moved = [[[r * (1e-4 if k % 3 == 2 else 1) + PLACES[k % 3] for r in p] for p in g] for g in stars]
        theirs = jts.read(K.to_wkt(moved[0]))
        for g in moved[1:]:
            theirs = theirs.union(jts.read(K.to_wkt(g)))
        got = K.union(moved)
        mine = jts.read(K.to_wkt(got))
        assert mine.isValid() and len(got) == theirs.getNumGeometries()
        assert mine.symDifference(theirs).getArea() <= 1e-6 * theirs.getArea()


def test_blocks_with_yards_islands_and_pinches():
    cells = [(i, j) for i in range(12) for j in range(12) if (i, j) not in {(3, 3), (4, 4), (7, 7), (7, 8)}]
    for angle in (0.0, 0.3, 1.1):
        got = K.union([[[turned(box(i, j, 1, 1), angle, PLACES[1])]] for i, j in cells])
        assert len(got) == 1 and K.is_valid(got) and K.area(got) == pytest.approx(140, rel=1e-6)
        assert len(got[0]) == 4  # two yards that meet in a point, and one of two cells
    outer, yard, island = box(0, 0, 10, 10), box(2, 2, 6, 6), box(4, 4, 2, 2)
    got = K.union([[[outer, yard]], [[island]]])
    assert sorted(len(p) for p in got) == [1, 2] and K.area(got) == 64 + 4
    corner = K.union([[[box(0, 0, 1, 1)]], [[box(1, 1, 1, 1)]]])
    assert len(corner) == 2 and K.is_valid(corner)
    assert K.repair([[np.array([(0.0, 0), (1, 1), (2, 2), (0, 0)])]]) is None
    assert K.repair([[np.array([(0.0, 0), (np.inf, 1), (2, 2), (0, 0)])]]) is None


def test_predicates_equal_jts_where_walls_meet(jts):
    rng = np.random.default_rng(3)
    for k in range(200):
        angle, place = rng.uniform(0, 6.3), PLACES[k % 2]
        a, b = [[turned(box(0, 0, 5, 7), angle, place)]], [[turned(box(5, 2, 4, 9), angle, place)]]
        ja, jb = jts.read(K.to_wkt(a)), jts.read(K.to_wkt(b))
        assert K.intersects(a, b) == ja.intersects(jb)
        assert K.distance(a, b) == pytest.approx(ja.distance(jb), abs=1e-9)


def test_long_rings_need_little_memory():
    rng = np.random.default_rng(4)
    n = 50_000
    a, r = np.arange(n) * 2 * np.pi / n, 100 + rng.uniform(0, 0.005, n)
    ring = np.stack([r * np.cos(a), r * np.sin(a)], axis=1)
    g = [[np.vstack([ring, ring[:1]])]]
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert K.is_valid(g) and K.intersects(g, [[g[0][0] + 150.0]]) is False and K.intersects(g, [[g[0][0] + np.array([150.0, 0])]])
    assert 49.9 < K.distance(g, [[g[0][0] + np.array([250.0, 0])]]) < 50
    g[0][0][[10, 30_000]] = g[0][0][[30_000, 10]]
    assert not K.is_valid(g)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200 * 1024


def test_gap_equals_all_pairs():
    rng = np.random.default_rng(5)
    for _ in range(30):
        n, m = rng.integers(3, 300, 2)
        a, b = rng.uniform(0, 10, (n, 2)), rng.uniform(0, 10, (m, 2)) + np.array([11.0, 3.0])
        ea, eb = np.hstack([a, np.roll(a, -1, axis=0)]), np.hstack([b, np.roll(b, -1, axis=0)])
        want = min(K._to_segments(ea[:, :2], eb), K._to_segments(eb[:, :2], ea))
        assert K._gap(ea, eb) == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("n", [0, 1, 5, 200])
def test_near_pairs_are_all_pairs_of_meeting_boxes(n, monkeypatch):
    from plinth.functions import arrangement

    monkeypatch.setattr(arrangement, "PAIRS", 37)
    rng = np.random.default_rng(n)
    e, f = rng.uniform(0, 10, (n, 4)).round(), rng.uniform(0, 10, (n // 2, 4)).round()

    def meet(x, y):
        return all(min(x[d], x[d + 2]) <= max(y[d], y[d + 2]) and min(y[d], y[d + 2]) <= max(x[d], x[d + 2]) for d in (0, 1))

    own = [tuple(sorted(p)) for i, j in near_pairs(e) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert sorted(own) == [(i, j) for i in range(n) for j in range(i + 1, n) if meet(e[i], e[j])]
    two = [p for i, j in near_pairs(e, f) for p in zip(i.tolist(), j.tolist(), strict=True)]
    assert sorted(two) == [(i, j) for i in range(n) for j in range(len(f)) if meet(e[i], f[j])]


def test_batches_equal_rows():
    rng = np.random.default_rng(6)
    texts = [None, "", "POINT (1 2)", "POLYGON EMPTY", "POLYGON ((0 0, 1 1", "POLYGON ((0 0,10 10,10 0,0 10,0 0))", "polygon((0 0 1,1 0 1,1 1 1,0 0 1))", "POLYGON ((0 0,1 0,1 0,1 1,0 0))", "POLYGON ((0 0,1 0,1 1))"]
    texts += ["POLYGON ((1e999 0,1 0,1 1,1e999 0))", "POLYGON ((0 0,1 1,2 2,0 0))", "POLYGON ((0 0,10 0,10 10,0 10,0 0),(0 5,4 4,4 6,0 5))", "MULTIPOLYGON (((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))"]
    for k in range(1500):
        n = int(rng.integers(3, 90 if k % 50 == 0 else 12))
        a = np.sort(rng.uniform(0, 2 * np.pi, n)) if k % 4 else rng.uniform(0, 6, n)
        p = np.stack([np.cos(a), np.sin(a)], axis=1) * rng.uniform(1, 5, n)[:, None] * 1e-4 + PLACES[2]
        p = np.round(p * 1e4) if k % 7 == 0 else p
        texts.append("POLYGON ((" + ", ".join(f"{x!r} {y!r}" for x, y in np.vstack([p, p[:1]]).tolist()) + "))")
    for degrees in (True, False):
        for t, x, y in zip(texts, ragged._batch(texts, degrees), (ragged._one(t, degrees) for t in texts), strict=True):
            assert x[:5] == y[:5] and (x[5] == y[5] or x[5] == pytest.approx(y[5], rel=1e-9)), t
    assert ragged._batch([], True) == []


def test_one_pass_over_a_column(spark):
    from plinth.operators import cleaning

    df = spark.createDataFrame([(1, "POLYGON ((0 0,0.001 0,0.001 0.001,0 0.001,0 0))"), (2, None), (3, "POLYGON ((0 0,0.002 0.002,0.002 0,0 0.002,0 0))")], "id long, wkt string")
    got = {r["id"]: r for r in cleaning.parse_geometry(df, "wkt").collect()}
    assert [got[k]["parsed"] for k in (1, 2, 3)] == [True, False, True] and [got[k]["was_valid"] for k in (1, 2, 3)] == [True, False, False]
    assert got[3]["repaired"] and got[3]["area"] == pytest.approx(2 * got[1]["area"], rel=1e-6) and got[2]["wkb"] is None
    plan = df.withColumn("p", ragged.read_polygons(df["wkt"], True)).select("*", "p.*")._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    assert plan.count("EvalPython") == 1


def test_dissolving_step_by_step_equals_one_union(spark):
    from pyspark.sql import functions as F

    from plinth.operators import matching

    rng = np.random.default_rng(9)
    rows, plain = [], {}
    for key, n in (("block", 300), ("loose", 150), ("one", 1), ("copies", 5)):
        side = int(np.ceil(np.sqrt(n)))
        for k in range(n):
            at = (0, 0) if key == "copies" else (k // side * (2.0 if key == "loose" and k % 3 else 1.0), k % side)
            g = [[turned(box(*at, 1, 1) if key != "block" else box(*at, 1, 1 + rng.uniform(0, 0.5)), 0.4, PLACES[1])]]
            r = g[0][0]
            rows.append((key, K.to_wkb(g), *r.min(axis=0).tolist(), *r.max(axis=0).tolist()))
            plain.setdefault(key, []).append(g)
    df = spark.createDataFrame(rows, "component_id string, wkb binary, minx double, miny double, maxx double, maxy double").repartition(4)
    for first, onward in ((256, 16), (16, 3), (2, 2)):
        got = {r["component_id"]: K.from_wkb(r["rep_geometry"]) for r in matching.dissolved(df, first=first, onward=onward).collect()}
        assert set(got) == set(plain)
        for key, g in got.items():
            want = K.union(plain[key]) if key != "copies" else plain[key][0]
            assert K.is_valid(g) and len(g) == len(want) and K.area(g) == pytest.approx(K.area(want), rel=1e-6)
            assert K.intersection_area(g, want) == pytest.approx(K.area(want), rel=1e-6)
    assert matching.dissolved(df.limit(0)).count() == 0
    z = spark.createDataFrame([(float(x), float(y)) for x in range(-2, 3) for y in range(-2, 3)], "x double, y double").withColumn("z", __import__("plinth.functions.geometry", fromlist=["z"]).z_order("x", "y", 1.0))
    assert z.select(F.countDistinct("z")).first()[0] == 25 and [tuple(r)[:2] for r in z.where("x >= 0 AND y >= 0 AND x < 2 AND y < 2").orderBy("z").collect()] == [(0, 0), (1, 0), (0, 1), (1, 1)]
