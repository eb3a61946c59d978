"""Polygon kernels against JTS, which Spark ships."""

import numpy as np
import pytest

from plinth.functions import kernels as K


@pytest.fixture(scope="module")
def jts(spark):
    jvm = spark.sparkContext._jvm
    return jvm.org.locationtech.jts.io.WKTReader()


def star(rng, x=0.0, y=0.0):
    n = int(rng.integers(4, 14))
    angle = np.sort(rng.uniform(0, 2 * np.pi, n))
    r = rng.uniform(1, 10, n)
    ring = np.stack([x + r * np.cos(angle), y + r * np.sin(angle)], axis=1)
    return [[np.vstack([ring, ring[:1]])]]


def test_random_stars(jts):
    rng = np.random.default_rng(11)
    checked = 0
    for _ in range(120):
        a, b = star(rng), star(rng, *rng.uniform(-12, 12, 2))
        ja, jb = jts.read(K.to_wkt(a)), jts.read(K.to_wkt(b))
        assert K.is_valid(a) == ja.isValid()
        if not (ja.isValid() and jb.isValid()):
            continue
        checked += 1
        assert K.area(a) == pytest.approx(ja.getArea(), abs=1e-9)
        assert K.intersection_area(a, b) == pytest.approx(ja.intersection(jb).getArea(), abs=1e-9)
        assert K.union_area([a, b]) == pytest.approx(ja.union(jb).getArea(), abs=1e-9)
        assert K.intersects(a, b) == ja.intersects(jb)
        assert K.distance(a, b) == pytest.approx(ja.distance(jb), abs=1e-9)
        iou = K.intersection_area(a, b) / K.union_area([a, b])
        assert 0 <= iou <= 1 and K.intersection_area(a, b) == pytest.approx(K.intersection_area(b, a), abs=1e-9)
    assert checked > 60


def test_union_of_many(jts):
    rng = np.random.default_rng(3)
    stars = [s for s in (star(rng, *rng.uniform(-8, 8, 2)) for _ in range(12)) if K.is_valid(s)]
    union = jts.read(K.to_wkt(stars[0]))
    for s in stars[1:]:
        union = union.union(jts.read(K.to_wkt(s)))
    assert K.union_area(stars) == pytest.approx(union.getArea(), abs=1e-8)


CASES = {
    "hole": ("POLYGON ((0 0,10 0,10 10,0 10,0 0),(2 2,4 2,4 4,2 4,2 2))", True, 0),
    "touching hole": ("POLYGON ((0 0,10 0,10 10,0 10,0 0),(0 5,4 4,4 6,0 5))", True, 1),
    "crossing hole": ("POLYGON ((0 0,10 0,10 10,0 10,0 0),(8 2,12 2,12 4,8 4,8 2))", False, 1),
    "bow-tie": ("POLYGON ((0 0,10 10,10 0,0 10,0 0))", False, 0),
    "two": ("MULTIPOLYGON (((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))", True, 0),
    "overlapping": ("MULTIPOLYGON (((0 0,4 0,4 4,0 4,0 0)),((2 2,6 2,6 6,2 6,2 2)))", False, 0),
}


@pytest.mark.parametrize("name", CASES)
def test_hand_cases(jts, name):
    text, valid, holes = CASES[name]
    g = K.parse_wkt(text)
    assert K.is_valid(g) == valid == jts.read(text).isValid()
    assert K.bad_holes(g) == holes
    assert K.to_wkb(K.from_wkb(K.to_wkb(g))) == K.to_wkb(g)
    fixed = K.repair(g)
    assert K.is_valid(fixed) and jts.read(K.to_wkt(fixed)).isValid()


def test_measures_of_hand_cases():
    a = K.parse_wkt(CASES["hole"][0])
    b = K.parse_wkt("POLYGON ((5 5,15 5,15 15,5 15,5 5))")
    assert (K.area(a), K.intersection_area(a, b), K.union_area([a, b])) == (96, 25, 171)
    assert K.area(K.repair(K.parse_wkt(CASES["bow-tie"][0]))) == 50
    edge, corner = K.parse_wkt("POLYGON ((10 0,20 0,20 10,10 10,10 0))"), K.parse_wkt("POLYGON ((10 10,20 10,20 20,10 20,10 10))")
    for other in (edge, corner):
        assert K.intersects(a, other) and K.intersection_area(a, other) == 0 and K.distance(a, other) == 0
    inside = K.parse_wkt("POLYGON ((5 5,6 5,6 6,5 6,5 5))")
    assert K.intersects(a, inside) and K.intersection_area(a, inside) == 1
    in_hole = K.parse_wkt("POLYGON ((2.5 2.5,3 2.5,3 3,2.5 2.5))")
    assert not K.intersects(a, in_hole) and K.distance(a, in_hole) == 0.5


@pytest.mark.parametrize("text", [None, "", "POINT (1 2)", "POLYGON ((0 0, 1 1", "POLYGON ((0 0,1 0,1 1))", "POLYGON 0 0", "POLYGON ((a b,1 0,1 1,a b))", "MULTIPOLYGON ((0 0,1 0,1 1,0 0))"])
def test_bad_text_is_null(text):
    assert K.parse_wkt(text) is None


def test_empty_and_damaged():
    assert K.parse_wkt("POLYGON EMPTY") == [] and K.to_wkt([]) == "POLYGON EMPTY" and K.from_wkb(K.to_wkb([])) == []
    good = K.to_wkb(K.parse_wkt("POLYGON ((0 0,1 0,1 1,0 0))"))
    assert K.from_wkb(good[:-3]) is None and K.from_wkb(b"") is None and K.from_wkb(b"\x01") is None and K.from_wkb(None) is None
    assert K.from_wkb(memoryview(good)) is not None and K.from_wkb(bytearray(good)) is not None
    assert not K.is_valid(None) and np.isnan(K.distance([], K.from_wkb(good))) and K.union_area([[], []]) == 0


def test_expressions_equal_kernels(spark, jts):
    from pyspark.sql import functions as F

    from plinth.functions import geometry as geo

    rng = np.random.default_rng(9)
    texts = [K.to_wkt(star(rng, 668000, 6632000)) for _ in range(20)] + [c[0] for c in CASES.values()] + ["POLYGON EMPTY", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, wkt string").withColumn("g", K.wkb_to_geometry(K.wkt_to_wkb(F.col("wkt"))))
    for r in df.select("wkt", geo.area("g").alias("a"), geo.perimeter("g").alias("p"), geo.centroid("g").alias("c"), geo.bounds("g").alias("b")).collect():
        if r["wkt"] is None:
            assert r["a"] is None
            continue
        j = jts.read(r["wkt"])
        if not j.isValid():
            continue
        assert r["a"] == pytest.approx(j.getArea(), rel=1e-9, abs=1e-9) and r["p"] == pytest.approx(j.getLength(), rel=1e-9)
        if j.isEmpty():
            assert r["c"] is None and r["b"]["minx"] is None
            continue
        c, e = j.getCentroid(), j.getEnvelopeInternal()
        assert (r["c"]["x"], r["c"]["y"]) == pytest.approx((c.getX(), c.getY()), rel=1e-9)
        assert (r["b"]["minx"], r["b"]["maxy"]) == pytest.approx((e.getMinX(), e.getMaxY()))


def test_utm_control_points(spark):
    """Central meridian and equator by definition; a published pair for zone 35."""
    from pyspark.sql import functions as F

    from plinth.functions import geometry as geo

    x, y = geo.degrees_to_utm(F.col("lon"), F.col("lat"))
    got = spark.createDataFrame([(27.0, 0.0), (27.0, 60.0), (30.31, 59.93)], "lon double, lat double").select(x.alias("x"), y.alias("y")).collect()
    assert (got[0]["x"], got[0]["y"]) == pytest.approx((500000, 0), abs=1e-6)
    assert got[1]["x"] == pytest.approx(500000, abs=1e-6)
    # The meridian's arc to 60 degrees on WGS 84 is 6654072.819 m.
    assert got[1]["y"] == pytest.approx(0.9996 * 6654072.819, abs=0.01)
    assert 650000 < got[2]["x"] < 700000


def test_union_geometry(jts):
    rng = np.random.default_rng(21)
    for n in (2, 2, 3, 5, 8):
        for _ in range(6):
            stars = [s for s in (star(rng, *rng.uniform(-9, 9, 2)) for _ in range(n)) if K.is_valid(s)]
            if len(stars) < 2:
                continue
            want = jts.read(K.to_wkt(stars[0]))
            for s in stars[1:]:
                want = want.union(jts.read(K.to_wkt(s)))
            got = K.union(stars)
            j = jts.read(K.to_wkt(got))
            assert K.area(got) == pytest.approx(want.getArea(), abs=1e-6)
            assert j.isValid() and j.symDifference(want).getArea() < 1e-6
    square, ring = K.parse_wkt("POLYGON ((0 0,10 0,10 10,0 10,0 0))"), K.parse_wkt(CASES["hole"][0])
    beside, inner = K.parse_wkt("POLYGON ((10 0,20 0,20 10,10 10,10 0))"), K.parse_wkt("POLYGON ((2 2,4 2,4 4,2 4,2 2))")
    assert K.area(K.union([square, beside])) == 200 and len(K.union([square, beside])) == 1
    assert K.area(K.union([ring, ring])) == 96 and len(K.union([ring, ring])[0]) == 2
    assert K.area(K.union([ring, inner])) == 100 and len(K.union([ring, inner])[0]) == 1
    assert K.union([]) is None and K.union([[], None]) is None and K.union([ring]) is ring


def test_clipped_parts_add_up(jts):
    rng = np.random.default_rng(4)
    for _ in range(25):
        s = star(rng, *rng.uniform(-5, 5, 2))
        if not K.is_valid(s):
            continue
        whole = 0.0
        for i in range(-5, 5):
            for j in range(-5, 5):
                part = K.clip(s, i * 4.0, j * 4.0, i * 4.0 + 4, j * 4.0 + 4)
                box = jts.read(f"POLYGON (({i * 4} {j * 4},{i * 4 + 4} {j * 4},{i * 4 + 4} {j * 4 + 4},{i * 4} {j * 4 + 4},{i * 4} {j * 4}))")
                own = K.overlay_areas([part])[1] if part else 0.0
                assert own == pytest.approx(jts.read(K.to_wkt(s)).intersection(box).getArea(), abs=1e-9)
                whole += own
        assert whole == pytest.approx(K.area(s), abs=1e-9)
