"""Polygons that are judged, repaired, dissolved and measured many at a time, against the kernels row by row."""

import numpy as np

from plinth.functions import geometry as geo
from plinth.functions import kernels as K
from plinth.functions import ragged
from plinth.operators import matching
from plinth.plans.fixtures import footprints_a


def box(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]


def turned(points, angle, x, y):
    c, s = np.cos(angle), np.sin(angle)
    return np.array(points, float) @ np.array([[c, s], [-s, c]]) + [x, y]


def text(*rings):
    return "POLYGON (" + ", ".join("(" + ", ".join(f"{x!r} {y!r}" for x, y in np.asarray(r, float).tolist()) + ")" for r in rings) + ")"


def faulty():
    rng = np.random.default_rng(3)
    out = []
    for k in range(30):
        x, y, w, h = 500_000 + rng.uniform(0, 99), 6_600_000 + rng.uniform(0, 99), rng.uniform(2, 9), rng.uniform(2, 9)
        x, y = (x, y) if k % 2 else (30 + x * 1e-7, 59 + y * 1e-7)
        w, h = (w, h) if k % 2 else (w * 1e-4, h * 1e-4)
        shell = box(x, y, w, h)
        out += [
            text(shell), text([shell[0], shell[2], shell[1], shell[3], shell[0]]), text([shell[0], shell[1], shell[0], shell[0]]), text([shell[0], *shell]),
            text(shell, box(x + w / 8, y + h / 8, w / 8, h / 8)), text(shell, [(x + w / 4, y), (x + w * 3 / 8, y + h / 4), (x + w / 8, y + h / 4), (x + w / 4, y)]),
            text(shell, box(x + w / 2, y + h / 4, w, h / 2)), text(shell, box(x, y + h / 4, w / 2, h / 2)), text(shell, box(x + 2 * w, y, w, h)),
            text(shell, [shell[0], shell[2], shell[1], shell[3], shell[0]]), text(turned(box(0, 0, w, h), k, x, y), turned(box(w / 4, h / 4, w / 8, h / 8), k, x, y)),
            text(shell, box(x + w / 8, y + h / 8, w / 8, h / 8), box(x + w / 2, y + h / 2, w / 8, h / 8)),
        ]
    return [*out, None, "POLYGON EMPTY", "POLYGON ((0 0, 1 1", "POINT (1 2)"]


def test_faulty_polygons_are_read_as_row_by_row():
    texts = faulty()
    for degrees in (False, True):
        for t, got in zip(texts, ragged._batch(texts, degrees), strict=True):
            want = ragged._one(t, degrees)
            assert got[1:5] == want[1:5], t
            assert (got[0] is None) == (want[0] is None) and (got[5] is None or np.isclose(got[5], want[5], rtol=1e-6, atol=1e-9, equal_nan=True)), t
    shapes = [K.parse_wkt(t) for t in texts]
    assert ragged.valid_each(shapes) == [K.is_valid(g) for g in shapes]
    assert ragged.parsed_each(texts) == [K.to_wkb(g) for g in shapes]


def test_invalid_rings_and_holes_are_not_taken_one_by_one(monkeypatch):
    made = []
    real = K.Arrangement
    monkeypatch.setattr(K, "Arrangement", lambda *a: made.append(1) or real(*a))
    monkeypatch.setattr(K, "is_valid", lambda g: 1 / 0)
    x = [text([(k, 0), (k + 2, 3), (k + 2, 0), (k, 3), (k, 0)]) for k in range(100)]
    x += [text(box(k, 0, 8, 8), box(k + 1, 1, 1, 1)) for k in range(100)]
    got = ragged._batch(x, False)
    assert [r[3] for r in got] == [True] * 100 + [False] * 100 and len(made) < 5


def test_unions_of_many_lists_at_once(monkeypatch):
    made = []
    real = K.Arrangement
    monkeypatch.setattr(K, "Arrangement", lambda *a: made.append(1) or real(*a))
    lists = []
    for k in range(60):
        w, h, d, a, x, y = 2.0 + k % 20, 2.0 + k % 13, 3.0 + k % 5, k * 0.37, 500_000 + k * 7919 % 3000, 6_600_000 + k * 104729 % 3000
        lists.append([[[turned(b, a, x, y)]] for b in (box(0, 0, w, h), box(w, 0.5, d, h + 0.5), box(-d, -1, d, h / 2 + 1))])
    lists += [[[[turned(box(k, 0, 2, 2), 0.3, 0, 0)]] for k in (0, 5)], [lists[0][0], [], lists[0][0]], [], [[]]]
    got = K.unions(lists)
    assert len(made) == 1
    for g, shapes in zip(got, lists, strict=True):
        want = K.union(shapes)
        assert (g is None) == (want is None)
        if g is not None:
            assert K.is_valid(g) and [len(p) for p in g] == [len(p) for p in want] and np.isclose(K.area(g), K.area(want), rtol=1e-7)


def test_measures_of_a_batch_are_those_of_the_expressions(spark):
    data = [K.to_wkb(K.parse_wkt(t)) for t in faulty()] + [K.to_wkb(K.parse_wkt("MULTIPOLYGON (((0 0, 2 0, 2 2, 0 2, 0 0), (1 1, 1.5 1, 1 1.5, 1 1)), ((5 5, 6 5, 6 7, 5 5)))"))]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(data)], "id long, wkb binary")
    got = {r["id"]: r for r in matching.shapes(df, degrees=False).collect()}
    e = df.withColumn("g", K.wkb_to_geometry("wkb")).withColumns({"b": geo.bounds("g"), "c": geo.centroid("g"), "area": geo.area("g"), "perimeter": geo.perimeter("g")})
    for r in e.select("id", "b.*", "area", "perimeter", "c.*").withColumnsRenamed({"x": "cx", "y": "cy"}).collect():
        for m in matching.MEASURES:
            a, b = got[r["id"]][m], r[m]
            assert (a is None) == (b is None) and (a is None or np.isclose(a, b, rtol=1e-9, atol=1e-9)), (r["id"], m)


def test_a_small_file_is_dealt_over_the_cores(spark):
    assert footprints_a(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_crowded_groups_are_dealt_over_the_cores(spark):
    rows = [(k, bytearray(K.to_wkb([[np.array(box(k, j, 2, 2), float)]])), float(k), float(j), k + 2.0, j + 2.0) for k in range(64) for j in range(2)]
    df = spark.createDataFrame(rows, "component_id long, wkb binary, minx double, miny double, maxx double, maxy double").coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    for first in (256, 1):
        merged = matching.dissolved(df, first=first)
        assert merged.rdd.getNumPartitions() >= cores
        assert [K.area(K.from_wkb(r["rep_geometry"])) for r in merged.collect()] == [6.0] * 64
