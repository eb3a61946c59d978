"""Joins, graphs, ranks, cleaning and models on small inputs with odd cases."""

import random

import pytest
from pyspark.sql import functions as F

from plinth.functions import numeric as num
from plinth.operators import cleaning, modelling, profiling
from plinth.operators.graph import connected_components
from plinth.operators.ranking import running_total
from plinth.operators.spatial_join import box_join, point_band_join


def boxes(spark, rows):
    return spark.createDataFrame(rows, "id long, minx double, miny double, maxx double, maxy double")


@pytest.mark.parametrize("reach", [0.0, 3.0])
def test_box_join_equals_brute_force(spark, reach):
    rnd = random.Random(4)

    def make(n, at):
        out = []
        for k in range(n):
            x, y = rnd.uniform(-200, 200), rnd.uniform(-200, 200)
            big = 400 if k % 37 == 0 else 12
            out.append((at + k, x, y, x + rnd.uniform(0, big), y + rnd.uniform(0, big)))
        return [*out, (at + n, None, 0.0, 1.0, 1.0), (at + n + 1, -1e6, -1e6, 1e6, 1e6)]

    a, b = make(150, 0), make(150, 1000)
    want = {
        (p[0], q[0]) for p in a for q in b
        if p[1] is not None and q[1] is not None and p[1] <= q[3] + reach and q[1] <= p[3] + reach and p[2] <= q[4] + reach and q[2] <= p[4] + reach
    }
    got = [(r["l"]["id"], r["r"]["id"]) for r in box_join(boxes(spark, a), boxes(spark, b), 10.0, reach).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert box_join(boxes(spark, a[:0]), boxes(spark, b), 10.0).count() == 0


def test_point_band_join(spark):
    rnd = random.Random(6)
    pts = [(k, float(rnd.randint(-30, 30)), float(rnd.randint(-30, 30))) for k in range(200)] + [(900, None, 1.0)]
    df = spark.createDataFrame(pts, "id long, cx double, cy double")
    want = {(p[0], q[0]) for p in pts[:-1] for q in pts[:-1] if p[0] != q[0] and (p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2 <= 25}
    got = [(r["l"]["id"], r["r"]["id"]) for r in point_band_join(df, 5, "id").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_components_equal_union_find(spark):
    rnd = random.Random(8)
    edges = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1200)] + [(2000, 2000 + k) for k in range(1, 80)] + [(5000, 5000), (None, 7), (7, None)]
    rnd.shuffle(edges)
    root = {}

    def find(a):
        root.setdefault(a, a)
        while root[a] != a:
            a = root[a]
        return a

    for u, v in edges:
        if u is not None and v is not None:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    got = {r["vertex"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {v: find(v) for v in root}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_components_say_when_rounds_run_out(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(200)], "src long, dst long")
    with pytest.raises(RuntimeError):
        connected_components(path, max_rounds=1)


def test_running_total(spark):
    rnd = random.Random(2)
    rows = [(k, rnd.choice([None, 1, 5, 9])) for k in range(300)]
    rnd.shuffle(rows)
    got = {r["id"]: (r["total"], r["rank"]) for r in running_total(spark.createDataFrame(rows, "id long, v long"), [F.col("id")], {"total": "v", "rank": F.lit(1)}).collect()}
    total = 0
    for rank, (k, v) in enumerate(sorted(rows)):
        assert got[k] == (total, rank)
        total += v or 0


def test_cleaning_conserves_rows(spark):
    schema = "id long, area double, purpose_of_building string, stairs double, avg_floor_height double, height double, k int"
    rows = [(1, 15.0, "a", 1.0, 0.0, 3.0, 1), (2, 14.99, "a", 1.0, 3.0, 3.0, 2), (3, 20.0, None, None, 0.0, 9.0, 3), (4, 20.0, "a", 0.0, 11.0, None, 4), (5, 20.0, "b", None, float("nan"), 3.0, 5), (6, 20.0, "a", 2.0, 3.0, 3.0, 1), (7, None, "x", -1.0, 12.0, 3.0, 7)]
    raw = spark.createDataFrame(rows, schema)
    clean, audit = cleaning.clean_b(raw, "x", ["k"])
    kept, gone = {r["id"]: r for r in clean.collect()}, {r["row_idx"]: r["drop_reason"] for r in audit.collect()}
    assert sorted([*kept, *gone]) == [r[0] for r in rows]
    assert gone == {2: "small_utility_object", 4: "stairs_invalid;avg_floor_height_too_high;missing_height", 6: "duplicate", 7: "stairs_invalid;avg_floor_height_too_high"}
    assert kept[3]["purpose_of_building"] == "unknown" and kept[3]["quality_flags"] == "filled_avg_floor_height;filled_stairs;" and kept[3]["status"] == "repaired"
    assert kept[5]["avg_floor_height"] is None and kept[1]["avg_floor_height"] == 3.0
    for f in (cleaning.clean_b,):
        empty, none = f(raw.limit(0), "x", ["k"])
        assert empty.count() == none.count() == 0


def test_swap_uses_the_values_as_they_came(spark):
    df = cleaning.begin(spark.createDataFrame([(1, 5.0, 2.0), (2, 1.0, 2.0), (3, None, 2.0)], "id long, gkh_floor_count_min double, gkh_floor_count_max double"))
    got = [(r["gkh_floor_count_min"], r["gkh_floor_count_max"], r["status"]) for r in cleaning.swap_floors(df).orderBy("id").collect()]
    assert got == [(2.0, 5.0, "repaired"), (1.0, 2.0, "clean"), (None, 2.0, "clean")]


def test_group_folds(spark):
    rows = [(k, f"g{k % 23}" if k % 50 else None) for k in range(600)]
    df = spark.createDataFrame(rows, "component_id long, spatial_group string")
    folds = modelling.group_folds(df).collect()
    assert len({r["spatial_group"] for r in folds}) == len(folds) == 23
    load = df.join(spark.createDataFrame(folds), "spatial_group").groupBy("fold").count().collect()
    assert len(load) == 5 and max(r["count"] for r in load) - min(r["count"] for r in load) < 60


def test_honest_features_hold_no_target():
    assert not modelling.LEAKY & set(modelling.FEATURE_SETS["honest"]) and modelling.LEAKY <= set(modelling.FEATURE_SETS["full"])
    assert len(modelling.combinations(modelling.GRIDS["forest"])) == 8 and len(modelling.FEATURE_SETS) == 6


def _model_frame(spark):
    rows = [(k, float(k % 9), ["x", "y", None][k % 3], 3.0 * (k % 9) + (k % 3) if k % 4 else None, f"{k % 11}_0") for k in range(240)]
    df = spark.createDataFrame(rows, "component_id long, s double, p string, target_height double, spatial_group string")
    return df.withColumn("target_height_is_observed", F.col("target_height").isNotNull().cast("int"))


@pytest.mark.parametrize("kind,params", [("linear", {}), ("forest", {"numTrees": 5, "maxDepth": 4}), ("gbt", {"maxIter": 3}), ("boosted_categories", {"maxIter": 3})])
def test_models(spark, kind, params):
    df = _model_frame(spark)
    train, _ = modelling.split_observed(df)
    out = modelling.cross_validate(train, kind, ["s", "p"], params, folds=3)
    assert out.count() == train.count() and out.select("component_id").distinct().count() == train.count()
    metrics = out.agg(*(v.alias(k) for k, v in modelling.regression_metrics().items())).first()
    assert metrics["r2"] > 0.5
    predicted, importance = modelling.fit_and_predict(df, kind, ["s", "p"], params)
    assert predicted.count() == 60 and importance.first()["feature"]
    if kind == "linear":
        assert metrics["rmse"] < 0.01
        best = modelling.compare(train, kind, {"a": ["s"], "b": ["s", "p"]}, {}, folds=3).first()
        assert best["feature_set"] == "b"


def test_encoders(spark):
    df = _model_frame(spark)
    codes = modelling.ordinal_codes(df, "p")
    other = spark.createDataFrame([("x",), ("z",), (None,)], "p string")
    assert sorted(r["p"] for r in modelling.ordinal_encode(other, "p", codes).collect()) == [-1.0, -1.0, 0.0]
    assert modelling.fit_medians(spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "v double"), ["v"]) == {"v": 3.0}
    assert modelling.categorical(df, ["s", "p"]) == ["p"]


def test_numeric_functions(spark):
    df = spark.createDataFrame([("12.5", 1234567, 0.125), ("x", -5, None), (None, 0, float("nan"))], "t string, n long, d double")
    got = df.select(num.safe_int("t").alias("i"), num.safe_float("d").alias("f"), num.format_int("n").alias("s"), num.format_float("n", 1).alias("c"), num.format_percent("n", F.lit(0)).alias("p"), num.round_half_even("d", 2).alias("r"), num.ratio("n", F.lit(0)).alias("z")).collect()
    assert [tuple(r)[:2] for r in got] == [(12, 0.125), (0, 0.0), (0, 0.0)]
    assert got[0]["s"] == "1 234 567" and got[0]["c"] == "1 234 567,0" and got[0]["p"] == "0,0%" and got[0]["r"] == 0.12 and got[0]["z"] == 0.0


def test_profiles_of_empty_and_constant(spark):
    df = spark.createDataFrame([(1.0,)] * 5, "v double")
    assert [tuple(r) for r in profiling.histogram(df, "v", 4).collect()] == [(1, 5)]
    assert profiling.histogram(df.limit(0), "v", 4).count() == 0
    assert profiling.describe(df.limit(0), ["v"]).first()["count"] == 0
    assert profiling.fixed_sample(df, 3, "v").count() == 3


def test_folds_equal_the_plain_greedy(spark):
    rnd = random.Random(12)
    for folds, sizes in ((5, [rnd.randint(1, 9) for _ in range(300)]), (3, [50, 1, 1, 1, 1, 1, 1, 1]), (4, [7] * 10), (5, [3, 2]), (2, [100] + [3] * 40 + [1] * 11), (1, [2, 2, 5])):
        names = [f"g{k:03}" for k in range(len(sizes))]
        load, want = [0] * folds, {}
        for n, name in sorted(zip(sizes, names, strict=True), key=lambda x: (-x[0], x[1])):
            f = min(range(folds), key=load.__getitem__)
            load[f] += n
            want[name] = f
        df = spark.createDataFrame([(name,) for n, name in zip(sizes, names, strict=True) for _ in range(n)] + [(None,)], "spatial_group string")
        assert {r["spatial_group"]: r["fold"] for r in modelling.group_folds(df, folds=folds).collect()} == want, (folds, sizes)


@pytest.mark.parametrize("most", [10**6, 0])
def test_quantiles(spark, most):
    import numpy as np

    from plinth.operators.ranking import quantiles

    rnd = random.Random(3)
    values = [rnd.gauss(0, 5) for _ in range(400)] + [1.5] * 300 + [None] * 7
    df = spark.createDataFrame([(v, None) for v in values], "v double, w double")
    qs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    row = quantiles(df, {"a": (F.col("v"), qs), "b": (F.col("v") * 2, [0.5]), "c": (F.col("w"), [0.5])}, most).first()
    known = [v for v in values if v is not None]
    assert row["a"] == pytest.approx(np.quantile(known, qs)) and row["b"] == pytest.approx([2 * np.median(known)])
    assert row["c"] is None or row["c"] == [None]
    assert quantiles(df.limit(0), {"a": (F.col("v"), [0.5])}, most).count() == 1


def test_modes_and_codes(spark):
    df = spark.createDataFrame([("b", None), ("a", None), ("b", None), (None, None), ("a", None)], "c string, d string")
    assert modelling.fit_modes(df, ["c", "d"]) == {"c": "a", "d": "missing"}
    assert {r["c"]: r["code"] for r in modelling.ordinal_codes(df, "c").collect()} == {"a": 0, "b": 1}


def test_compare_and_best(spark):
    rows = [(k, float(k % 7), "xy"[k % 2], 3.0 * (k % 7) + (k % 2), 1, f"g{k % 11}") for k in range(220)]
    df = spark.createDataFrame(rows, "component_id long, f double, t string, target_height double, target_height_is_observed int, spatial_group string")
    found = modelling.compare(df, "linear", {"f": ["f"], "ft": ["f", "t"]}, [{}], folds=3)
    assert [r["feature_set"] for r in found.collect()] == ["ft", "f"] and modelling.best(found).first()["feature_set"] == "ft"
    importance = spark.createDataFrame([(f"f{k}", float(k)) for k in range(30)], "feature string, importance double")
    assert [r["feature"] for r in modelling.top_features(importance, 3).collect()] == ["f27", "f28", "f29"]


def test_union_areas_of_a_crowded_component(spark):
    """A component of many overlapping polygons, copies among them, is measured cell by cell."""
    from plinth.functions import geometry as geo
    from plinth.functions import kernels
    from plinth.operators import matching

    rnd = random.Random(5)
    rows, texts = [], []
    for k in range(60):
        x, y, w = rnd.uniform(-100, 300), rnd.uniform(0, 400), 900.0 if k == 0 else rnd.uniform(5, 120)
        text = f"POLYGON (({x} {y}, {x + w} {y}, {x + w} {y + w}, {x + w / 2} {y + w / 2}, {x} {y + w}, {x} {y}))"
        texts += [text] * (5 if k == 3 else 1)
        rows += [(f"{'AB'[k % 2]}_{k}_{j}", "AB"[k % 2], 1, text) for j in range(5 if k == 3 else 1)]
    rows.append(("A_x", "A", 2, texts[0]))
    df = spark.createDataFrame(rows, "uid string, src string, component_id long, wkt string").withColumn("wkb", kernels.wkt_to_wkb(F.col("wkt")))
    got = {r["component_id"]: r for r in matching.union_areas(df.select("component_id", "src", "uid"), matching.shapes(df.select("uid", "wkb"), degrees=False)).collect()}
    shapes = {s: [kernels.parse_wkt(r[3]) for r in rows if r[2] == 1 and r[1] in s] for s in ("A", "B", "AB")}
    assert got[1]["union_area_a"] == pytest.approx(kernels.union_area(shapes["A"])) and got[1]["union_area_b"] == pytest.approx(kernels.union_area(shapes["B"]))
    assert got[1]["union_area_all"] == pytest.approx(kernels.union_area(shapes["AB"]))
    assert got[2]["union_area_b"] is None and got[2]["union_area_a"] == got[2]["union_area_all"] == pytest.approx(kernels.area(kernels.parse_wkt(texts[0])))
    assert geo.GEOMETRY


def test_scratch_deletes_what_was_staged(spark, tmp_path):
    import os

    from plinth import storage

    with storage.scratch(spark):
        held = storage.checkpoint(spark.range(100))
        path = storage.staging_path(spark, "t")
        held.write.parquet(path)
        file = held._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
        assert held.count() == 100 and os.path.isdir(path) and os.path.isdir(file.removeprefix("file:"))
    assert not os.path.exists(path) and not os.path.exists(file.removeprefix("file:"))
