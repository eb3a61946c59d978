"""Regressions from fold moments against separate fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.operators import modelling, regressions

SETS = {"a": ["a"], "ab": ["a", "b"], "abt": ["a", "b", "t"], "t": ["t"], "flat": ["a", "flat", "none"], "same": ["a", "a2"]}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(8)
    data = []
    for k in range(400):
        a, b, t = float(rng.normal(50, 4)), float(rng.uniform(-1, 1)), ["x", "y", "z", None][k % 4]
        y = None if k % 23 == 0 else 3 * a - 2 * b + (5 if t == "x" else 0) + float(rng.normal())
        data.append((k, y, None if k % 7 == 0 else a, None if k % 11 == 0 else b, 2 * a + 1 if k % 7 else None, t, f"g{k % 29}" if k % 31 else None))
    df = spark.createDataFrame(data, "component_id long, target_height double, a double, b double, a2 double, t string, spatial_group string")
    return df.withColumns({"flat": F.lit(4.0), "none": F.lit(None).cast("double"), "n": F.lit(1), "v": F.lit(2), "at": F.lit(3)})


def separate(rows, features, folds):
    """By least squares on each fold's own design."""
    out = {}
    for k in {r["fold"] for r in folds.values()}:
        train = [r for r in rows if r["fold"] != k]
        design = []
        for c in features:
            if c == "t":
                for v in sorted({r["t"] or "missing" for r in rows}):
                    design.append(lambda r, v=v: float((r["t"] or "missing") == v))
            else:
                known = [r[c] for r in train if r[c] is not None]
                mean = sum(known) / len(known) if known else 0.0
                design.append(lambda r, c=c, mean=mean: 0.0 if r[c] is None else r[c] - mean)
        x = np.array([[1.0, *(f(r) for f in design)] for r in train])
        w = np.linalg.lstsq(x, np.array([r["target_height"] for r in train]), rcond=1e-9)[0]
        for r in rows:
            if r["fold"] == k:
                out[r["component_id"]] = float(np.array([1.0, *(f(r) for f in design)]) @ w)
    return out


def test_equals_separate_fits(rows):
    got = regressions.linear_folds(rows, SETS).collect()
    kept = rows.where("target_height IS NOT NULL AND spatial_group IS NOT NULL")
    folds = {r["spatial_group"]: r for r in modelling.group_folds(rows.where("target_height IS NOT NULL")).collect()}
    held = [{**r.asDict(), "fold": folds[r["spatial_group"]]["fold"]} for r in kept.collect()]
    assert len(got) == len(held) * len(SETS)
    for name, features in SETS.items():
        want = separate(held, features, folds)
        for r in got:
            if r["feature_set"] == name:
                assert r["prediction"] == pytest.approx(want[r["component_id"]], rel=1e-6, abs=1e-6), name


def test_equals_the_pipeline(rows):
    mine = regressions.linear_folds(rows, {"ab": ["a", "b"]}).select("component_id", F.col("prediction").alias("mine"))
    theirs = modelling.cross_validate(rows.where("target_height IS NOT NULL"), "linear", ["a", "b"])
    assert mine.join(theirs, "component_id").where("abs(mine - prediction) > 1e-6").count() == 0 and mine.count() == theirs.count()


def test_odd_tables(rows, monkeypatch):
    assert regressions.linear_folds(rows.limit(0), SETS).count() == 0
    one = regressions.linear_folds(rows.where("spatial_group = 'g1'"), {"a": ["a"]})
    assert one.count() == 0  # one group is one fold, which no other rows can predict
    monkeypatch.setattr(regressions, "MOST_COLUMNS", 3)
    with pytest.raises(ValueError):
        regressions.linear_folds(rows, SETS)
