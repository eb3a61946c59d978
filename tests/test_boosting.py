"""The booster against a plain one, a row and a cut at a time; ordered statistics against a loop."""

import math
import pickle
import random

import pytest
from pyspark.sql import functions as F

from plinth.operators import boosting, modelling
from plinth.operators.boosting import Settings

MODELS = 3


def _rows(n=400, seed=7):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = r.randrange(12), r.choice([None, *range(8)]), r.randrange(5)
        y = None if i % 17 == 0 else 3.0 * a + (b or 0) * c + r.gauss(0, 2)
        out.append((i, r.randrange(MODELS), y, float(a), None if b is None else float(b), c))
    return out


def _cuts(rows, s):
    """(gain, feature, value) of every cut of some rows (features, residual); first of equals: least feature, least value. None is below all."""
    whole, n = math.fsum(e for _, e in rows), len(rows)
    for f in range(len(rows[0][0])):
        values = sorted({-math.inf if x[f] is None else x[f] for x, _ in rows})
        for v in values[:-1]:
            left = [e for x, e in rows if (-math.inf if x[f] is None else x[f]) <= v]
            if min(len(left), n - len(left)) >= s.least:
                g = math.fsum(left)
                yield g * g / (len(left) + s.l2) + (whole - g) ** 2 / (n - len(left) + s.l2) - whole**2 / (n + s.l2), f, v


def _plain_tree(rows, s):
    """A tree grown best node first: a function from features to value."""
    def value(part):
        return s.rate * math.fsum(e for _, e in part) / (len(part) + s.l2)

    leaves = [{"rows": rows, "depth": 0}]
    root = leaves[0]
    for _ in range((s.leaves or 10**6) - 1):
        found = []
        for leaf in leaves:
            if leaf["depth"] < (s.depth or 10**6) and len(leaf["rows"]) > 1:
                for gain, f, v in _cuts(leaf["rows"], s):
                    if gain > 1e-9 and (not found or gain > found[0][0] + 1e-9):
                        found = [(gain, f, v, leaf)]
        if not found:
            break
        _, f, v, leaf = found[0]
        sides = [[], []]
        for x, e in leaf["rows"]:
            sides[not (x[f] is None or x[f] <= v)].append((x, e))
        leaf["cut"], leaf["sides"] = (f, v), [{"rows": side, "depth": leaf["depth"] + 1} for side in sides]
        leaves.remove(leaf)
        leaves += leaf["sides"]

    def told(x):
        at = root
        while "cut" in at:
            f, v = at["cut"]
            at = at["sides"][not (x[f] is None or x[f] <= v)]
        return value(at["rows"])

    return told


def _plain_symmetric(rows, s):
    def key(x, cuts):
        return tuple(not (x[f] is None or x[f] <= v) for f, v in cuts)

    def score(part):
        return math.fsum(e for _, e in part) ** 2 / (len(part) + s.l2) if part else 0.0

    cuts = []
    for _ in range(s.depth):
        nodes = {}
        for x, e in rows:
            nodes.setdefault(key(x, cuts), []).append((x, e))
        best = None
        for f in range(len(rows[0][0])):
            for v in sorted({-math.inf if x[f] is None else x[f] for x, _ in rows})[:-1]:
                gain = 0.0
                for part in nodes.values():
                    left = [r for r in part if r[0][f] is None or r[0][f] <= v]
                    right = [r for r in part if not (r[0][f] is None or r[0][f] <= v)]
                    gain += score(left) + score(right) - score(part)
                if best is None or gain > best[0] + 1e-7:
                    best = (gain, f, v)
        cuts.append(best[1:])
    sums = {}
    for x, e in rows:
        sums.setdefault(key(x, cuts), []).append(e)
    return lambda x: s.rate * math.fsum(sums[k]) / (len(sums[k]) + s.l2) if (k := key(x, cuts)) in sums else 0.0


def _plain(rows, s):
    out = {}
    for k in range(MODELS):
        train = [(r[3:], r[2]) for r in rows if r[1] != k and r[2] is not None]
        base = math.fsum(y for _, y in train) / len(train)
        said, trees = [base] * len(train), []
        for _ in range(s.rounds):
            left = [(x, y - p) for (x, y), p in zip(train, said, strict=True)]
            trees.append(_plain_symmetric(left, s) if s.symmetric else _plain_tree(left, s))
            said = [p + trees[-1](x) for (x, _), p in zip(train, said, strict=True)]
        out |= {r[0]: base + sum(t(r[3:]) for t in trees) for r in rows if r[1] == k}
    return out


@pytest.mark.parametrize("settings", [
    Settings(rounds=5, rate=0.3, depth=3, l2=3.0, symmetric=True, staged=2),
    Settings(rounds=5, rate=0.3, depth=None, leaves=9, l2=1.0, least=5, staged=3),
    Settings(rounds=3, rate=0.5, depth=3, least=10),
])
def test_equals_a_plain_booster(spark, settings):
    rows = _rows()
    df = spark.createDataFrame(rows, "id long, fold int, y double, a double, b double, c long").repartition(5)
    found, trees = boosting.boost(df, ["a", "b", "c"], [], "y", MODELS, settings, "id")
    got, want = {r["id"]: r["prediction"] for r in found.collect()}, _plain(rows, settings)
    assert got.keys() == want.keys() and [len(t) for t in trees] == [settings.rounds] * MODELS
    assert max(abs(got[k] - want[k]) for k in want) < 1e-6


def test_dealing_makes_no_difference(spark, monkeypatch):
    df = spark.createDataFrame(_rows(), "id long, fold int, y double, a double, b double, c long")
    s = Settings(rounds=4, depth=4, l2=1.0, staged=2)
    one, trees_one = boosting.boost(df.coalesce(1), ["a", "b", "c"], [], "y", MODELS, s, "id")
    monkeypatch.setattr(boosting, "compact", lambda frame, **_: frame)  # many tasks, whose sums meet in a shuffle
    many, trees_many = boosting.boost(df.repartition(6), ["a", "b", "c"], [], "y", MODELS, s, "id")
    assert trees_one == trees_many
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, many.collect()))


def test_rows_of_equal_bins_are_trained_on_as_one(spark, monkeypatch):
    rows = [(i, i % MODELS, float(i % 7), float(i % 4), float(i % 3)) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, fold int, y double, a double, b double")
    held, level = [], boosting._level
    monkeypatch.setattr(boosting, "_level", lambda blocks, *rest: held.append(blocks.map(lambda b: len(pickle.loads(b)[1])).sum()) or level(blocks, *rest))
    found, _ = boosting.boost(df, ["a", "b"], [], "y", MODELS, Settings(rounds=3, rate=1.0, depth=4, staged=2), "id")
    assert held and max(held) <= 4 * MODELS * MODELS
    assert found.count() == len(rows)


def test_ordered_statistics(spark):
    r = random.Random(3)
    rows = [(i, i % 4 - 1, None if i % 9 == 0 else float(r.randrange(50)), "hot" if i % 3 else r.choice(["a", "b", None])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, fold int, y double, c string")
    got = {x["id"]: x["c"] for x in boosting.ordered_statistics(df, "c", "y", MODELS, "id").collect()}
    place = {x["id"]: x["h"] for x in df.select("id", F.xxhash64(F.lit(42), "id").alias("h")).collect()}
    for k in range(MODELS):
        trains = [x for x in rows if x[1] != k and x[2] is not None]
        prior = sum(x[2] for x in trains) / len(trains)
        for i, fold, y, c in rows:
            own = [x for x in trains if x[3] == c and (fold == k or y is None or place[x[0]] < place[i])]
            assert abs(got[i][k] - (sum(x[2] for x in own) + prior) / (len(own) + 1)) < 1e-6
    # No row is told its own target.
    at = next(x for x in rows if x[2] is not None and x[1] == -1)
    moved = spark.createDataFrame([(*x[:2], x[2] + 10 if x[0] == at[0] else x[2], x[3]) for x in rows], df.schema)
    after = {x["id"]: x["c"] for x in boosting.ordered_statistics(moved, "c", "y", MODELS, "id", weight=0.0).collect()}
    before = {x["id"]: x["c"] for x in boosting.ordered_statistics(df, "c", "y", MODELS, "id", weight=0.0).collect()}
    same = [(a, b) for a, b in zip(before[at[0]], after[at[0]], strict=True)]
    assert all(a == b or (a is None and b is None) or abs(a - b) < 1e-6 for a, b in same)


def test_ordered_codes(spark):
    rows = [(0, 0, 1.0, "z"), (1, 1, 1.0, "a"), (2, 1, 2.0, "m"), (3, 0, 2.0, "m"), (4, 0, None, None)]
    df = spark.createDataFrame(rows, "id long, fold int, y double, c string")
    got = {x["id"]: x["c"] for x in boosting.ordered_codes(df, "c", "y", 2).collect()}
    assert got == {0: [-1.0, 2.0], 1: [0.0, -1.0], 2: [1.0, 1.0], 3: [1.0, 1.0], 4: [0.0, 1.0]}


def test_empty_constant_and_unseen(spark):
    schema = "id long, fold int, y double, a double, c string"
    s = Settings(rounds=2, depth=2, symmetric=True)
    empty, _ = boosting.boost(spark.createDataFrame([], schema), ["a"], ["c"], "y", 2, s, "id")
    assert empty.count() == 0
    same = spark.createDataFrame([(i, i % 2, 4.0, 1.0, "x") for i in range(10)] + [(10, 0, None, None, None)], schema)
    found, trees = boosting.boost(same, ["a"], ["c"], "y", 2, s, "id")
    assert {r["prediction"] for r in found.collect()} == {4.0} and all(len(t.feature) == 1 for m in trees for t in m)


def test_learns_and_ranks_features(spark):
    r = random.Random(1)
    rows = [(i, float(i % 20), r.choice("pqr"), 2.0 * (i % 20) if i % 7 else None, f"{i % 13}_0") for i in range(600)]
    df = spark.createDataFrame(rows, "component_id long, s double, p string, target_height double, spatial_group string").withColumn("target_height_is_observed", F.col("target_height").isNotNull().cast("int"))
    for kind in ("histogram", "ordered_categories"):
        predicted, importance = modelling.fit_and_predict(df, kind, ["s", "p"], {"maxIter": 60, "stepSize": 0.2})
        told = predicted.join(df, "component_id").select(F.max(F.abs(F.col("target_height_predicted") - 2 * F.col("s")))).first()[0]
        shares = {x["feature"]: x["importance"] for x in importance.collect()}
        assert predicted.count() == 86 and told < 1.0 and shares["s"] > 0.9 and abs(sum(shares.values()) - 1) < 1e-9
