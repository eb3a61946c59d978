"""The forest against a plain one, a row and a cut at a time."""

import random

import numpy as np
from pyspark.sql import functions as F

from plinth.operators import forests, modelling
from plinth.operators.forests import Features, Settings

MODELS = 3


def _rows(n=600, seed=5):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = r.randrange(12), r.choice([None, *range(8)]), r.choice(["p", "q", "r", "s", None])
        y = None if i % 17 == 0 else float(3 * a + (b or 0) + (7 if c == "q" else 0) + r.randrange(4))
        out.append((i, r.randrange(MODELS), y, float(a), None if b is None else float(b), c))
    return out


def _frame(spark):
    return spark.createDataFrame(_rows(), "id long, fold int, y double, a double, b double, c string")


def _plain(rows, path, depth, features, s, model, tree):
    """A function from bins to the mean, of a tree grown a node at a time. ``rows``: (bins, drawn, target)."""
    whole, total = sum(w for _, w, _ in rows), sum(w * y for _, w, y in rows)
    asks = forests.asked(np.array([path]), features.count, s.seed, model, tree)[0]
    found = None
    if depth < s.depth:
        for c in range(len(rows[0][0])):
            for v in sorted({int(b[c]) for b, _, _ in rows}):
                at = c if c < features.numbers else features.start(c) + features.levels[c - features.numbers].index(v)
                right = [(w, y) for b, w, y in rows if (b[c] > v if c < features.numbers else b[c] == v)]
                r_w, r_s = sum(w for w, _ in right), sum(w * y for w, y in right)
                if asks[at] and min(r_w, whole - r_w) >= s.least:
                    gain = r_s**2 / r_w + (total - r_s) ** 2 / (whole - r_w) - total**2 / whole
                    if gain > (found[0] + 1e-6 if found else 1e-9):
                        found = gain, c, v
    if found is None:
        return lambda b: total / whole
    _, c, v = found

    def side(b):
        return int(b[c] > v if c < features.numbers else b[c] == v)

    sides = [_plain([r for r in rows if side(r[0]) == k], 2 * path + k, depth + 1, features, s, model, tree) for k in (0, 1)]
    return lambda b: sides[side(b)](b)


def test_trees_equal_plain_ones():
    r = np.random.default_rng(3)
    bins = np.column_stack([r.integers(0, 9, 400), r.integers(0, 5, 400), r.integers(1, 5, 400)])
    y, n = 3 * bins[:, 0] + 5 * (bins[:, 2] == 2) + r.integers(0, 4, 400), r.integers(1, 4, 400)
    features, s = Features(2, ((1, 2, 3, 4),)), Settings(depth=6, least=3)
    for tree in range(4):
        w = forests.Draws(n, np.arange(400) * 7919).of(s.seed, 1, tree)
        own = np.flatnonzero(w)
        grown = forests._grown(bins[own], w[own], (w * y)[own], 1, 0, features, s, 1, tree)
        plain = _plain([(bins[i], int(w[i]), int(y[i])) for i in own], 1, 0, features, s, 1, tree)
        assert np.allclose(grown[3][forests._land(grown, bins, 2)], [plain(b) for b in bins], rtol=1e-12)


def test_draws_are_poisson():
    n = np.repeat([0, 1, 5, 2000], 20_000)
    w = forests.Draws(n, np.arange(len(n))).of(42, 0, 7).reshape(4, -1)
    assert not w[0].any() and abs(w[1].var() - 1) < 0.05 and abs((w[1] == 0).mean() - np.exp(-1)) < 0.02
    assert abs(w[2].mean() - 5) < 0.1 and abs(w[3].mean() - 2000) < 2 and abs(w[3].var() / 2000 - 1) < 0.05
    asks = forests.asked(np.arange(1, 20_001), 11, 42, 0, 3)
    assert (asks.sum(1) == 4).all() and np.allclose(asks.mean(0), 4 / 11, atol=0.02)


def test_predictions_do_not_depend_on_dealing(spark):
    """Nodes cut in jobs, or in tasks; rows in one partition, or in many."""
    df = _frame(spark)
    got = [
        {r["id"]: r["prediction"] for r in forests.forest(rows, ["a", "b"], ["c"], "y", MODELS, Settings(trees=6, depth=7, least=2, within=within), "id").collect()}
        for rows, within in ((df.coalesce(1), 200_000), (df.repartition(7), 40), (df.repartition(3, "a"), 1))
    ]
    assert got[0] == got[1] == got[2] and len(got[0]) == 600 and len(set(got[0].values())) > 50


def test_jobs_do_not_grow_with_trees(spark):
    """pyspark.ml's forest takes a job a level and group of nodes for each fold."""
    df = _frame(spark).drop("fold").withColumns({"target_height": F.col("y"), "spatial_group": F.col("id") % 40}).where("y IS NOT NULL")
    jobs = set()
    for trees in (3, 40):
        spark.sparkContext.setJobGroup(f"forest-{trees}", "")
        out = modelling.cross_validate(df, "forest", ["a", "b", "c"], {"numTrees": trees, "maxDepth": 12, "minInstancesPerNode": 2}, key="id").toPandas()
        jobs.add(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"forest-{trees}")))
        assert len(out) == df.count() and 1 - ((out.target_height - out.prediction) ** 2).mean() / out.target_height.var() > 0.8
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1
