import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """Count, exact deviations by row, and covariance, in fractions."""
    xs = [[math.floor(Fraction(c) * 1024) + 100_000 for c in v] for v in rows]
    n, d = len(xs), len(xs[0])
    sums = [sum(x[k] for x in xs) for k in range(d)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True)) for x in xs]
    away = [[n * a - s for a, s in zip(x, sums, strict=True)] for x in xs]
    cov = [[float(Fraction(sum(y[i] * y[j] for y in away), n**3)) for j in range(d)] for i in range(d)]
    return n, deviations, np.array(cov)


def check(df, rows):
    n, deviations, cov = brute(rows)
    got = df.collect()
    m = min(8, len(rows[0]))
    assert len(got) == len(rows) * m and {r["n"] for r in got} == {n}
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    for r in got:
        assert r["deviation"] == deviations[r["vec_id"]]
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(cov), rel=1e-6, abs=1e-9)
    white = np.zeros((len(rows), m))
    for r in got:
        white[r["vec_id"], r["component"] - 1] = math.nan if r["whitened"] is None else r["whitened"]
    kept = ~np.isnan(white).any(axis=0)
    white = white[:, kept]
    error = np.abs(np.cov(white.T, bias=True).reshape(kept.sum(), -1) - np.eye(kept.sum())).max()
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] <= 1e-9 and error <= 1e-9
    # Projected on the eigenvectors, the whitened vectors give the covariance back.
    centred = np.array([[math.floor(Fraction(c) * 1024) for c in v] for v in rows], float)
    centred -= centred.mean(axis=0)
    for k in np.flatnonzero(kept):
        direction = centred.T @ white[:, kept[: k + 1].sum() - 1]
        direction /= np.linalg.norm(direction)
        assert np.abs(cov @ direction - values[k] * direction).max() <= 1e-7 * values[0]


def table(spark, rows, parts=3):
    return spark.createDataFrame([(k, [float(c) for c in v], 0) for k, v in enumerate(rows)], SCHEMA).repartition(parts)


def test_equals_fractions(spark):
    rnd = np.random.default_rng(3)
    rows = np.float32(rnd.standard_normal((60, 11)) * np.arange(1, 12)).tolist()
    check(whitening.fit_transform(table(spark, rows)), rows)


def test_entries_of_any_size(spark):
    rnd = random.Random(2)
    rows = np.float32([[rnd.choice((1, -1)) * 10.0 ** rnd.uniform(-3, 9) for _ in range(3)] for _ in range(40)]).tolist()
    got = whitening.fit_transform(table(spark, rows)).collect()
    n, deviations, cov = brute(rows)
    assert all(r["deviation"] == deviations[r["vec_id"]] for r in got)
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    assert all(r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(cov), rel=1e-9) for r in got)


def test_integers_and_products_are_exact():
    c = np.array([[1e30, -1e300], [0.1, -0.1], [2.0**70, 3.5], [-(2.0**59.5), 2.0**50.3]])
    want = [[math.floor(Fraction(v) * 1024) + 100_000 for v in r] for r in c.tolist()]
    got = whitening.integers(c)
    assert got.tolist() == want
    x = np.array(want, object)
    assert (whitening.products(x) == x.T @ x).all()
    y = np.random.default_rng(1).integers(-(2**40), 2**40, (9000, 3))
    assert (whitening.products(y) == y.astype(object).T @ y.astype(object)).all()
    for v in (0, 5, -5, 2**200 + 3, -(2**61)):
        assert sum(d << (60 * k) for k, d in enumerate(whitening._words(v))) == v


def test_dropped_rows_flat_components_and_clashes(spark):
    odd = [(90, None, 1), (91, [1.0, None, 2.0], 1), (92, [1.0, math.nan, 2.0], 1), (93, [math.inf, 1.0, 1.0], 1), (94, [], 1), (95, [1.0], 1)]
    good = [(0, [1.0, 2.0, 5.0], 0), (1, [2.0, 1.0, 5.0], 0), (2, [2.0, 1.0, 5.0], 0), (3, [4.0, -1.0, 5.0], 0), (None, [0.5, 0.25, 5.0], 0)]
    df = spark.createDataFrame([*odd, *good], SCHEMA).withColumns({k: F.lit(1) for k in ("n", "x", "component", "i", "d", "count")})
    got = whitening.fit_transform(df).collect()
    assert len(got) == 15 and {r["n"] for r in got} == {5}
    assert sorted({r["vec_id"] for r in got if r["vec_id"] is not None}) == [0, 1, 2, 3]
    assert all((r["whitened"] is None) == (r["component"] == 3) for r in got)
    assert sum(r["explained"] for r in got if r["vec_id"] == 0) == pytest.approx(1)


def test_one_row_and_none(spark):
    got = whitening.fit_transform(table(spark, [[1.0, 2.0]])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got] == [(1, 0, None, None, None)] * 2
    assert whitening.fit_transform(table(spark, [[1.0, 2.0]]).limit(0)).count() == 0


def test_whole_table(spark, sf):
    from plinth.llm.queries import QUERIES

    df = QUERIES["op12_whitening"](spark, sf)
    assert dict(df.dtypes)["deviation"] == "bigint"
    table = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    n, deviations, cov = brute([r["embedding"][:64] for r in table])
    want = dict(zip((r["vec_id"] for r in table), deviations, strict=True))
    got = df.collect()
    values = np.sort(np.linalg.eigvalsh(cov))[::-1]
    assert len(got) == 8 * n and all(r["deviation"] == want[r["vec_id"]] and r["n"] == n for r in got)
    assert all(abs(r["explained"] / (values[r["component"] - 1] / np.trace(cov)) - 1) < 1e-9 and r["identity_error"] < 1e-9 for r in got)
