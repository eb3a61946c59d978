import numpy as np
import pytest

from plinth.llm import neighbours as N


def brute(rows, every=50, k=5):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids = np.array([i for i, _ in ok])
    x = np.stack([v for _, v in ok])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for at in np.flatnonzero(ids % every == 0):
        s = (x @ x[at]).round(12)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[at]][:k]
        out[int(ids[at])] = [(int(ids[j]), s[j]) for j in order]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v) for i, v in rows], "vec_id long, embedding array<float>")


def test_chi_square():
    assert N.chi_square(np.array(15.507))[()] == pytest.approx(0.95, abs=1e-4)
    assert N.chi_square(np.array(N.stop_ratio()))[()] == pytest.approx(N.SURE)


def test_recall_on_the_table(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute(rows)
    got = {}
    for r in N.query(spark, sf).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(got) == set(want)
    hit = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hit >= 0.9 * sum(map(len, want.values()))
    for q, found in got.items():
        assert [r for r, _, _ in sorted(found)] == list(range(1, len(found) + 1))


def test_many_cells(spark, monkeypatch):
    monkeypatch.setattr(N, "CELL_ROWS", 60)
    monkeypatch.setattr(N, "VISITS", 4)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((12, 16))
    rows = [(k, (centres[k % 12] + 0.3 * rng.standard_normal(16)).astype("f4").tolist()) for k in range(900)]
    want = brute(rows)
    got = {}
    for r in N.search(frame(spark, rows)).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sum(len(got[q] & {v for v, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)


def test_copies_nulls_and_ties(spark):
    a, b = [1.0, 0.0, 0.5], [0.0, 1.0, 0.25]
    rows = [(k, a) for k in range(40)] + [(100, b), (150, b), (200, None), (250, [0.0, 0.0, 0.0]), (300, [1.0, None, 0.0]), (350, [float("nan"), 1.0, 0.0]), (400, [float("inf"), 1.0, 0.0]), (None, a), (0, a), (450, [1.0, 2.0])]
    got = {}
    for r in sorted(N.search(frame(spark, rows)).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    assert got == {0: [1, 2, 3, 4, 5], 100: [150, 0, 1, 2, 3], 150: [100, 0, 1, 2, 3]}
    assert N.search(frame(spark, [])).count() == 0
    assert N.search(frame(spark, [(0, a)])).count() == 0
    assert [r["vec_id"] for r in N.search(frame(spark, [(0, a), (7, b)])).collect()] == [7]
    clash = frame(spark, rows[:60]).selectExpr("*", "1 AS cell", "2 AS qid", "3 AS ids", "4 AS rank")
    assert N.search(clash).count() == 15
