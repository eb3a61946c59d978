"""Many rows in few places: what is measured by kinds of rows equals what is measured row by row."""

import numpy as np

from plinth.operators import neighbors


def test_neighbours_of_crowded_points(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "ASKS", 4)
    monkeypatch.setattr(neighbors, "BLOCK", 64)
    rng = np.random.default_rng(5)
    rows = [(k, None if k % 7 == 0 else float(rng.integers(1, 5)), float(rng.integers(0, 4)) * 20, float(rng.integers(-2, 3)) * 25) for k in range(300)]
    rows += [(900, 2.0, None, 1.0), (901, 3.0, 5_000.0, 5_000.0)]
    got = {r["component_id"]: r for r in neighbors.neighbor_features(spark.createDataFrame(rows, "component_id long, target_height double, cx double, cy double"), radii=(50, 100)).collect()}
    assert set(got) == {r[0] for r in rows}
    for k, _, x, y in rows:
        for r in (50, 100):
            near = [v for j, v, p, q in rows if j != k and None not in (x, p) and np.hypot(x - p, y - q) <= r]
            some = np.array([v for v in near if v is not None])
            row = got[k]
            assert (row[f"n_neighbors_{r}m"], row[f"n_neighbors_obs_height_{r}m"]) == (len(near), len(some))
            want = [some.mean(), np.median(some), some.min(), some.max(), some.std(ddof=1), *np.quantile(some, [0.25, 0.75])] if len(some) else [None] * 7
            found = [row[f"neighbor_height_{s}_{r}m"] for s in neighbors.STATS]
            assert found == want if not len(some) else np.allclose(found, want)
