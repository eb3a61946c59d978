import numpy as np

from plinth.functions import kernels as K
from plinth.functions import pairs


def shapes():
    rng = np.random.default_rng(2)
    out = []
    for k in range(60):
        x, y = rng.integers(0, 12, 2).tolist()
        w, h = rng.integers(1, 8, 2).tolist()
        ring = [(x, y), (x + w, y), (x + w, y + h / 2), (x + w / 2, y + h / 2), (x + w / 2, y + h), (x, y + h), (x, y)] if k % 3 else [(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
        r = np.array(ring, float)
        if k % 4 == 0:
            r = r @ np.array([[np.cos(k), -np.sin(k)], [np.sin(k), np.cos(k)]])
        if k % 5 == 0:
            r = r[::-1]
        out.append(K.to_wkb([[r]]))
    bow = np.array([(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)], float)
    hole = [np.array(r, float) for r in ([(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)], [(2, 2), (6, 2), (6, 6), (2, 6), (2, 2)])]
    inside = np.array([(3, 3), (4, 3), (4, 4), (3, 4), (3, 3)], float)
    return [*out, K.to_wkb([[bow]]), K.to_wkb([hole]), K.to_wkb([[inside]]), None, K.to_wkb([])]


def test_many_pairs_equal_one_at_a_time():
    data = shapes()
    side = pairs.Side(data)
    assert side.plain.sum() == 61
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(data)), np.arange(len(data))))
    dist, inter = pairs.measures(side, side, i, j)
    for n in range(len(i)):
        g, h = K.from_wkb(data[i[n]]), K.from_wkb(data[j[n]])
        if not g or not h:
            assert np.isnan(dist[n])
            continue
        d = K.distance(g, h)
        assert abs(dist[n] - d) < 1e-9 and (dist[n] == 0) == (d == 0)
        assert abs(inter[n] - (K.intersection_area(g, h) if d == 0 else 0)) < 1e-9
