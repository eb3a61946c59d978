import numpy as np

from plinth.llm import neighbours as N


def test_scaled_copies_in_many_leaves_are_all_seen():
    rng = np.random.default_rng(4)
    v = rng.standard_normal(16).astype("f4").astype(float)
    vectors = np.stack([v * 2.0 ** (k % 40 - 20) for k in range(1000)])
    ids = rng.permutation(1000)
    tree = N.Tree(ids, vectors, N._directions(16))
    best, found = tree.search(v[None, :], np.array([np.inf]), 6, N.stop_ratio())
    assert np.allclose(best, 1) and sorted(found[0]) == list(range(6))
    _, found = tree.search(v[None, :], np.array([0.0]), 6, N.stop_ratio())
    assert sorted(found[0]) == list(range(6))
