import re

import numpy as np

from plinth.llm import near_copies as C
from plinth.llm import simhash


def brute(rows):
    """The smallest id that each id reaches by Jaccard of five-word shingles, 0.8 or more; rows: (doc_id, text)."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {d: rows[find(i)][0] for i, (d, _) in enumerate(rows)}


def corpus():
    """Texts with copies of 0 to 24 changed words of 200, of which some pass 0.8 and some just don't."""
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(40):
        words = [f"w{x}" for x in rng.integers(0, 5000, 200)]
        for changed in (0, 1, 3, 4, 5, 8, 24):
            own = list(words)
            for at in rng.choice(200, changed, replace=False):
                own[at] = f"x{rng.integers(0, 5000)}"
            rows.append((len(rows), " ".join(own)))
    return [*rows, (900, None), (901, " \n "), (902, "a few words"), (903, "A few words"), (904, "few words")]


def test_keep_one_equals_brute_force_jaccard(spark):
    rows = corpus()
    want = brute(rows)
    assert len(set(want.values())) > 60
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in C.components(df).collect()} == want
    assert {r["doc_id"] for r in simhash.keep_one(df).collect()} == set(want.values())


def test_near_copies_of_the_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if (r["text"] or "").isascii()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in C.components(df).collect()} == brute(sorted(rows))


def test_a_doc_id_on_two_texts_keeps_one_row_of_each_component(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    rows = [(3, a), (7, a), (7, b), (9, b), (9, b), (5, "its own text"), (5, "its own text"), (5, "another text"), (None, a)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["text"]) for r in simhash.keep_one(df).collect()))
    assert got == sorted([(0, a), (3, a), (7, b), (5, "its own text"), (5, "another text")])


def test_common_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 80)).astype(np.int64)) for _ in range(40)]
    got = C._common(sets[:25], sets[25:])
    assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets[:25]) for j, b in enumerate(sets[25:]))
    assert C._common(sets[:3], []).shape == (3, 0) and C._common([np.empty(0, np.int64)], sets[:2]).tolist() == [[0, 0]]


def crowd():
    """A large group of texts that are alike to very different degrees: many are linked through others, many to none."""
    rng = np.random.default_rng(9)
    base = [f"w{x}" for x in rng.integers(0, 5000, 150)]
    rows = []
    for k in range(260):
        own = list(base)
        for at in rng.choice(150, int(rng.integers(0, 14)), replace=False):
            own[at] = f"x{rng.integers(0, 5000)}"
        rows.append((k, " ".join(own)))
    return rows


def test_crowds_equal_brute_force(spark, monkeypatch):
    rows = crowd()
    want = brute(rows)
    assert 20 < len(set(want.values())) < 240
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for most, block in ((48, 512), (3, 16), (10**6, 512)):
        monkeypatch.setattr(C, "CROWD", most)
        monkeypatch.setattr(C, "BLOCK", block)
        assert {r["doc_id"]: r["component_id"] for r in C.components(df).collect()} == want
