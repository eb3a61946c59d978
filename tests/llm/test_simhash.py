import numpy as np
import xxhash

from plinth.llm import simhash as S


def plain(text):
    import re

    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    runs = [" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))]
    hs = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(fps):
    root = list(range(len(fps)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= S.THRESHOLD:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def test_fingerprints(docs):
    for r in docs.collect():
        assert S.fingerprint(r["text"]) == plain(r["text"])


def test_fingerprint_across_chunks(monkeypatch):
    text = " ".join(f"w{k % 97}" for k in range(500))
    whole = S.fingerprint(text)
    monkeypatch.setattr(S, "_CHUNK", 7)
    assert S.fingerprint(text) == whole == plain(text)


def test_the_covering_code_covers():
    nearest, _ = S._tables()
    assert max(bin(int(e)).count("1") for e in nearest) == 3


def test_every_near_pair_meets_at_a_home():
    rng = np.random.default_rng(5)
    for _ in range(200):
        x = int(rng.integers(0, 1 << 63))
        y = x
        for k in rng.choice(64, int(rng.integers(0, 3)), replace=False):
            y ^= 1 << int(k)
        home, _, _ = S.anchors(np.array([x], np.uint64))
        _, visits, _ = S.anchors(np.array([y], np.uint64))
        assert home[0] in visits and len(set(visits)) == len(visits)


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    fps = [int(x) for x in rng.integers(0, 1 << 63, 150)]
    for x in fps[:80]:
        for _ in range(3):
            y = x
            for k in rng.choice(64, int(rng.integers(1, 4)), replace=False):
                y ^= 1 << int(k)
            fps.append(y)
    fps = sorted(set(fps))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    got = {tuple(sorted(r)) for r in S.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 2}
    assert got == want and want


def test_components_of_the_table(spark, sf):
    rows = S.query(spark, sf).collect()
    fps = [int(r["fingerprint"], 16) for r in rows]
    ids = [r["doc_id"] for r in rows]
    groups = brute(fps)
    least = {}
    for i, g in enumerate(groups):
        least[g] = min(least.get(g, ids[i]), ids[i])
    assert [r["component_id"] for r in rows] == [least[g] for g in groups]


def test_edge_rows(docs, no_docs):
    got = S.components(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[2]["fp"] == by[3]["fp"] == by[4]["fp"] == 0 and by[3]["component_id"] == 2
    assert by[None]["component_id"] is None and by[11]["component_id"] == 10
    assert S.components(no_docs).count() == 0
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, d) for d in (1, 2, 5, 6, 7, 8, 9, 10)] + [(True, 0)]
    assert S.keep_one(no_docs).count() == 0


def test_all_blocks_cover_and_meet():
    for block, radius in ((S.GOLAY[0], 3), (S.MORE[0], 1), (S.MORE[1], 0)):
        assert max(bin(int(e)).count("1") for e in S._tables(block)[0]) == radius
    rng = np.random.default_rng(6)
    for _ in range(300):
        x = int(rng.integers(0, 1 << 64, dtype=np.uint64))
        y = x
        for k in rng.choice(64, int(rng.integers(0, 3)), replace=False):
            y ^= 1 << int(k)
        home, _, _ = S.anchors(np.array([x], np.uint64), True)
        _, visits, _ = S.anchors(np.array([y], np.uint64), True)
        assert home[0] in visits and len(set(visits)) == len(visits) and visits.max() < 1 << 38
    some = rng.integers(0, 1 << 64, 20_000, dtype=np.uint64)
    for more, few in ((False, 62), (True, 207)):
        home, visits, _ = S.anchors(some, more)
        assert len(visits) < few * len(some) and len(set(home.tolist())) > (19_900 if more else 19_800)


def test_links_by_all_blocks(spark):
    rng = np.random.default_rng(2)
    fps = rng.integers(0, 1 << 63, 400).tolist()
    for x in fps[:200]:
        y = x
        for k in rng.choice(64, int(rng.integers(1, 4)), replace=False):
            y ^= 1 << int(k)
        fps.append(y)
    signed = sorted(set(np.array(sorted(set(fps)), np.uint64).view(np.int64).tolist()))
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    few, many = ({tuple(sorted(r)) for r in S.links(df, n).collect()} for n in (S.MANY, 0))
    assert few == many and len(many) > 50
