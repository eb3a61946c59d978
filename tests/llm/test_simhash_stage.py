from plinth.llm import near_copies, simhash


def test_the_stage_links_simhash_fingerprints(spark, monkeypatch):
    words = [f"w{k}" for k in range(400)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, " ".join(f"x{k}" for k in range(400)))]
    fps = [near_copies.fingerprint(near_copies.shingles(t)) for _, t in rows]
    assert fps[0] != fps[1] and (fps[0] ^ fps[1]).bit_count() <= simhash.THRESHOLD or fps[0] == fps[1]
    seen, own = [], simhash.links

    def links(found):
        out = own(found)
        seen.append(({r["fp"] % 2**64 for r in found.collect()}, {(r["src"] % 2**64, r["dst"] % 2**64) for r in out.collect()}))
        return out

    monkeypatch.setattr(simhash, "links", links)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(df).collect()) == [1, 3]
    (held, linked), = seen
    assert held == set(fps) and {frozenset(p) for p in linked} == ({frozenset(fps[:2])} if fps[0] != fps[1] else set())
