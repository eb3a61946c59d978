import re

import corpus_pipeline
from plinth.llm import bpe, quality


def near_copies_by_force(rows):
    """The smallest doc_id that each reaches by Jaccard similarity of five-word shingles, 4/5 or more; rows: (doc_id, text)."""
    sets = {}
    for d, t in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or "")) if w]
        sets[d] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_stages_take_effect(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, held = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, held[-1], sf).write.parquet(str(tmp_path / str(k)))
        held.append(spark.read.parquet(str(tmp_path / str(k))))
    raw, judged, cut, single, mixed, ids = held
    assert all(df.columns == columns for df in held[:-1]) and ids.columns == ["doc_id", "n_tokens", "ids"]

    kept = {r["doc_id"] for r in quality.judge(raw).where("kept").collect()}
    assert {r["doc_id"] for r in judged.collect()} == kept
    assert cut.count() == judged.count()
    before = {r["doc_id"]: (r["text"] or "").split("\n") for r in judged.collect()}
    for r in cut.collect():
        lines = iter(before[r["doc_id"]])
        assert r["text"] == "" or all(x in lines for x in r["text"].split("\n"))
    # One document of each group stays: groups of texts whose five-word shingles are similar by 0.8 or more, by brute force.
    group = near_copies_by_force(sorted((r["doc_id"], r["text"]) for r in cut.collect()))
    left = sorted(r["doc_id"] for r in single.collect())
    assert left == sorted(set(group.values()))
    assert {r["doc_id"] for r in mixed.collect()} <= set(left)
    copies = mixed.groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert 1 <= copies <= 3
    own = bpe.worker_bpe(bpe.default_path())
    texts = {r["doc_id"]: r["text"] for r in mixed.collect()}
    for r in ids.collect():
        assert r["ids"] == list(own.encode(texts[r["doc_id"]])) and r["n_tokens"] == len(r["ids"])

    whole = sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, sf).collect())
    assert whole == sorted((r["doc_id"], r["n_tokens"]) for r in ids.collect())


def test_empty_and_odd_tables(spark, docs, no_docs, tmp_path):
    """Nulls everywhere, long texts, repeated rows, and columns with the names that stages use, through all stages."""
    own = bpe.worker_bpe(bpe.default_path())
    for name, now in (("odd", docs), ("none", no_docs)):
        columns, held = now.columns, [now]
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, held[-1], "").write.parquet(str(tmp_path / f"{name}{k}"))
            held.append(spark.read.parquet(str(tmp_path / f"{name}{k}")))
        assert all(df.columns == columns for df in held[:-1])
        raw, judged, cut, single, mixed, ids = ([r.asDict() for r in df.collect()] for df in held)
        if name == "none":
            assert not any((judged, cut, single, mixed, ids))
            continue
        extra = [c for c in columns if c not in ("doc_id", "text", "lang", "source", "n_chars")]
        assert all({c: r[c] for c in extra} == {c: raw[0][c] for c in extra} for rows in (judged, cut, single, mixed) for r in rows)
        kept = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
        assert kept == {r["doc_id"] for r in judged} == {10, 11} and sorted(r["text"] for r in cut) == sorted(r["text"] for r in judged)
        assert [r["doc_id"] for r in single] == [10]
        # The only document is its source's and takes its part of the words once.
        assert [(r["doc_id"], r["text"]) for r in mixed] == [(10, single[0]["text"])]
        assert [(r["doc_id"], r["ids"]) for r in ids] == [(10, list(own.encode(single[0]["text"])))]
