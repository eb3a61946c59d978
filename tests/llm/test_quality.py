import re
from collections import Counter

from plinth.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    ws = WORD.findall(text)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    often = Counter(grams)
    held = {p for i, g in enumerate(grams) if often[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(held)


def test_counts_equal_brute_force(spark, docs):
    texts = [r["text"] for r in docs.collect()] + ["a b c a b c a", "# * $ % & | < > x", "x\nx\n\n \nx", "a a a a", "a b a b a", "one\ttwo\vthree\rfour"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in quality.counts(df).collect()}
    for k, t in enumerate(texts):
        assert tuple(got[k][c] for c in quality.COUNTS) == brute(t), t


def test_edge_rows(docs, no_docs):
    rows = quality.judge(docs).collect()
    assert len(rows) == docs.count()
    assert all(not r["kept"] for r in rows if r["doc_id"] in (2, 3, 4, 5, 7))
    assert {r["kept"] for r in rows if r["doc_id"] == 10} == {True}
    assert quality.judge(no_docs).count() == 0
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [10, 11]
    assert quality.filter_documents(no_docs).count() == 0


def test_bad_host_takes_its_documents(spark):
    good, bad = " ".join(f"w{k}" for k in range(60)), "too short"
    rows = [(k, good if k % 20 == 0 else bad, "bad") for k in range(400)] + [(1000 + k, bad if k % 20 == 0 else good, f"h{k % 8}") for k in range(400)]
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not any(kept[k] for k in range(400))
    assert sum(kept[1000 + k] for k in range(400)) == 380
