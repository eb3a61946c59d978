import zlib

import numpy as np
import pytest

from plinth.llm import langid as L


def test_codewords_differ():
    for n in (1, 2, 3, 4, 6, 9, 20):
        code = L.codewords(n)
        assert code.shape[0] == n
        assert len({tuple(r) for r in code.tolist()}) == n


def test_held_out_accuracy(spark, sf):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    got = L.query(spark, sf).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) / len(held) > 0.97


def test_edge_rows(spark, docs, no_docs):
    got = {r["doc_id"]: r for r in L.predict(docs, L.fit(docs)).collect()}
    assert all(got[d]["lang_pred"] == "und" and got[d]["score"] == 0 for d in (2, 3, 4))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[None]["held_out"] is False
    assert L.predict(no_docs, L.fit(no_docs)).count() == 0
    unlabelled = L.fit(docs.withColumn("lang", docs["lang"].substr(0, 0).cast("string")).where("doc_id < 0"))
    assert {r["lang_pred"] for r in L.predict(docs, unlabelled).collect()} == {"und"}


def test_one_language(spark):
    df = spark.createDataFrame([(k, "some text here", "en") for k in range(20)], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in L.predict(df, L.fit(df)).collect()} == {("en", 1.0)}


def test_prediction_ignores_lang_source_and_id(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    model = L.fit(docs)
    a = sorted((r["lang_pred"], r["score"]) for r in L.predict(docs, model).collect())
    b = sorted((r["lang_pred"], r["score"]) for r in L.predict(docs.selectExpr("doc_id + 7 AS doc_id", "text", "'xx' AS lang", "'yy' AS source"), model).collect())
    assert a == b


def test_chunks_cover_long_texts(monkeypatch):
    text = "der die das und ein ΑΣ ß 漢字, 12 " * 300
    all_codes = list(L._codes(text))
    whole = L.Model(["a", "b"], L.codewords(2), __import__("numpy").random.default_rng(0).standard_normal((1 << L.BUCKET_BITS, 1)).astype("f4"), None, None)
    once = whole.evidence(text)
    monkeypatch.setattr(L, "CHUNK", 100)
    parts = list(L._codes(text))
    assert len(all_codes) == 1 and len(parts) > 50 and np.concatenate(parts).tolist() == all_codes[0].tolist()
    assert whole.evidence(text) == pytest.approx(once, rel=1e-9)


def plain_predict(model, text):
    """The decoder in plain Python: every codeword against every bit."""
    import math

    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    a = b" " + text.lower().encode().translate(L._FOLD) + b" "
    n, bits = len(a) - 2, model.code.shape[1]
    sums = [0.0] * bits
    for i in range(n):
        gram = a[i] | a[i + 1] << 8 | a[i + 2] << 16
        bucket = (gram * 2654435761 % 2**32) >> (32 - L.BUCKET_BITS)
        for k in range(bits):
            sums[k] += float(model.weights[bucket, k])
    margins = [float(model.scale[0][k]) * sums[k] / n * math.sqrt(math.log1p(n)) + float(model.scale[1][k]) for k in range(bits)]
    losses = [sum(float(model.loss[k]) * math.log1p(math.exp(-model.code[j, k] * margins[k])) for k in range(bits)) for j in range(len(model.langs))]
    best = min(range(len(losses)), key=lambda j: (losses[j], j))
    return model.langs[best], 1 / sum(math.exp(losses[best] - x) for x in losses)


def test_predictions_equal_a_plain_decoder(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = L.fit(docs)
    long = " ".join(["Der Zug fährt heute nicht nach Köln, sagte sie."] * 4000)
    odd = spark.createDataFrame([(10**6, None), (10**6 + 1, ""), (10**6 + 2, "1234 !?"), (10**6 + 3, "漢字"), (10**6 + 4, long), (10**6 + 5, "é")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(odd)
    got = {r["doc_id"]: r for r in L.predict(rows, model).collect()}
    for r in rows.collect():
        if len(r["text"] or "") > 20_000 and r["doc_id"] < 10**6:
            continue
        lang, score = plain_predict(model, r["text"])
        assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == (lang, pytest.approx(score, abs=1e-4)), r["doc_id"]
    assert got[10**6 + 4]["lang_pred"] == "de"
