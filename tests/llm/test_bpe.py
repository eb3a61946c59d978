import hashlib
import random
import zlib

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")

from plinth.llm import bpe, pieces, token_files  # noqa: E402

PATH = public.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


def texts():
    rnd = random.Random(3)
    out = ["", " ", "it's I'LL 'S 'Re can't !'s ''s", "x<|endoftext|>y <|ENDOFTEXT|> <|startoftext|>", "İΣas Σ ǅ", "é ́ ≠", "a b\x85c\x1cd\x1f e", "日本語 – “q”", "qzqz zqxk 12½²", "naïve CAFÉ ß ẞ ﬁ", "\x00\x01", "👍🏽", "aaa" * 300]
    latin = [chr(c) for c in range(256)]
    out += ["".join(rnd.choices(latin, k=rnd.randint(1, 12))) for _ in range(800)]
    spans = [(32, 126), (0xA0, 0x250), (0x300, 0x36F), (0x2000, 0x2070), (0x370, 0x5FF), (0x1F600, 0x1F650)]
    out += ["".join(chr(rnd.randint(*rnd.choice(spans))) for _ in range(rnd.randint(1, 14))) for _ in range(800)]
    return out


def test_ids_and_decoded_text_equal_the_library(library):
    own, other = bpe.worker_bpe(PATH), token_files._worker_ids(PATH)
    for t in texts():
        want = library.encode(t, add_special_tokens=False).ids
        assert list(own.encode(t)) == want, repr(t)
        assert np.frombuffer(other.ids(t), "<u4").tolist() == want, repr(t)
        assert own.decode(want) == library.decode(want, skip_special_tokens=False).encode()


def test_no_token_spans_a_certain_cut():
    own = bpe.worker_bpe(PATH)
    assert own.fragments("aqzb") == [("aq", False), ("zb", True)]
    assert all(len(own.fragments(t.removesuffix(own.suffix))) == 1 for t in own.vocab)


def test_small_caches_change_nothing(monkeypatch, library):
    monkeypatch.setattr(pieces, "CACHE", 3)
    own = bpe.WordBpe(PATH)
    for t in texts()[:60]:
        assert list(own.encode(t)) == library.encode(t, add_special_tokens=False).ids


def test_query_and_round_trip(spark, docs, no_docs, library):
    rows = {(r["doc_id"], r["text"]) for r in docs.collect()}
    got = bpe.digests(docs).collect()
    want = {}
    for d, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want[d] = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert len(got) == docs.count() and all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want[r["doc_id"]] for r in got)
    encoded = bpe.encode_documents(docs)
    for r in bpe.decode_documents(encoded).collect():
        assert hashlib.sha256(r["text"].encode()).hexdigest() == want[r["doc_id"]][2]
    for f in (bpe.digests, bpe.encode_documents):
        assert f(no_docs).count() == 0


def test_token_files(spark, docs, no_docs, library, tmp_path):
    folder = str(tmp_path / "t")
    token_files.write(docs, folder)
    files = token_files.read(spark, folder).collect()
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    index = sorted(token_files.index(spark, folder).collect(), key=lambda r: r["start"])
    assert len(index) == len(rows) == len(files)
    held = sorted((tuple(r["tokens"]) for r in files))
    assert held == sorted(tuple([*library.encode(t or "", add_special_tokens=False).ids, 2]) for _, t in rows)
    for (d, t), r in zip(rows, index, strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    some = token_files.read(spark, folder, [9, 10], ("doc_id", "n_tokens"))
    assert sorted(r["doc_id"] for r in some.collect()) == [9, 10]
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()
    token_files.write(no_docs, str(tmp_path / "e"))
    assert token_files.index(spark, str(tmp_path / "e")).count() == 0


def test_file_format(spark, docs, tmp_path):
    import glob

    import pyarrow.parquet as pq

    folder = str(tmp_path / "f")
    token_files.write(docs, folder)
    for f in glob.glob(f"{folder}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                col = meta.row_group(g).column(c)
                assert col.has_column_index and col.has_offset_index
                assert any("DICTIONARY" in e or "DELTA" in e for e in col.encodings)


def test_long_runs_without_cuts(library):
    """A run of a million letters is merged in seconds; scanning it would take hours."""
    import time

    own, rnd = bpe.WordBpe(PATH), random.Random(5)
    began = time.perf_counter()
    for text in ("".join(rnd.choices("etaoinshrdlu", k=1_000_000)), "a" * 300_000, "x<|endoftext|>y" * 3000, "".join(rnd.choices("ab漢é", k=20_000))):
        assert list(own.encode(text)) == library.encode(text, add_special_tokens=False).ids
    assert time.perf_counter() - began < 60


def test_heap_and_scan_agree():
    own, rnd = bpe.WordBpe(PATH), random.Random(6)
    for _ in range(500):
        parts = rnd.choices("abehinrst", k=rnd.randint(1, 60))
        assert own._heap(list(parts)) == own._scan(list(parts)), parts


def test_cache_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_BYTES", 5000)
    held = pieces.PieceIds(lambda p: p.encode())
    for k in range(500):
        assert held.ids(f"w{k} x") == f"w{k}x".encode()
        assert sum(map(len, held)) < 5000 and len(held) <= 25
    held.ids("a" * 500)
    assert "a" * 500 not in held


def test_files_that_cut_otherwise(spark, tmp_path):
    """op4 gives whole texts to the library for a file that ``pieces`` doesn't know; op9 refuses a file it can't decode."""
    other = public.path("byte_bpe_50k.json")
    whole = tokenizers.Tokenizer.from_file(other)
    ids = token_files._worker_ids(other)
    for t in texts()[:300]:
        assert np.frombuffer(ids.ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, repr(t)
    with pytest.raises(ValueError):
        bpe.WordBpe(other)


def test_upper_case_kept_by_another_normaliser(tmp_path):
    import json

    spec = json.loads(open(PATH, encoding="utf-8").read())
    spec["normalizer"] = {"type": "NFC"}
    path = str(tmp_path / "t.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    whole, own, ids = tokenizers.Tokenizer.from_file(path), bpe.WordBpe(path), token_files._worker_ids(path)
    for t in texts()[:200]:
        want = whole.encode(t, add_special_tokens=False).ids
        assert list(own.encode(t)) == want and np.frombuffer(ids.ids(t), "<u4").tolist() == want, repr(t)


def test_token_files_with_repeats_of_one_doc_id(spark, tmp_path):
    rows = [(7, f"text {k % 3}") for k in range(60)] + [(None, "no id")] * 30 + [(9, None), (1, "first")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder = str(tmp_path / "r")
    token_files.write(df, folder)
    got = sorted(token_files.index(spark, folder).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None] * 30 + [1] + [7] * 60 + [9]
    ends = 0
    for r in got:
        assert r["start"] == ends
        ends += r["n_tokens"]
    held = sorted((r["doc_id"], tuple(r["tokens"])) for r in token_files.read(spark, folder).collect() if r["doc_id"] == 7)
    assert [zlib.crc32(np.array(t, "<u4").tobytes()) for _, t in held] and len({r["ids_crc32"] for r in got if r["doc_id"] == 7}) == 3
