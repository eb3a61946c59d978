import hashlib
import random

import numpy as np
import pytest

library = pytest.importorskip("sentencepiece")
public = pytest.importorskip("public_tokenizers")

from plinth.llm import sentence_pieces as own  # noqa: E402

PATH = public.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def theirs():
    return library.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def ours():
    return own.SentencePieces(PATH)


def ids(pieces, texts):
    return [np.frombuffer(x, "<i4").tolist() for x in pieces.encode(texts)]


def texts(theirs):
    rnd = random.Random(5)
    known = [theirs.id_to_piece(k).replace("▁", " ") for k in range(259, 32000)]
    spans = [(0, 32), (32, 126), (0xA0, 0x250), (0x300, 0x36F), (0x2000, 0x2070), (0x370, 0x5FF), (0x4E00, 0x5000), (0x1F600, 0x1F650)]
    out = ["", " ", "  a b ", "▁x ▁", "\n\t x\r\n", "\x00a", "<s>hi</s><unk><0x0A>", "﻿x", "漢字😀", "�", "é ́ ①"]
    out += ["".join(chr(rnd.randint(*rnd.choice(spans))) for _ in range(rnd.randint(1, 14))) for _ in range(1500)]
    out += ["".join(rnd.choices(known, k=rnd.randint(1, 10))) for _ in range(1000)]
    out += ["".join(rnd.choices(known, k=rnd.randint(1, 10))).replace(" ", "") for _ in range(1000)]
    out += ["".join(rnd.choices(a, k=rnd.randint(1, 60))) for a in ("ab ", "etaoinshr ", "= -", "aA") for _ in range(500)]
    return out


def test_ids_and_decoded_text_equal_the_library(theirs, ours):
    some = texts(theirs)
    want = theirs.encode(some)
    for t, w, g in zip(some, want, ids(ours, some), strict=True):
        assert g == w, repr(t)
        assert ours.decode(g) == theirs.decode(w), repr(t)


def test_words_without_spaces_of_any_length(theirs, ours):
    rnd = random.Random(6)
    some = ["a" * 100_001, " " * 100_000 + "x", "ab" * 50_000, "-" * 77_777, "the" * 30_000, "".join(rnd.choices("etaoinshrdlu", k=200_000)), "漢字か" * 20_000]
    assert ids(ours, some) == theirs.encode(some)


def test_decoding_any_ids(theirs, ours):
    rnd = random.Random(7)
    for _ in range(3000):
        some = [rnd.randrange(300 if rnd.random() < 0.7 else 32000) for _ in range(rnd.randint(0, 6))]
        assert ours.decode(some) == theirs.decode(some), some


def test_a_pair_is_joined_at_once_only_if_nothing_can_take_it(ours):
    table = ours.table
    for key, rank, reach in zip(table.keys[:-1].tolist()[::50], table.rank.tolist()[::50], table.reach.tolist()[::50], strict=False):
        assert reach <= rank and key < (ours.size + 1) ** 2


def test_small_caches_and_blocks_change_nothing(theirs, monkeypatch):
    monkeypatch.setattr(own, "CACHE", 5)
    monkeypatch.setattr(own, "CHARS", 7)
    pieces = own.SentencePieces(PATH)
    some = texts(theirs)[::40]
    for k in range(0, len(some), 9):
        assert ids(pieces, some[k : k + 9]) == theirs.encode(some[k : k + 9])


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto()
    with open(PATH, "rb") as f:
        spec.ParseFromString(f.read())
    spec.normalizer_spec.remove_extra_whitespaces = True
    other = tmp_path / "other.model"
    other.write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError):
        own.SentencePieces(str(other))


def test_query_and_round_trip(docs, no_docs, theirs):
    want = {}
    for r in docs.collect():
        found = theirs.encode(r["text"] or "")
        want[r["doc_id"]] = (len(found), hashlib.sha256(",".join(map(str, found)).encode()).hexdigest(), hashlib.sha256(theirs.decode(found).encode()).hexdigest())
    got = own.digests(docs).collect()
    assert len(got) == docs.count() and all((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == want[r["doc_id"]] for r in got)
    for r in own.decode_documents(own.encode_documents(docs)).collect():
        assert hashlib.sha256(r["text"].encode()).hexdigest() == want[r["doc_id"]][2]
    for f in (own.digests, own.encode_documents):
        assert f(no_docs).count() == 0


def test_whole_table(spark, sf, theirs):
    from plinth.llm.queries import QUERIES

    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = theirs.encode([r["text"] or "" for r in rows])
    want = {(r["doc_id"], len(f), hashlib.sha256(",".join(map(str, f)).encode()).hexdigest(), hashlib.sha256(theirs.decode(f).encode()).hexdigest()) for r, f in zip(rows, found, strict=True)}
    assert {tuple(r) for r in QUERIES["op11_sentencepiece"](spark, sf).collect()} == want
