"""BPE encoding and decoding with forced boundaries.

A pair of bytes that stands inside no token of the vocabulary can't be spanned
by any merge, so it is a certain cut. White space and changes between letters,
numbers and signs are such cuts; so are pairs like ``qz`` within words. The
fragments between cuts are merged independently, lowest rank first, and their
ids concatenated. Fragments recur, so most are merged once per worker.

Decoding looks the ids' tokens up and joins them with a space, which is what the
tokenizer does that declares no decoder.

A fragment of up to SHORT characters is merged by scanning its pairs; a longer
one by a heap of its pairs over a linked list, in time n log n, so a run without
cuts may be as long as a text.

The tokenizer file is a parameter; it must be a byte-level BPE file with an
end-of-word suffix and no decoder, as ``word_bpe_49k.json`` is, else ValueError.
Normalisation and the split into words are taken from the file through the
tokenizers library where a stretch of text isn't plain Latin-1, and for all text
if the file doesn't cut as ``pieces`` does.

Defined cases: null and empty texts have no ids and decode to the empty text;
special tokens in a text are taken as such; whole texts are encoded whatever
their length; rows are independent, so repeated rows and ties change nothing; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plinth.llm.pieces import CACHE, LONGEST, PieceIds, byte_level, cuts_like, is_plain, pieces

ROWS = 500
SHORT = 40


class WordBpe:
    """Encoder and decoder of one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or not model.get("end_of_word_suffix") or spec["decoder"] is not None or "ByteLevel" not in json.dumps(spec["pre_tokenizer"]):
            raise ValueError(f"{path} isn't a byte-level BPE file with an end-of-word suffix and no decoder")
        self.suffix = model["end_of_word_suffix"]
        self.vocab = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.ranks = {tuple(m.split(" ") if isinstance(m, str) else m): k for k, m in enumerate(model["merges"])}
        bare = {t.removesuffix(self.suffix) for t in self.vocab}
        #: Pairs of neighbours that some token holds; every other pair is a certain cut.
        self.inside = {pair for t in bare for pair in zip(t, t[1:], strict=False)}
        names = {i: t for t, i in (self.vocab | self.special).items()}
        self.names = [names.get(k, "").encode() for k in range(max(names) + 1)]
        whole = Tokenizer.from_file(path)
        self._normalize = whole.normalizer.normalize_str if whole.normalizer else str
        self._split = whole.pre_tokenizer.pre_tokenize_str
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._fragments: dict[tuple[str, bool], bytes] = {}
        self._cuts = cuts_like(spec)
        self.cache = PieceIds(self._piece, pieces if self._cuts else lambda text: [text])

    def fragments(self, word: str) -> list[tuple[str, bool]]:
        """The fragments of a word between certain cuts, each with whether it ends the word."""
        inside = self.inside
        cuts = [k for k, pair in enumerate(zip(word, word[1:], strict=False), start=1) if pair not in inside]
        if not cuts:
            return [(word, True)]
        ends = [0, *cuts, len(word)]
        return [(word[i:j], j == len(word)) for i, j in zip(ends, ends[1:], strict=False)]

    def _merge(self, fragment: str, ends: bool) -> bytes:
        """Ids of a fragment: the pair of lowest rank is joined, the leftmost first, until none has a rank."""
        parts = list(fragment)
        if ends:
            parts[-1] += self.suffix
        parts = self._scan(parts) if len(parts) <= SHORT else self._heap(parts)
        return array("I", map(self.vocab.__getitem__, parts)).tobytes()

    def _scan(self, parts: list[str]) -> list[str]:
        rank, none = self.ranks.get, len(self.ranks)
        ranks = [rank(p, none) for p in zip(parts, parts[1:], strict=False)]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = rank((parts[at - 1], parts[at]), none)
            if at < len(ranks):
                ranks[at] = rank((parts[at], parts[at + 1]), none)
        return parts

    def _heap(self, parts: list[str]) -> list[str]:
        """As ``_scan``. An entry of the heap is rank * n + place of the pair's left part; one that no longer holds is passed over."""
        rank, n = self.ranks.get, len(parts)
        left, right = array("q", range(-1, n - 1)), array("q", range(1, n + 1))
        heap = [r * n + k for k, p in enumerate(zip(parts, parts[1:], strict=False)) if (r := rank(p)) is not None]
        heapify(heap)
        while heap:
            best, at = divmod(heappop(heap), n)
            gone = right[at]
            if not parts[at] or gone == n or rank((parts[at], parts[gone])) != best:
                continue
            parts[at] += parts[gone]
            parts[gone] = ""
            after = right[at] = right[gone]
            if after < n:
                left[after] = at
                if (r := rank((parts[at], parts[after]))) is not None:
                    heappush(heap, r * n + at)
            if (before := left[at]) >= 0 and (r := rank((parts[before], parts[at]))) is not None:
                heappush(heap, r * n + before)
        return [p for p in parts if p]

    def _word(self, word: str) -> bytes:
        found = self.fragments(word)
        if len(found) == 1:  # a word without cuts is cached as a piece
            return self._merge(word, True)
        return b"".join(self._fragment(f) for f in found)

    def _fragment(self, key: tuple[str, bool]) -> bytes:
        found = self._fragments.get(key)
        if found is None:
            found = self._merge(*key)
            if len(key[0]) <= LONGEST:
                if len(self._fragments) >= CACHE // 4:
                    self._fragments.clear()
                self._fragments[key] = found
        return found

    def _piece(self, piece: str) -> bytes:
        if self._cuts and is_plain(piece):
            return self._word(byte_level(piece))
        parts = self._specials.split(piece) if self._specials else [piece]
        if len(parts) > 1:  # every other part is a special token
            return b"".join(np.array([self.special[x]], "<u4").tobytes() if k % 2 else self.cache.ids(x) for k, x in enumerate(parts))
        return b"".join(self._word(w) for w, _ in self._split(self._normalize(piece)))

    def encode(self, text: str | None) -> array:
        """The ids of a text."""
        out = array("I")
        out.frombytes(self.cache.ids(text))
        return out

    def decode(self, ids) -> bytes:
        """The text of ids, in UTF-8."""
        return b" ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=2)
def worker_bpe(path: str) -> WordBpe:
    """One encoder a worker process."""
    return WordBpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (array of int) of every row."""

    def run(batches):
        bpe = worker_bpe(path or default_path())
        for b in _slices(batches):
            ids = [np.frombuffer(bpe.cache.ids(x.as_py()), "<i4") for x in b.column("text")]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(ends).astype(np.int64)), lists], ["doc_id", "n_tokens", "ids"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text (as decoded) of every row of (doc_id, ids); null ids decode to the empty text."""

    def run(batches):
        bpe = worker_bpe(path or default_path())
        for b in _slices(batches):
            texts = [bpe.decode(x.as_py() or []).decode("utf-8", "replace") for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: what encoding and decoding give, without carrying it."""

    def run(batches):
        bpe = worker_bpe(path or default_path())
        decimal = [str(k).encode() for k in range(len(bpe.names))]
        for b in _slices(batches):
            n, of_ids, of_text = [], [], []
            for x in b.column("text"):
                ids = bpe.encode(x.as_py())
                n.append(len(ids))
                of_ids.append(hashlib.sha256(b" ".join(map(decimal.__getitem__, ids))).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
