"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The library turns spaces into ``▁`` (one more goes in front of a text) and joins
neighbouring symbols, at first single characters, into pieces of the vocabulary:
the pair of the best piece first, of equals the leftmost, until no pair makes a
piece. A character that is no piece becomes its bytes.

Here a batch's distinct words are one flat NumPy array of symbols, and a round
joins many pairs at once. A table, made from the vocabulary alone, gives for two
neighbouring symbols

- ``rank``: the rank of the piece that they make (NONE if they make none), and
- ``reach``: the best rank of any piece that holds the two side by side. Every
  join to come over their boundary makes such a piece, so none is better.

Two symbols that stand side by side in no piece are never joined: their boundary
cuts the word into segments. Within a segment a pair may be joined at once if its
rank beats the reach of the boundaries to its left and right, since nothing that
happens later can take either symbol away from it before its turn. A tie on the
right is fine, since the pair on the left goes first. So a run of equal pairs is
joined two by two from its left end, if its rank belongs to one piece alone. A
segment without such a pair joins its leftmost pair of minimum rank, which is what
the sequential rule does first; if several pieces share that rank, as those of
spaces do, order is all that decides, and a heap finishes the segment. Segments
without a pair that makes a piece leave the array. So rounds follow the length of
pieces and hardly that of words, and all results are those of the sequential rule.

Words are cut before ``▁`` where no piece has one after another character, and
around ASCII characters that stand in no longer piece. They recur, so most are
merged once per worker, in a cache bounded by entries and bytes.

The model file is a parameter. It must be a BPE model with byte fallback and a
dummy prefix, without normalisation, removal of spaces, user-defined or unused
pieces, as ``piece_bpe_32k.model`` is, else ValueError.

Defined cases: null and empty texts have no ids and decode to the empty text; the
names of control pieces in a text are ordinary text; decoding gives nothing for
control ids, `` ⁇ `` for the unknown id and U+FFFD for every byte that is no
UTF-8; whole texts are encoded whatever their length; rows are independent, so
repeated rows and ties change nothing; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import codecs
import hashlib
import re
from functools import lru_cache
from heapq import heappop, heappush
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
#: Rows, and characters of new words, that a worker holds at a time.
ROWS, CHARS = 500, 1 << 18
#: Most words of the cache, most bytes of it, and the longest word it takes.
CACHE, CACHE_BYTES, LONGEST = 400_000, 96 << 20, 64
_ENTRY = 200
NONE = np.int32(2**31 - 1)

# The types of pieces in the model file.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2


def _lost_bytes(error: UnicodeDecodeError):
    return "�" * (error.end - error.start), error.end


codecs.register_error("plinth-lost-bytes", _lost_bytes)


class PairTable:
    """Rank, reach and joined piece of every two symbols that stand side by side in a piece."""

    def __init__(self, ids: dict[str, int], rank: dict[str, int], base: int):
        reach: dict[str, int] = {}
        for piece, r in rank.items():
            for i in range(len(piece) - 1):
                for j in range(i + 2, len(piece) + 1):
                    part = piece[i:j]
                    if reach.get(part, NONE) > r:
                        reach[part] = r
        found = [
            (ids[part[:k]] * base + ids[part[k:]], rank.get(part, NONE), best, ids.get(part, -1))
            for part, best in reach.items()
            for k in range(1, len(part))
            if part[:k] in ids and part[k:] in ids
        ]
        table = np.array(sorted(found), np.int64).reshape(-1, 4)
        self.base = base
        self.keys = np.append(table[:, 0], np.iinfo(np.int64).max)
        self.rank, self.reach, self.joined = (np.append(table[:, c], NONE).astype(np.int32) for c in (1, 2, 3))

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Key, rank, reach and joined piece of pairs; NONE where they stand in no piece."""
        key = left * self.base + right
        at = np.searchsorted(self.keys, key)
        at[self.keys[at] != key] = len(self.keys) - 1
        return key, self.rank[at], self.reach[at], self.joined[at]


class SentencePieces:
    """Encoder and decoder of one model file."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, kinds = spec.normalizer_spec, {p.type for p in spec.pieces}
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not norm.precompiled_charsmap
        if spec.trainer_spec.model_type != BPE or not spec.trainer_spec.byte_fallback or spec.trainer_spec.treat_whitespace_as_suffix or not plain or not kinds <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path} isn't a BPE model with byte fallback and a dummy prefix, without normalisation or pieces of the user's")
        scores = {p.piece: p.score for p in spec.pieces if p.type == NORMAL}
        ids = {p.piece: k for k, p in enumerate(spec.pieces) if p.type == NORMAL}
        order = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        rank = {p: order[s] for p, s in scores.items()}
        self.size = len(spec.pieces)
        self.table = PairTable(ids, rank, self.size + 1)
        held = np.bincount(np.array([*rank.values()], np.int64), minlength=1)
        #: Whether a rank belongs to several pieces.
        self.shared = held > 1
        self.bytes_at = np.zeros(256, np.int64)
        self.symbol = np.full(0x110000, self.size, np.int32)  # what is no piece has the symbol ``size``
        names = []
        for k, p in enumerate(spec.pieces):
            if p.type == BYTE:
                byte = int(p.piece[3:5], 16)
                self.bytes_at[byte] = k
                names.append(bytes([byte]))
            else:
                names.append(b"" if p.type == CONTROL else spec.trainer_spec.unk_surface.encode() if p.type == UNKNOWN else p.piece.replace(SPACE, " ").encode())
                if p.type == NORMAL and len(p.piece) == 1:
                    self.symbol[ord(p.piece)] = k
        self.names = names
        self.controls = {k for k, p in enumerate(spec.pieces) if p.type == CONTROL}
        self.spaced = {k for p, k in ids.items() if p.startswith(SPACE)}
        self.words = self._cutter([p for p in ids if len(p) > 1])
        self._cache: dict[str, bytes] = {}
        self._held = 0
        self._pairs: dict[tuple[int, int], tuple[int, int]] = {}

    @staticmethod
    def _cutter(longer: list[str]):
        """A function that cuts a text (with its ``▁``) into words that no piece spans."""
        if any(a != SPACE == b for p in longer for a, b in zip(p, p[1:], strict=False)):
            return lambda text: [text]
        inside = set().union(*longer)
        alone = "".join(re.escape(chr(c)) for c in range(128) if chr(c) not in inside)
        return re.compile(f"[{alone}]|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+").findall if alone else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall

    def _chosen(self, key, rank, reach) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of neighbours that a round joins (rank and reach are NONE over a cut), and the first pairs of segments to finish in order."""
        n = len(key)
        before, after = np.append(NONE, reach[:-1]), np.append(reach[1:], NONE)
        makes = rank != NONE
        shared = self.shared[np.where(makes, rank, 0)]
        # Runs of equal pairs: the place of a run's first pair, and whether that may be joined.
        first = np.append(True, (key[1:] != key[:-1]) | (reach[1:] == NONE) | (reach[:-1] == NONE))
        start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        offset = np.arange(n) - start
        in_run = ~shared & (reach == rank) & (offset % 2 == 0)
        chosen = makes & (rank < before)[start] & (rank <= after) & ((offset == 0) | in_run)
        # Segments without one: their leftmost pair of minimum rank.
        live = reach != NONE
        heads = np.flatnonzero(live & ~np.append(False, live[:-1]))
        if not len(heads):
            return chosen, heads
        none_yet = np.add.reduceat(chosen, heads, dtype=np.int64) == 0
        least = np.minimum.reduceat(rank, heads)
        none_yet &= least != NONE
        in_order = none_yet & self.shared[np.where(none_yet, least, 0)]
        none_yet &= ~in_order
        if none_yet.any():
            segment = np.repeat(np.arange(len(heads)), np.append(heads[1:], n) - heads)
            lowest = np.flatnonzero((rank[heads[0] :] == least[segment]) & none_yet[segment])
            _, leftmost = np.unique(segment[lowest], return_index=True)
            chosen[heads[0] + lowest[leftmost]] = True
        return chosen, heads[in_order]

    def _pair(self, left: int, right: int) -> tuple[int, int]:
        """Rank and joined piece of one pair."""
        found = self._pairs.get((left, right))
        if found is None:
            _, rank, _, joined = self.table.look_up(np.array([left]), np.array([right]))
            found = self._pairs[left, right] = (int(rank[0]), int(joined[0]))
        return found

    def _in_order(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """Places and symbols of what is left of a segment when its pairs are joined one after another."""
        n = len(symbols)
        onward, back = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            rank, _ = self._pair(symbols[i], symbols[j])
            if rank != NONE:
                heappush(heap, (rank, i, symbols[i], symbols[j]))

        for k in range(n - 1):
            offer(k, k + 1)
        while heap:
            _, i, left, right = heappop(heap)
            j = onward[i]
            if symbols[i] != left or j == n or symbols[j] != right:
                continue
            symbols[i], symbols[j] = self._pair(left, right)[1], -1
            onward[i] = onward[j]
            if onward[i] < n:
                back[onward[i]] = i
                offer(i, onward[i])
            if back[i] >= 0:
                offer(back[i], i)
        places = [k for k in range(n) if symbols[k] >= 0]
        return places, [symbols[k] for k in places]

    def merge(self, words: list[str]) -> list[bytes]:
        """The ids of words, each as little-endian 32-bit integers."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        lengths = [len(w) for w in words]
        at, symbol, segment = np.arange(len(chars)), self.symbol[chars].astype(np.int64), np.repeat(np.arange(len(words)), lengths)
        done = [(at[:0], symbol[:0])]
        while len(symbol):
            key, rank, reach, joined = self.table.look_up(symbol[:-1], symbol[1:])
            over = segment[:-1] != segment[1:]
            rank[over] = reach[over] = NONE
            # Cuts stay cuts, so they part segments for good; one in which no pair makes a piece is finished.
            segment = np.append(0, np.cumsum(reach == NONE))
            works = np.zeros(segment[-1] + 1, bool)
            works[segment[:-1][rank != NONE]] = True
            stays = works[segment]
            done.append((at[~stays], symbol[~stays]))
            chosen, in_order = self._chosen(key, rank, reach)
            for k in in_order.tolist():
                i, j = np.searchsorted(segment, (segment[k], segment[k] + 1))
                places, left = self._in_order(symbol[i:j].tolist())
                done.append((at[i:j][places], np.array(left, np.int64)))
                stays[i:j] = False
            chosen = np.flatnonzero(chosen)
            symbol[chosen] = joined[chosen]
            stays[chosen + 1] = False
            at, symbol, segment = at[stays], symbol[stays], segment[stays]
        at, symbol = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(at)
        return self._with_bytes(at[order], symbol[order], chars, np.cumsum([0, *lengths]))

    def _with_bytes(self, at, symbol, chars, starts) -> list[bytes]:
        """Symbols by the words' starts, with those that are no piece written as the bytes of their character."""
        lost = symbol == self.size
        code = chars[at[lost]]
        times = np.ones(len(symbol), np.int64)
        times[lost] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        out = np.repeat(symbol, times)
        if lost.any():
            raw = np.frombuffer(b"".join(chr(c).encode("utf-8", "surrogatepass") for c in code), np.uint8)
            out[np.repeat(lost, times)] = self.bytes_at[raw]
        ends = np.append(0, np.cumsum(times))[np.searchsorted(at, starts)] * 4
        data = out.astype("<i4").tobytes()
        return [data[i:j] for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def _merge_all(self, words: list[str]):
        """``merge`` in blocks of about CHARS characters."""
        block, held = [], 0
        for w in words:
            block.append(w)
            held += len(w)
            if held >= CHARS:
                yield from zip(block, self.merge(block), strict=True)
                block, held = [], 0
        if block:
            yield from zip(block, self.merge(block), strict=True)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of texts, each as little-endian 32-bit integers."""
        cut = [self.words(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        wanted = set().union(*cut)
        missing = wanted - self._cache.keys()
        if len(self._cache) + len(missing) > CACHE or self._held > CACHE_BYTES:
            self._cache.clear()
            self._held, missing = 0, wanted
        found = dict(self._merge_all(list(missing)))
        self._cache |= found
        out = [b"".join(map(self._cache.__getitem__, words)) for words in cut]
        for w, ids in found.items():
            if len(w) > LONGEST:
                del self._cache[w]
            else:
                self._held += _ENTRY + 4 * len(w) + len(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of ids."""
        if not self.controls.isdisjoint(ids):  # they part bytes, too
            runs = [b"".join(map(self.names.__getitem__, run)) for _, run in groupby(ids, self.controls.__contains__)]
        else:
            runs = [b"".join(map(self.names.__getitem__, ids))]
        first = next(filter(self.names.__getitem__, ids), None)
        if first in self.spaced:  # the space that encoding puts in front
            at = next(k for k, run in enumerate(runs) if run)
            runs[at] = runs[at][1:]
        return "".join(run.decode("utf-8", "plinth-lost-bytes") for run in runs)


@lru_cache(maxsize=2)
def worker_pieces(path: str) -> SentencePieces:
    """One encoder a worker process."""
    return SentencePieces(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _slices(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _doc_type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (array of int) of every row."""

    def run(batches):
        pieces = worker_pieces(path or default_path())
        for b in _slices(batches):
            found = pieces.encode(b.column("text").to_pylist())
            ends = np.cumsum([0, *(len(x) // 4 for x in found)])
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(found), "<i4")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(ends)), lists], ["doc_id", "n_tokens", "ids"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {_doc_type(rows)}, n_tokens long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text (as decoded) of every row of (doc_id, ids); null ids decode to the empty text."""

    def run(batches):
        pieces = worker_pieces(path or default_path())
        for b in _slices(batches):
            texts = [pieces.decode(x or []) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {_doc_type(rows)}, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: what encoding and decoding give, without carrying it."""

    def run(batches):
        pieces = worker_pieces(path or default_path())
        decimal = [str(k).encode() for k in range(pieces.size)]
        for b in _slices(batches):
            n, of_ids, of_text = [], [], []
            for data in pieces.encode(b.column("text").to_pylist()):
                ids = np.frombuffer(data, "<i4").tolist()
                n.append(len(ids))
                of_ids.append(hashlib.sha256(b",".join(map(decimal.__getitem__, ids))).hexdigest())
                of_text.append(hashlib.sha256(pieces.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {_doc_type(rows)}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
