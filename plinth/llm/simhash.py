"""SimHash near-duplicates by anchor-point covering.

Each text gets a 64-bit fingerprint: ASCII letters lower-cased, words taken,
every run of three words hashed (XXH64, seed 42), and each bit set that more
than half of the hashes have set. Fingerprints that differ in at most two bits
are linked, and linked documents form components.

Pairs are found at anchors. The anchors are the words of a covering code: two
blocks of 23 bits, each covered by the binary Golay code, whose words lie within
3 bits of everything. Beyond MANY distinct fingerprints, where its 2^24 anchors
would crowd, two more blocks take the other 18 bits in: one of 15 bits covered by
the Hamming code (radius 1) and one of 3 bits, every word of which is an anchor;
that makes 2^38. A fingerprint's home is the anchor nearest to it, block by
block. It is also replicated to every anchor that can be the home of a
fingerprint within the threshold, all of which lie within covering radius plus
threshold. So of two linked fingerprints the one surely visits the other's home,
and each home compares its own fingerprints with its visitors only. Replication
is at most a constant per distinct fingerprint (61 anchors on average, with all
four blocks 205); a fingerprint has at most 2,080 others within two bits, so
links grow with the input.

Exact copies share a fingerprint and are one vertex. Visitors meet homes in a
join that may be split where an anchor is crowded.

Defined cases: null and empty texts, and texts of white space only, have
fingerprint zero, linked like any other; texts of one or two words hash their
whole sequence; rows that repeat are one vertex; rows without a doc_id take part
but never name a component (component_id is null where no row of it has one); an
empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm import near_copies
from plinth.operators.graph import connected_components
from plinth.storage import checkpoint, row_count

SHINGLE = 3
SEED = 42
THRESHOLD = 2
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 1 << 15

#: Blocks of a fingerprint: first bit, bits, check bits, generator polynomial of the code (degree: check bits), covering radius.
#: Golay code: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1. Hamming code: x^4 + x + 1. Three bits without a code.
GOLAY = [(0, 23, 11, 0b101011100011, 3), (23, 23, 11, 0b101011100011, 3)]
MORE = [(46, 15, 4, 0b10011, 1), (61, 3, 0, 1, 0)]
#: Distinct fingerprints from which on all blocks are taken.
MANY = 1 << 25


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit fingerprint of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        part = words[at : min(at + _CHUNK, n) + SHINGLE - 1]
        runs = map(b" ".join, zip(*(part[k:] for k in range(SHINGLE)), strict=False)) if len(words) >= SHINGLE else [b" ".join(words)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in runs), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << int(k) for k in np.flatnonzero(2 * ones > n)))


def _fingerprints(batches):
    for b in batches:
        out = np.fromiter((fingerprint(x.as_py()) for x in b.column("text")), np.uint64, b.num_rows).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out)], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(_fingerprints, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _syndromes(words: np.ndarray, block: tuple) -> np.ndarray:
    """Remainders of a block's words by the generator."""
    _, bits, checks, generator, _ = block
    words = words.copy()
    for k in range(bits - 1, checks - 1, -1):
        if checks:
            words ^= np.where(words >> k & 1, generator << (k - checks), 0)
    return words if checks else np.zeros_like(words)


@cache
def _tables(block: tuple = GOLAY[0]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """By syndrome: the error to the nearest code word; and, relative to that word, the words that one and that two changed bits lead to."""
    _, bits, checks, _, radius = block
    errors = np.array([sum(1 << k for k in c) for w in range(radius + 1) for c in combinations(range(bits), w)], np.int64)
    nearest = np.empty(1 << checks, np.int64)
    nearest[_syndromes(errors, block)] = errors
    one = np.array([1 << k for k in range(bits)], np.int64)
    two = np.array([sum(1 << k for k in c) for c in combinations(range(bits), 2)], np.int64)
    syn1, syn2 = _syndromes(one, block), _syndromes(two, block)
    reach = []
    for s in range(1 << checks):
        by1 = np.setdiff1d((nearest[s] ^ one ^ nearest[s ^ syn1]) >> checks, [0])
        by2 = np.setdiff1d((nearest[s] ^ two ^ nearest[s ^ syn2]) >> checks, np.append(by1, 0))
        reach.append((by1, by2))
    return nearest, reach


def _offsets(reach: list[tuple[np.ndarray, np.ndarray]], at: list[int]) -> np.ndarray:
    """What to xor into a home's anchor id to get every anchor to visit; ``reach`` by block, whose part of an id starts at ``at``."""
    ones = [one << k for (one, _), k in zip(reach, at, strict=True)]
    twos = [two << k for (_, two), k in zip(reach, at, strict=True)]
    return np.concatenate([[0], *ones, *twos, *((a[:, None] | b).ravel() for a, b in combinations(ones, 2))])


def anchors(fps: np.ndarray, more: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(home anchor of each fingerprint; anchors that are visited; index of the fingerprint that visits). ``more``: by all blocks."""
    home, at, reach, start = np.zeros(len(fps), np.int64), [], [], 0
    for block in GOLAY + MORE if more else GOLAY:
        first, bits, checks, _, _ = block
        nearest, table = _tables(block)
        words = (fps >> np.uint64(first) & np.uint64((1 << bits) - 1)).astype(np.int64)
        syndromes = _syndromes(words, block)
        home |= (words ^ nearest[syndromes]) >> checks << start
        reach.append([table[s] for s in syndromes.tolist()])
        at.append(start)
        start += bits - checks
    offsets = [_offsets(r, at) for r in zip(*reach, strict=True)]
    sizes = np.fromiter(map(len, offsets), np.int64, len(offsets))
    who = np.repeat(np.arange(len(fps)), sizes)
    return home, home[who] ^ np.concatenate(offsets) if len(fps) else home, who


def _homes(more: bool):
    def run(batches):
        for b in batches:
            fp = b.column("fp").to_numpy()
            home, _, _ = anchors(fp.view(np.uint64), more)
            yield pa.RecordBatch.from_arrays([pa.array(home), pa.array(fp)], ["anchor", "fp"])

    return run


def _visits(more: bool):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                fp = b.column("fp").slice(at, 2000).to_numpy()
                _, to, who = anchors(fp.view(np.uint64), more)
                yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(fp[who])], ["anchor", "other"])

    return run


def links(fps: DataFrame, many: int = MANY) -> DataFrame:
    """Pairs (src, dst) of distinct fingerprints within the threshold; ``fps`` holds each once, in column fp."""
    more = row_count(fps) > many
    homes = fps.select("fp").mapInArrow(_homes(more), "anchor long, fp long").hint("shuffle_hash")
    visits = fps.select("fp").mapInArrow(_visits(more), "anchor long, other long")
    near = (F.col("fp") < F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= THRESHOLD)
    return visits.join(homes, "anchor").where(near).select(F.col("fp").alias("src"), F.col("other").alias("dst"))


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable) of every row."""
    fps = checkpoint(fingerprints(docs))
    own = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    linked = connected_components(links(own)).withColumnRenamed("vertex", "fp")
    linked = linked.join(own, "fp")
    named = linked.groupBy("component").agg(F.min("least").alias("component_id"))
    names = linked.select("fp", "component").join(named, "component").select("fp", "component_id")
    names = own.alias("o").join(names.alias("n"), "fp", "left").select("fp", F.coalesce("n.component_id", "o.least").alias("component_id"))
    # Staged, so that the join is plain and may be split where one fingerprint has many documents.
    return fps.join(checkpoint(names), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component of near copies (the smallest doc_id), with the columns it came with.

    The stage takes near_copies' five-word shingles at Jaccard 0.8, SHINGLE above is op2's alone. SimHash fingerprints of
    those shingles are linked by the covering code, as op2's are, and checked exactly; MinHash bands find the similar
    texts whose fingerprints lie further apart.
    Rows without a doc_id stay. Rows are told apart by doc_id and text: of each component one row stays, that of the
    smallest doc_id and, where this doc_id stands on several of its texts, of the smallest hash.
    """
    found = near_copies.components(docs, links).where("doc_id IS NOT NULL").groupBy("component", "doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    found = checkpoint(found)
    named = checkpoint(found.groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("named")))
    one = F.struct("doc_id", "th") == F.col("named")
    gone = found.join(named, "component").select("doc_id", "th", "n", one.alias("one")).where("NOT one OR n > 1")
    rows = docs.select(F.struct("*").alias("__row"), "doc_id", F.expr("xxhash64(text) AS th")).alias("d").join(gone.hint("shuffle_hash").alias("g"), ["doc_id", "th"], "left")
    stay = rows.where("g.one IS NULL").select("__row.*")
    if not gone.where("one").isEmpty():
        again = rows.where("g.one").groupBy("doc_id", "th").agg(F.min_by("__row", F.struct("__row.text")).alias("__row"))
        stay = stay.unionByName(again.select("__row.*"))
    return stay


def query(spark, sf_dir: str) -> DataFrame:
    found = components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
