"""Near copies by word shingles: MinHash candidates, exact Jaccard check.

A text is the set of its runs of SHINGLE words, ASCII letters lower-cased. Texts
whose sets have a Jaccard similarity of at least SIMILAR (a fraction, compared in
whole numbers) are linked, and linked documents form components.

Candidates share a band of ROWS of the BANDS * ROWS minima that a text's
shingles have under as many hash functions. A pair at just the threshold is
missed with probability (1 - 0.8^6)^40 = 5e-6, more similar ones less. Every link is
checked on the sets themselves. SimHash fingerprints of the sets bring candidates,
too, where a caller gives the way to link them: a set is held against those of its
own fingerprint and of the smallest and the largest one linked to it. Alone they
wouldn't do: near copies at this threshold differ in up to a dozen bits.

In a band's bucket everything is first held against the bucket's smallest and
largest members. Members that these links put into one component need no further
comparison. What is left of a bucket of up to CROWD members is compared pair by
pair. Larger buckets that share members form a crowd, which is dealt into blocks
of BLOCK members (fewer where texts are long), those of one component together.
Two blocks at a time are compared inside a task, unless both hold one and the
same component, and only links that join components leave it. So no task holds
more than two blocks and no pairs are emitted; the work in a crowd is its size
times the number of its members that are alike but not similar.

Defined cases: null texts and texts without a word have the empty set and are
alike; a text of fewer than SHINGLE words has its whole sequence as its one
shingle; equal sets are one vertex; rows without a doc_id take part but never
name a component; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators.graph import connected_components
from plinth.operators.ranking import running_total
from plinth.storage import broadcast_within, checkpoint, compact, release, row_count

SHINGLE = 5
SIMILAR = (4, 5)
BANDS, ROWS = 40, 6
SEED = 42
CROWD, BLOCK = 48, 512
COLUMNS = 4096
BROADCAST_ROWS = 200_000
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_CHUNK = 2048


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    w = np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in words), np.uint64, len(words))
    n = len(words) - SHINGLE + 1
    h = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k : k + n]
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(h ^ h >> np.uint64(31))


@cache
def _functions() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    x, a = rng.integers(0, 1 << 32, (2, BANDS * ROWS, 1), np.uint32)
    return x, a | np.uint32(1)


def bands(held: np.ndarray) -> list[int]:
    """The buckets of a set of shingles, signed; none for the empty set."""
    if not len(held):
        return []
    x, a = _functions()
    short = (held >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), _CHUNK):
        v = (short[at : at + _CHUNK] ^ x) * a
        v ^= v >> np.uint32(16)
        v *= np.uint32(0x85EBCA6B)
        least = np.minimum(least, v.min(axis=1))
    keys = [xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def fingerprint(held: np.ndarray) -> int:
    """The SimHash of a set of shingles: each bit that over half of them have; 0 for the empty set."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(held), _CHUNK):
        ones += np.unpackbits(held[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(held), bitorder="little").view(np.uint64)[0])


def _sid(held: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(held.tobytes(), SEED)


def _sketches(batches):
    for b in batches:
        sets = [shingles(x.as_py()) for x in b.column("text")]
        sid = np.fromiter(map(_sid, sets), np.uint64, len(sets)).view(np.int64)
        n = pa.array([len(s) for s in sets], pa.int32())
        fp = np.fromiter(map(fingerprint, sets), np.uint64, len(sets)).view(np.int64)
        columns = [b.column("doc_id"), b.column("th"), pa.array(sid), n, pa.array(fp), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "sid", "n", "fp", "bands"])


def _sets(batches):
    for b in batches:
        sets = [shingles(x.as_py()) for x in b.column("text")]
        sid = np.fromiter(map(_sid, sets), np.uint64, len(sets)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(sid), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["sid", "held"])


def _held(sids: DataFrame, own: DataFrame, texts: DataFrame) -> DataFrame:
    """sid and held (the set) of the distinct sids."""
    ends = checkpoint(sids.distinct().join(own.select("sid", "th"), "sid").select("th"))
    rows = texts.join(broadcast_within(compact(ends), row_count(ends), BROADCAST_ROWS), "th", "left_semi").groupBy("th").agg(F.min("text").alias("text"))
    out = checkpoint(rows.mapInArrow(_sets, "sid long, held array<bigint>"))
    release(ends)
    return out


def _similar(pairs: DataFrame, own: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (src, dst) of sets that are similar; ``pairs`` is checkpointed."""
    pairs = compact(pairs)
    sets = _held(pairs.select(F.explode(F.array("src", "dst")).alias("sid")), own, texts)
    a, b = (compact(sets).select(F.col("sid").alias(end), F.col("held").alias(f"{end}_held")) for end in ("src", "dst"))
    common, both = F.size(F.array_intersect("src_held", "dst_held")), F.size("src_held") + F.size("dst_held")
    out = checkpoint(pairs.join(a, "src").join(b, "dst").where(common * sum(SIMILAR) >= both * SIMILAR[0]).select("src", "dst"))
    release(sets)
    return out


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set on the left has in common with each on the right."""
    sizes = [np.array([len(x) for x in side], np.int64) for side in (left, right)]
    who = [np.repeat(np.arange(len(n)), n) for n in sizes]
    _, at = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    at = [at[: len(who[0])], at[len(who[0]) :]]
    shared = np.flatnonzero(np.isin(np.arange(max((x.max(initial=-1) for x in at), default=-1) + 1), np.intersect1d(*at)))
    out = np.zeros((len(left), len(right)), np.int64)
    for start in range(0, len(shared), COLUMNS):
        some = shared[start : start + COLUMNS]
        grids = []
        for rows, columns, n in zip(who, at, sizes, strict=True):
            place = np.searchsorted(some, columns)
            held = (place < len(some)) & (some[np.minimum(place, len(some) - 1)] == columns)
            grid = np.zeros((len(n), len(some)), np.float32)
            grid[rows[held], place[held]] = 1
            grids.append(grid)
        out += (grids[0] @ grids[1].T).astype(np.int64)
    return out


def _joining(left: list[tuple], right: list[tuple]) -> list[tuple[int, int]]:
    """Links between members (sid, part, set) of two blocks that join their parts: a forest, not all links."""
    common = _common([m[2] for m in left], [m[2] for m in right])
    sizes = [np.array([len(m[2]) for m in side], np.int64) for side in (left, right)]
    parts = [np.array([m[1] for m in side]) for side in (left, right)]
    low, high = SIMILAR
    near = (common * (low + high) >= (sizes[0][:, None] + sizes[1][None, :]) * low) & (parts[0][:, None] != parts[1][None, :])
    i, j = np.nonzero(near)
    _, first = np.unique(np.stack([parts[0][i], parts[1][j]]), axis=1, return_index=True)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    out = []
    for k in first.tolist():
        a, b = find(int(parts[0][i[k]])), find(int(parts[1][j[k]]))
        if a != b:
            root[a] = b
            out.append((left[i[k]][0], right[j[k]][0]))
    return out


def _meetings(batches):
    """Streams rows of one (crowd, a, b) after another: members of block a (side 0), then those of block b (side 1; none if it is a itself)."""
    now, sides = None, ([], [])

    def links():
        found = _joining(sides[0], sides[1] or sides[0]) if sides[0] else []
        src, dst = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(src, dst)), pa.array(np.maximum(src, dst))], ["src", "dst"])

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("crowd", "a", "b")), strict=True))
        for key, side, sid, part, held in zip(keys, batch.column("side").to_pylist(), batch.column("sid").to_pylist(), batch.column("part").to_pylist(), batch.column("held"), strict=True):
            if key != now:
                yield links()
                now, sides = key, ([], [])
            sides[side].append((sid, part, held.values.to_numpy()))
    yield links()


def _crowded(part: DataFrame, own: DataFrame, texts: DataFrame) -> DataFrame:
    """Links that join the parts of crowded buckets' members; ``part`` holds bucket, low (its smallest sid), sid, n and part."""
    crowds = connected_components(part.where("sid <> low").select(F.col("low").alias("src"), F.col("sid").alias("dst")).distinct()).withColumnRenamed("component", "crowd")
    members = checkpoint(part.select("sid", "n", "part").distinct().join(crowds, F.col("sid") == F.col("vertex")).select("crowd", "part", "sid", F.greatest("n", F.lit(BLOCK)).alias("w")))
    placed = running_total(compact(members), [F.col("crowd"), F.col("part"), F.col("sid")], {"before": "w"})
    base = placed.groupBy("crowd").agg(F.min("before").alias("base"))
    dealt = checkpoint(placed.join(base, "crowd").select("crowd", "part", "sid", F.floor((F.col("before") - F.col("base")) / (BLOCK * BLOCK)).alias("block")))
    blocks = checkpoint(compact(dealt).groupBy("crowd", "block").agg(F.min("part").alias("p"), F.max("part").alias("q")))
    x, y = compact(blocks).alias("x"), compact(blocks).alias("y")
    meet = x.join(y, F.expr("x.crowd = y.crowd AND x.block <= y.block AND NOT (x.p = x.q AND y.p = y.q AND x.p = y.p)"))
    meet = checkpoint(meet.select(F.col("x.crowd").alias("crowd"), F.col("x.block").alias("a"), F.col("y.block").alias("b")))
    sets = _held(members.select("sid"), own, texts)
    rows = compact(dealt).join(compact(sets), "sid")
    sides = [rows.join(compact(meet).withColumn("block", F.col(c)).where("a <> b OR block = a" if c == "a" else "a <> b"), ["crowd", "block"]).select("crowd", "a", "b", F.lit(k).alias("side"), "sid", "part", "held") for k, c in enumerate("ab")]
    parts = int(part.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = sides[0].unionByName(sides[1]).repartition(parts, "crowd", "a", "b").sortWithinPartitions("crowd", "a", "b", "side")
    out = checkpoint(both.mapInArrow(_meetings, "src long, dst long"))
    release(members, dealt, blocks, meet, sets)
    return out


def _by_fingerprint(own: DataFrame, by) -> DataFrame:
    """Candidates (src, dst) from fingerprints: two a set at most, the pairs that ``by`` links being the sets of smallest sid of each."""
    fps = checkpoint(own.where("n > 0").groupBy("fp").agg(F.min("sid").alias("low")))
    near = by(fps)
    near = near.unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).groupBy("src").agg(F.min("dst").alias("a"), F.max("dst").alias("b"))
    ends = near.select(F.col("src").alias("fp"), F.explode(F.array("a", "b")).alias("other")).join(fps, "fp")
    ends = ends.join(fps.select(F.col("fp").alias("other"), F.col("low").alias("sid")), "other").select("low", "sid")
    same = own.select("sid", "fp").join(fps, "fp").where("sid <> low").select("low", "sid")
    return same.unionByName(ends).select(F.least("low", "sid").alias("src"), F.greatest("low", "sid").alias("dst"))


def links(own: DataFrame, texts: DataFrame, by=None) -> DataFrame:
    """Links (src, dst) that join all similar sets into their components; ``own`` holds each set's sid, n, fp, bands and th once.

    ``by`` links fingerprints (a frame with column fp, once each), whose sets are candidates beside those of bands.
    """
    low, high = SIMILAR
    rows = own.select("sid", "n", F.explode("bands").alias("bucket"))
    ends = rows.groupBy("bucket").agg(F.min("sid").alias("low"), F.max("sid").alias("high"), F.count(F.lit(1)).alias("size")).where("low < high")
    crowd = checkpoint(rows.join(ends, "bucket"))
    first = compact(crowd).select("sid", F.explode(F.array("low", "high")).alias("end")).where("sid <> end")
    first = first.select(F.least("sid", "end").alias("src"), F.greatest("sid", "end").alias("dst"))
    first = checkpoint((first.unionByName(_by_fingerprint(own, by)) if by else first).distinct())
    found = compact(_similar(first, own, texts))
    known = connected_components(found).withColumnRenamed("vertex", "sid")
    all_ = checkpoint(compact(crowd).join(known, "sid", "left").select("bucket", "low", "size", "sid", "n", F.coalesce("component", "sid").alias("part")))
    release(crowd)
    all_ = compact(all_)
    mixed = all_.groupBy("bucket").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("bucket")
    part = checkpoint(all_.join(mixed, "bucket", "left_semi"))
    release(all_)
    few, many = (compact(part).where(f) for f in (F.col("size") <= CROWD, F.col("size") > CROWD))
    x, y = few.alias("x"), few.alias("y")
    apart = f"x.sid < y.sid AND x.part <> y.part AND least(x.n, y.n) * {high} >= greatest(x.n, y.n) * {low}"
    rest = x.join(y, F.expr(f"x.bucket = y.bucket AND {apart}")).select(F.col("x.sid").alias("src"), F.col("y.sid").alias("dst")).distinct()
    rest = checkpoint(rest.join(first, ["src", "dst"], "left_anti"))
    found = found.unionByName(_similar(rest, own, texts))
    if not many.isEmpty():
        found = found.unionByName(_crowded(many, own, texts))
    release(first, rest, part)
    return found


def components(docs: DataFrame, by=None) -> DataFrame:
    """doc_id, th (hash of the text), component and component_id (smallest doc_id reachable) of every row; ``by`` as for ``links``."""
    texts = docs.select("text", F.expr("xxhash64(text) AS th"))
    rows = docs.select("doc_id", "text", F.expr("xxhash64(text) AS th"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    found = checkpoint(rows.mapInArrow(_sketches, f"doc_id {kind}, th long, sid long, n int, fp long, bands array<bigint>"))
    own = checkpoint(found.groupBy("sid", "n", "fp", "bands").agg(F.min("doc_id").alias("least"), F.min("th").alias("th")))
    linked = connected_components(links(own, texts, by)).withColumnRenamed("vertex", "sid")
    names = own.select("sid", "least").join(linked, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    named = names.groupBy("component").agg(F.min("least").alias("component_id"))
    # Staged, so that the join is plain and may be split where one set has many documents.
    names = checkpoint(names.join(named, "component").select("sid", "component", "component_id"))
    return found.select("doc_id", "th", "sid").join(names, "sid").select("doc_id", "th", "component", "component_id")
