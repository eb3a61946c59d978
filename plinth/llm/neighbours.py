"""Approximate nearest neighbours by stable projections and kd-trees.

Vectors are scaled to unit length, where a larger cosine is a smaller Euclidean
distance, and projected to WIDE dimensions by Gaussian (2-stable) directions, of
which the first DIMS span the kd-trees. Over true distance squared, a projected
distance squared in m dimensions follows the chi-square distribution with m
degrees of freedom. A query takes the tree's leaves in order of projected
distance. It stops at a leaf's box when a vector as near as its K-th best so far
would, with probability SURE, already have shown up in DIMS dimensions; of a
leaf's vectors it verifies those whose projection in WIDE dimensions is not
farther than that of a vector as near as its K-th best would be with probability
WIDE_SURE. All others are passed over without a look at the whole vector.

Boxes prune where vectors cluster; the wide test prunes anywhere, and ever more
as neighbours grow nearer with the number of vectors. (Isotropic vectors of 64
dimensions: see the README for vectors verified a query by size.)

The projected space is cut by the upper levels of a kd-tree into cells, fitted
on at most SAMPLE vectors (of the smallest hashes); every vector is indexed in
its cell. A query first searches its own cell. The stopping test with the
distance to a cell's box then tells which other cells it must visit. Cells that
outgrow a task are dealt over slices, all of which a visit searches; cells
visited often are searched in blocks of VISITS visits. So neither a cell's
vectors nor its queries ever meet in one task beyond a set number.

Equal vectors are indexed once, with their K + 1 smallest vec_ids: no query can
need more of them, since ties go to the smaller vec_id. Equal queries are
searched once.

Defined cases: vectors that are null, zero or of the wrong length, that hold null
or non-finite components, or that have no vec_id take no part (the right length
is the commonest, of equally common ones the shortest); rows that repeat are one;
a query with fewer than K candidates gets them all; an empty table gives an empty
result. Components are read in the table's own precision and all sums are double.
"""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.storage import checkpoint, row_count

K = 5
DIMS = 8
SURE = 0.97
WIDE = 32
WIDE_SURE = 0.9
SEED = 7
SAMPLE = 50_000
CELL_ROWS = 20_000
MOST_CELLS = 1 << 16
LEAF = 64
VISITS = 20_000
#: Distances to boxes, and visits, that a task holds at a time.
BOXES, TAKE = 2_000_000, 20_000
EVERY = 50
#: The least squared distance to search within, above what rounding makes of parallel vectors.
MARGIN = 1e-12


def chi_square(x: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Distribution function of the chi-square distribution with ``dims`` (even) degrees of freedom."""
    half = np.asarray(x, np.float64) / 2
    return 1 - np.exp(-half) * sum(half**k / math.factorial(k) for k in range(dims // 2))


@cache
def stop_ratio(dims: int = DIMS, sure: float = SURE) -> float:
    """Projected over true distance squared at which the stopping test holds."""
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dims) < sure else (low, mid)
    return high


def _directions(width: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((width, WIDE))


def _rows(column: pa.ListArray) -> np.ndarray:
    """A batch's vectors, all of one length, in double precision, each scaled by a power of two so that squares neither vanish nor overflow."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Cells:
    """The upper levels of the kd-tree: split dimension and value by node; leaves are cells."""

    def __init__(self, sample: np.ndarray, n: int):
        self.dims, self.values, self.left = [], [], []
        self.cells = 0
        self._grow(sample, max(1, n))

    def _grow(self, x: np.ndarray, n: int) -> int:
        node = len(self.dims)
        self.dims.append(-1)
        self.values.append(float(self.cells))
        self.left.append((-1, -1))
        spread = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(1)
        if n <= 1 or len(x) < 2 or spread.max() == 0:
            self.cells += 1
            return node
        d = int(spread.argmax())
        cut = float(np.quantile(x[:, d], (n // 2) / n))
        low = x[:, d] < cut
        if not low.any() or low.all():
            self.cells += 1
            return node
        self.dims[node], self.values[node] = d, cut
        self.left[node] = (self._grow(x[low], n // 2), self._grow(x[~low], n - n // 2))
        return node

    def of(self, x: np.ndarray) -> np.ndarray:
        """The cell of each projected vector."""
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, at = todo.pop()
            if self.dims[node] < 0:
                out[at] = int(self.values[node])
            elif len(at):
                low = x[at, self.dims[node]] < self.values[node]
                todo += [(self.left[node][0], at[low]), (self.left[node][1], at[~low])]
        return out


def leaves(x: np.ndarray) -> list[np.ndarray]:
    """The kd-tree's leaves over projected vectors: indexes, at most LEAF in each."""
    out, todo = [], [np.arange(len(x))]
    while todo:
        at = todo.pop()
        if len(at) <= LEAF:
            out.append(at)
            continue
        d = int(np.ptp(x[at], axis=0).argmax())
        mid = len(at) // 2
        order = np.argpartition(x[at, d], mid)
        todo += [at[order[:mid]], at[order[mid:]]]
    return out


def _box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from each query to each box."""
    out = np.zeros((len(q), len(low)))
    for k in range(q.shape[1]):
        gap = np.maximum(0, np.maximum(low[None, :, k] - q[:, None, k], q[:, None, k] - high[None, :, k]))
        out += gap * gap
    return out


class Tree:
    """The lower levels of the kd-tree of one cell. ``verified`` counts the vectors that searches have looked at whole."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, directions: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.directions = directions
        self.projected = (vectors / self.norms[:, None]) @ directions
        narrow = self.projected[:, :DIMS]
        groups = leaves(narrow)
        self.members = np.full((len(groups), LEAF), -1)
        for k, g in enumerate(groups):
            self.members[k, : len(g)] = g
        self.low = np.stack([narrow[g].min(axis=0) for g in groups])
        self.high = np.stack([narrow[g].max(axis=0) for g in groups])
        self.verified = 0

    def search(self, queries: np.ndarray, bound: np.ndarray, keep: int, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the ``keep`` best of each query, -inf where there are fewer; bound: squared distances already reached elsewhere."""
        norms = np.sqrt((queries * queries).sum(axis=1))
        projected = (queries / norms[:, None]) @ self.directions
        wide = stop_ratio(self.directions.shape[1], WIDE_SURE)
        boxes = _box_distance(projected[:, :DIMS], self.low, self.high)
        order = np.argsort(boxes, axis=1)
        best = np.full((len(queries), keep), -np.inf)
        ids = np.full((len(queries), keep), -1, np.int64)
        active = np.arange(len(queries))
        for step in range(len(self.low)):
            at = order[active, step]
            kth = np.maximum(MARGIN, np.minimum(bound[active], 2 - 2 * best[active, -1]))
            go = boxes[active, at] <= ratio * kth
            active, at, kth = active[go], at[go], kth[go]
            if not len(active):
                break
            members = self.members[at]
            gap = self.projected[members] - projected[active, None]
            who, place = np.nonzero((np.einsum("qld,qld->ql", gap, gap) <= wide * kth[:, None]) & (members >= 0))
            if not len(who):
                continue
            found, asked = members[who, place], active[who]
            self.verified += len(who)
            scores = np.full(members.shape, -np.inf)
            scores[who, place] = np.einsum("pd,pd->p", self.vectors[found], queries[asked]) / (self.norms[found] * norms[asked])
            better = np.flatnonzero(scores.max(axis=1) >= best[active, -1])
            if not len(better):
                continue
            rows = active[better]
            all_scores = np.concatenate([best[rows], scores[better]], axis=1)
            all_ids = np.concatenate([ids[rows], self.ids[members[better]]], axis=1)
            top = np.lexsort((all_ids, -all_scores), axis=1)[:, :keep]
            best[rows], ids[rows] = np.take_along_axis(all_scores, top, 1), np.take_along_axis(all_ids, top, 1)
        return best, ids


def _searcher(width: int, keep: int, ratio: float):
    """Streams rows of one (cell, slice, block) after another: first its vectors, then the queries that visit it."""
    directions = _directions(width)

    def run(batches):
        now, ids, vectors, tree = None, [], [], None
        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in ("cell", "slice", "block", "kind")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1), b.num_rows]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if i == j:
                    continue
                if (at := tuple(key[:3, i])) != now:
                    now, ids, vectors, tree = at, [], [], None
                part = b.slice(i, j - i)
                x, vid = _rows(part.column("embedding")), part.column("vid").to_numpy()
                if key[3, i] == 0:
                    ids.append(vid)
                    vectors.append(x)
                    continue
                if not vectors:
                    continue
                tree = tree or Tree(np.concatenate(ids), np.concatenate(vectors), directions)
                for k in range(0, len(x), 256):
                    bound = part.column("bound").to_numpy()[k : k + 256]
                    best, found = tree.search(x[k : k + 256], bound, keep, ratio)
                    q, place = np.nonzero(np.isfinite(best))
                    yield pa.RecordBatch.from_arrays([pa.array(vid[k : k + 256][q]), pa.array(found[q, place]), pa.array(best[q, place])], ["qid", "vid", "score"])

    return run


def _visit(vectors: DataFrame, visits: DataFrame, slices: DataFrame, width: int, keep: int, ratio: float) -> DataFrame:
    """The best of each visit (qid, embedding, bound, cell) among its cell's vectors (vid, embedding, cell)."""
    visits = checkpoint(visits)
    blocks = visits.groupBy("cell").count().select("cell", F.ceil(F.col("count") / VISITS).cast("int").alias("blocks"))
    dealt = F.broadcast(checkpoint(blocks.join(slices, "cell")))  # a row a cell, of which there are MOST_CELLS at most
    every = "sequence(0, {} - 1)"
    rows = vectors.join(dealt, "cell").withColumn("slice", F.pmod(F.xxhash64("vid"), "slices").cast("int"))
    rows = rows.select("cell", "slice", F.explode(F.expr(every.format("blocks"))).alias("block"), F.lit(0).alias("kind"), "vid", "embedding", F.lit(0.0).alias("bound"))
    asks = visits.join(dealt, "cell").withColumn("block", F.pmod(F.hash("qid"), "blocks"))
    asks = asks.select("cell", F.explode(F.expr(every.format("slices"))).alias("slice"), "block", F.lit(1).alias("kind"), F.col("qid").alias("vid"), "embedding", "bound")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = rows.unionByName(asks).repartition(parts, "cell", "slice", "block").sortWithinPartitions("cell", "slice", "block", "kind")
    return both.mapInArrow(_searcher(width, keep, ratio), "qid long, vid long, score double")


def _top(found: DataFrame, keep: int) -> DataFrame:
    place = Window.partitionBy("qid").orderBy(F.desc("score"), "vid")
    return found.withColumn("place", F.row_number().over(place)).where(F.col("place") <= keep).drop("place")


def valid(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id and embedding of the rows that take part, the vectors' length)."""
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    rows = rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < cast('Infinity' AS double)) AND exists(embedding, x -> x <> 0)")
    lengths = rows.groupBy(F.size("embedding").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    width = lengths.agg(F.max(F.struct("n", (-F.col("width")).alias("less")))["less"]).first()[0]
    return rows.where(F.size("embedding") == -(width or 0)), -(width or 0)


def search(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """The k nearest of every row whose vec_id is divisible by ``every``: query_id, rank, vec_id, score."""
    spark, keep = vectors.sparkSession, k + 1
    rows, width = valid(vectors)
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not width:
        return empty
    rows = rows.distinct()
    smallest = Window.partitionBy("embedding").orderBy("vec_id")
    held = rows.withColumn("place", F.row_number().over(smallest)).where(F.col("place") <= keep)
    groups = checkpoint(held.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("vid", F.element_at("ids", 1)))
    n = row_count(groups)

    # The hash bound lets about twice the sample through, so that choosing it exactly moves few rows at any size.
    chance = F.pmod(F.xxhash64("vid"), F.lit(1 << 40))
    sample = groups.where(chance < F.lit(2.0 * SAMPLE * (1 << 40) / max(n, 1))).orderBy(chance, "vid").limit(SAMPLE).select("embedding").toPandas()["embedding"]
    kind = groups.schema["embedding"].dataType.simpleString()
    directions, ratio = _directions(width)[:, :DIMS], stop_ratio()
    projected = _unit(_rows(pa.array(sample.to_list(), pa.list_(pa.float64())))) @ directions
    cells = Cells(projected, min(MOST_CELLS, -(-n // CELL_ROWS)))

    def place_vectors(batches):
        for b in batches:
            x = _unit(_rows(b.column("embedding"))) @ directions
            yield pa.RecordBatch.from_arrays([b.column("vid"), b.column("embedding"), pa.array(cells.of(x)), pa.array(x.tolist(), pa.list_(pa.float64()))], ["vid", "embedding", "cell", "at"])

    placed = checkpoint(groups.select("vid", "embedding").mapInArrow(place_vectors, f"vid long, embedding {kind}, cell int, at array<double>"))
    edges = [f(F.col("at")[d]).alias(f"{name}{d}") for d in range(DIMS) for name, f in (("low", F.min), ("high", F.max))]
    table = checkpoint(placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *edges))
    boxes = table.toPandas().sort_values("cell")  # a row a cell
    slices = table.select("cell", F.ceil(F.col("n") / (2 * CELL_ROWS)).cast("int").alias("slices"))
    low, high = (boxes[[f"{name}{d}" for d in range(DIMS)]].to_numpy() for name in ("low", "high"))
    numbers = boxes["cell"].to_numpy().astype(np.int32)

    asked = rows.where(F.col("vec_id") % every == 0)
    asked = checkpoint(asked.join(groups.select("embedding", "vid"), "embedding").select(F.col("vec_id").alias("query_id"), F.col("vid").alias("qid")))
    queries = checkpoint(placed.join(asked.select(F.col("qid").alias("vid")).distinct(), "vid"))
    vectors_ = placed.select("vid", "embedding", "cell")
    home = queries.select(F.col("vid").alias("qid"), "embedding", F.lit(float("inf")).alias("bound"), "cell")
    first = checkpoint(_visit(vectors_, home, slices, width, keep, ratio))
    reached = first.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    bound = F.when(F.col("n") >= keep, 2 - 2 * F.col("least")).otherwise(F.lit(float("inf")))
    onward = queries.join(reached.withColumnRenamed("qid", "vid"), "vid", "left").withColumn("bound", F.coalesce(bound, F.lit(float("inf"))))

    def other_cells(batches):
        step = max(1, BOXES // len(numbers))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                b = whole.slice(start, step)
                x = np.array(b.column("at").to_pylist(), np.float64)
                limit = ratio * np.maximum(MARGIN, b.column("bound").to_numpy())
                near = _box_distance(x, low, high) <= limit[:, None]
                near &= numbers[None, :] != b.column("cell").to_numpy()[:, None]
                q, c = np.nonzero(near)
                for at in range(0, len(q), TAKE):  # a query may visit every cell
                    took = b.select(["vid", "embedding", "bound"]).take(pa.array(q[at : at + TAKE]))
                    yield pa.RecordBatch.from_arrays([*took.columns, pa.array(numbers[c[at : at + TAKE]])], ["qid", "embedding", "bound", "cell"])

    visits = onward.select("vid", "embedding", "bound", "cell", "at").mapInArrow(other_cells, f"qid long, embedding {kind}, bound double, cell int")
    best = _top(first.unionByName(_visit(vectors_, visits, slices, width, keep, ratio)), keep)
    listed = best.join(groups.select("vid", "ids"), "vid").select("qid", "score", F.explode("ids").alias("vec_id"))
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pairs = asked.join(listed, "qid").where("vec_id <> query_id")
    ranked = pairs.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
