"""Graph operators over edge tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.storage import checkpoint, compact, release

#: Edges that a task turns into stars together.
GATHERED = 1 << 20


def _stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every vertex of the edges with the smallest one it reaches along them."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while (apart := label[a] != label[b]).any():
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (label[label] != label).any():
            label = label[label]
    return ids, ids[label]


def _gathered(batches):
    held, n = [], 0

    def stars():
        u, v = _stars(*(np.concatenate([b.column(k).to_numpy() for b in held]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["src", "dst"])

    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= GATHERED:
            yield stars()
            held, n = [], 0
    if n:
        yield stars()


def stars(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Edges (src, dst; longs) that join the same vertices, GATHERED at a time: no more than those had vertices."""
    ends = edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.col(src).cast("long"), F.col(dst).cast("long"))
    return ends.mapInArrow(_gathered, "src long, dst long")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Label every vertex of ``edges`` with the smallest vertex it reaches.

    Alternating large-star and small-star rounds: each vertex hands its larger
    neighbours, then its smaller ones, to the smallest vertex it knows of. A
    component of any size ends as a star in a logarithmic number of rounds. Edges
    are dealt by vertex, so a vertex of very many neighbours is one task's work,
    which streams. Each round is checkpointed, and the one before it deleted. Edges with a null end are ignored; loops keep a vertex of its own.

    Returns (vertex, component). Raises RuntimeError if ``max_rounds`` rounds
    don't settle it.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    loops = pairs.where("u = v").select(F.col("u").alias("vertex")).distinct()
    sums = {"a": F.sum(F.hash("u", "v").cast("long")), "b": F.sum(F.xxhash64("u", "v") % 1_000_003)}
    held = checkpoint(pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), **sums)
    said = None
    for _ in range(max_rounds):
        star = compact(held)
        # Dealt by vertex once for the minimum and for the join.
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition("u")
        near = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u")  # repeats go with the smaller ones below
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        before, held = held, checkpoint(small.where("u <> v").distinct(), **sums)
        release(before)
        now = held.__dict__["measured"]
        if now == said:
            break
        said = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    star = compact(held)
    roots = star.select(F.col("v").alias("vertex")).distinct()
    alone = loops.join(star.select(F.col("u").alias("vertex")), "vertex", "left_anti").join(roots, "vertex", "left_anti")
    return star.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(
        roots.unionByName(alone).select("vertex", F.col("vertex").alias("component"))
    )
