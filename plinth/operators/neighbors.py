"""Neighbourhood features over points."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.storage import checkpoint

RADII = (50, 100)
STATS = ("mean", "median", "min", "max", "std", "q25", "q75")
#: Asking kinds of points that one group holds, and distances that are looked at together.
ASKS, BLOCK = 1024, 1 << 20


def _columns(radii: tuple[int, ...]) -> list[tuple[str, str]]:
    return [c for r in radii for c in ((f"n_neighbors_{r}m", "long"), (f"n_neighbors_obs_height_{r}m", "long"), *((f"neighbor_height_{s}_{r}m", "double") for s in STATS))]


def _stats(w: np.ndarray, v: np.ndarray) -> dict[str, np.ndarray]:
    """Statistics by row of values v (sorted) that stand w[row] times each; nan where there are none."""
    upto = np.cumsum(w, axis=1)
    n = upto[:, -1] if len(v) else np.zeros(len(w), np.int64)
    out = {s: np.full(len(w), np.nan) for s in STATS}
    some = np.flatnonzero(n)
    if not len(some):
        return out
    upto, n, w = upto[some], n[some], w[some]

    def ranked(k: np.ndarray) -> np.ndarray:
        return v[(upto <= k[:, None]).sum(axis=1)]

    middle = v[len(v) // 2]
    mean = w @ (v - middle) / n
    out["mean"][some] = mean + middle
    with np.errstate(divide="ignore", invalid="ignore"):
        squares = np.maximum(w @ ((v - middle) ** 2) - n * mean * mean, 0)
        out["std"][some] = np.where(n > 1, np.sqrt(squares / (n - 1)), np.nan)
    out["min"][some], out["max"][some] = ranked(np.zeros_like(n)), ranked(n - 1)
    for s, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75)):
        at = (n - 1) * p
        low, high = np.floor(at), np.ceil(at)
        a, b = ranked(low), ranked(high)
        out[s][some] = np.where((low == high) | (a == b), a, (high - at) * a + (at - low) * b)
    return out


def _near(radii: tuple[int, ...]):
    names = [c for c, _ in _columns(radii)]

    def run(asks: pa.Table, held: pa.Table) -> pa.Table:
        x, y, v = (asks[c].to_numpy() for c in ("x", "y", "v"))
        v = v.astype(np.float64)
        hx, hy, hv, hn = (held[c].to_numpy() for c in ("hx", "hy", "hv", "hn"))
        order = np.argsort(hv.astype(np.float64), kind="stable")  # without a value (nan) last
        hx, hy, hv, hn = hx[order], hy[order], hv.astype(np.float64)[order], hn[order]
        known = int((~np.isnan(hv)).sum())
        found: dict[str, list] = {c: [] for c in names}
        step = max(1, BLOCK // max(1, len(hx)))
        for at in range(0, len(x), step):
            qx, qy, qv = (c[at : at + step, None] for c in (x, y, v))
            d = np.sqrt((qx - hx) ** 2 + (qy - hy) ** 2)
            own = (d == 0) & (qx == hx) & (qy == hy) & ((qv == hv) | (np.isnan(qv) & np.isnan(hv)))
            for r in radii:
                w = np.where(d <= r, hn, 0) - own
                found[f"n_neighbors_{r}m"].append(w.sum(axis=1))
                found[f"n_neighbors_obs_height_{r}m"].append(w[:, :known].sum(axis=1))
                for s, value in _stats(w[:, :known], hv[:known]).items():
                    found[f"neighbor_height_{s}_{r}m"].append(value)
        out = {c: np.concatenate(p) if p else np.empty(0) for c, p in found.items()}
        arrays = [pa.array(out[c].astype(np.int64)) if kind == "long" else pa.array(out[c], pa.float64(), mask=np.isnan(out[c])) for c, kind in _columns(radii)]
        return pa.Table.from_arrays([asks[c].combine_chunks() for c in ("x", "y", "v")] + arrays, ["at_x", "at_y", "of_v", *names])

    return run


def neighbor_features(points: DataFrame, key: str = "component_id", value: str = "target_height", radii: tuple[int, ...] = RADII, x: str = "cx", y: str = "cy") -> DataFrame:
    """Counts and statistics of the values of other points within each radius (inclusive); ``key`` is unique.

    Points of one place and value are one kind, which asks once and counts as
    often as it stands. Kinds lie in cells of the largest radius; a group holds
    up to about ASKS asking kinds of a cell and the kinds of the nine cells
    around it, and compares BLOCK pairs at a time, so no pair is shuffled.
    Points without neighbours have counts of 0 and null statistics.
    """
    size, named = float(max(radii)), {"x": F.col(x).cast("double") + 0.0, "y": F.col(y).cast("double") + 0.0, "v": F.col(value).cast("double")}
    placed = points.select(key, *(c.alias(n) for n, c in named.items()))
    kinds = placed.where("x IS NOT NULL AND y IS NOT NULL").groupBy("x", "y", "v").agg(F.count(F.lit(1)).alias("n"))
    kinds = checkpoint(kinds.withColumns({"gx": F.floor(F.col("x") / size), "gy": F.floor(F.col("y") / size)}))
    cells = kinds.groupBy("gx", "gy").agg(F.ceil(F.count(F.lit(1)) / ASKS).cast("int").alias("parts"))
    asks = kinds.join(cells, ["gx", "gy"]).withColumn("part", F.pmod(F.xxhash64("x", "y", "v"), F.col("parts")).cast("int"))
    around = F.explode(F.array(*(F.struct((F.col("gx") + i).alias("gx"), (F.col("gy") + j).alias("gy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    held = kinds.select("x", "y", "v", "n", around.alias("g")).select("x", "y", "v", "n", "g.gx", "g.gy").join(cells, ["gx", "gy"])
    held = held.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    held = held.select(*(F.col(c).alias(f"h{c}") for c in ("gx", "gy", "part", "x", "y", "v", "n")))
    by = ["gx", "gy", "part"]
    schema = "at_x double, at_y double, of_v double, " + ", ".join(f"{c} {kind}" for c, kind in _columns(radii))
    found = asks.select(*by, "x", "y", "v").groupBy(*by).cogroup(held.groupBy(*(f"h{c}" for c in by))).applyInArrow(_near(radii), schema)
    out = placed.join(found, (F.col("x") == F.col("at_x")) & (F.col("y") == F.col("at_y")) & F.col("v").eqNullSafe(F.col("of_v")), "left")
    return out.select(key, *(F.coalesce(c, F.lit(0)).alias(c) if kind == "long" else F.col(c) for c, kind in _columns(radii)))


def missing_indicators(df: DataFrame, prefix: str = "neighbor_height_") -> DataFrame:
    """For each column of the prefix add ``has_<column>`` and fill its nulls with 0."""
    cols = [c for c in df.columns if c.startswith(prefix)]
    return df.withColumns({f"has_{c}": F.col(c).isNotNull().cast("int") for c in cols} | {c: F.coalesce(c, F.lit(0.0)) for c in cols})
