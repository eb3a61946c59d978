"""Embedding whitening from an exact integer scatter.

A component c becomes the integer x = floor(GRID * c) + OFFSET. The fit takes all
usable vectors. Each task subtracts a shift from its integers and sums them and
their cross-products without rounding: entries are cut into digits of BITS bits,
whose products and block sums a double holds exactly, and blocks are added as
integers. Since a task's sums have no bound, they leave it as digits of WORD
bits by (row, column), which Spark adds as decimals, so the driver gets
(d + 1)(d + 2) / 2 exact numbers for d dimensions whatever the number of vectors.
With them n * X'X - SS' is formed in integers of any size; the shift falls out
there. Only then is it divided by n * n, rounded to double and decomposed by eigh.

The whitened covariance is measured, not derived: a second pass over all vectors
adds the centred products of what the third pass returns.

Defined cases: a vector that is null, empty or holds null or non-finite entries
is dropped, and so is one whose length isn't the commonest (of equally common
ones the shortest); rows that repeat or lack a vec_id count and are returned like
others; of equal eigenvalues the order is eigh's; each component's sign makes its
largest entry positive; a component of no variance (of less than FLAT of the
trace) has null ``whitened`` and no part in ``identity_error``; without any
variance ``explained`` is null; ``deviation`` is null where it doesn't fit its
38 digits (``fit_transform``) or a long (``query``); extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRID, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Bits of a digit in a task, and of one that leaves it.
BITS, WORD = 20, 60
#: Rows of a block: sums of products of two digits stay below 2 ** 53.
BLOCK = 1 << (53 - 2 * BITS)
ROWS = 4096
FLAT = 1e-12


def usable(table: DataFrame) -> DataFrame:
    """vec_id and x (array of double) of the vectors that take part."""
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = table.select("vec_id", F.col("embedding").cast("array<double>").alias("x")).where((F.size("x") > 0) & finite)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("x") == (lengths["d"] if lengths else 0))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def integers(c: np.ndarray, shift: int = 0) -> np.ndarray:
    """floor(GRID * c) + OFFSET - shift: int64 where all fit well within it, else Python integers."""
    scaled = np.floor(c * GRID)
    if scaled.size == 0 or np.abs(scaled).max() < 2.0**61:
        return scaled.astype(np.int64) + (OFFSET - shift)
    large = np.abs(c) >= 2.0**50
    whole = np.where(large, 0, scaled).astype(np.int64).astype(object)
    # A double of 2 ** 60 is an integer, and times GRID a larger one may overflow.
    whole[large] = [int(v) * GRID if abs(v) >= 2.0**60 else int(v * GRID // 1) for v in c[large].tolist()]
    return whole + (OFFSET - shift)


def _digits(y: np.ndarray) -> list[np.ndarray]:
    """y as float digits of BITS bits, the lowest first, the last one signed."""
    out = []
    while True:
        top = y >> BITS
        low = y - (top << BITS)
        if ((top == 0) | (top == -1)).all():
            out.append(y.astype(np.float64))
            return out
        out.append(low.astype(np.float64))
        y = top


def products(y: np.ndarray) -> np.ndarray:
    """y'y in Python integers, exact for integers of any size."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for at in range(0, len(y), BLOCK // 2):
        digits = _digits(y[at : at + BLOCK // 2])
        for i, a in enumerate(digits):
            for j, b in enumerate(digits):
                total += (a.T @ b).astype(np.int64).astype(object) << (BITS * (i + j))
    return total


def _scatter(rows: DataFrame, shift: int) -> tuple[int, np.ndarray, np.ndarray]:
    """n, sums and cross-products of x - shift over all rows, exact."""

    def run(batches):
        total = None
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                y = integers(_matrix(b.column("x").slice(at, ROWS)), shift)
                found = products(np.hstack([np.ones((len(y), 1), y.dtype), y]))
                total = found if total is None else total + found
        if total is None:
            return
        out = [(i, j, k, d) for i in range(len(total)) for j in range(i + 1) for k, d in enumerate(_words(int(total[i, j])))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["i", "j", "k", "digit"])

    parts = rows.select("x").mapInArrow(run, "i int, j int, k int, digit long")
    sums = parts.groupBy("i", "j", "k").agg(F.sum(F.col("digit").cast("decimal(28,0)")).alias("digit")).collect()
    d = max((r["i"] for r in sums), default=-1) + 1
    total = np.zeros((d, d), object)
    for r in sums:
        total[r["i"], r["j"]] += int(r["digit"]) << (WORD * r["k"])
    lower = np.tril(total, -1)
    total += lower.T
    return (int(total[0, 0]), total[0, 1:], total[1:, 1:]) if d else (0, np.zeros(0, object), np.zeros((0, 0), object))


def _words(v: int) -> list[int]:
    """v as digits of WORD bits, the lowest first, all with its sign."""
    sign, v, out = (-1 if v < 0 else 1), abs(v), []
    while v or not out:
        out.append(sign * (v & ((1 << WORD) - 1)))
        v >>= WORD
    return out


@dataclass(frozen=True)
class Whitener:
    """What a fit holds: count, exact sums of x, unit components in rows, their eigenvalues, and the trace."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def round(self) -> np.ndarray:
        """Which components vary."""
        return self.values > FLAT * self.trace

    def deviations(self, c: np.ndarray) -> np.ndarray:
        """n * x - S in integers."""
        x = integers(c)
        if x.dtype == object or self.n * (np.abs(x).max(initial=0) + 1) >= 2**61:
            x = x.astype(object)
        sums = self.sums if x.dtype == object else self.sums.astype(np.int64)
        return x * self.n - sums

    def apply(self, deviations: np.ndarray) -> np.ndarray:
        """Whitened coordinates; those of components that don't vary are nan."""
        scale = np.full(len(self.values), np.nan)
        scale[self.round] = 1 / np.sqrt(self.values[self.round])
        return (deviations / self.n).astype(np.float64) @ self.components.T * scale


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitener:
    """Fit on all rows of ``usable``."""
    n, shifted, cross = _scatter(rows, OFFSET)
    d = len(shifted)
    scatter = n * cross - np.outer(shifted, shifted)
    covariance = np.array([[float(Fraction(int(v), n * n)) for v in r] for r in scatter], np.float64).reshape(d, d)
    trace = float(Fraction(sum(int(scatter[k, k]) for k in range(d)), n * n)) if n else 0.0
    values, vectors = np.linalg.eigh(covariance) if d else (np.zeros(0), np.zeros((0, 0)))
    top = np.argsort(-values, kind="stable")[:components]
    vectors = vectors[:, top].T
    signs = np.array([np.sign(v[np.abs(v).argmax()]) for v in vectors]).reshape(-1, 1)
    return Whitener(n, shifted + n * OFFSET, vectors * signs, np.maximum(values[top], 0.0), trace)


def identity_error(rows: DataFrame, fitted: Whitener) -> float | None:
    """The largest absolute entry of the whitened covariance less the identity, measured over all rows; None if nothing varies."""
    kept = np.flatnonzero(fitted.round)
    if not fitted.n or not len(kept):
        return None

    def run(batches):
        n, sums, cross = 0, np.zeros(len(kept)), np.zeros((len(kept), len(kept)))
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                w = fitted.apply(fitted.deviations(_matrix(b.column("x").slice(at, ROWS))))[:, kept]
                n, sums, cross = n + len(w), sums + w.sum(axis=0), cross + w.T @ w
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.tolist()]), pa.array([cross.ravel().tolist()])], ["n", "sums", "cross"])

    parts = rows.select("x").mapInArrow(run, "n long, sums array<double>, cross array<double>")
    m = len(kept)
    total = parts.agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(m)), *(F.sum(F.col("cross")[i]).alias(f"c{i}") for i in range(m * m))).first()
    mean = np.array([total[f"s{i}"] for i in range(m)]) / fitted.n
    # The mean of whitened vectors is 0 but for rounding, so centring after the products loses nothing.
    covariance = np.array([total[f"c{i}"] for i in range(m * m)]).reshape(m, m) / fitted.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(m)).max())


def transform(rows: DataFrame, fitted: Whitener, error: float | None) -> DataFrame:
    """A row for every vector and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    m = len(fitted.values)
    shares = [float(v / fitted.trace) if fitted.trace else None for v in fitted.values]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                some = b.slice(at, ROWS)
                away = fitted.deviations(_matrix(some.column("x")))
                w = fitted.apply(away).ravel()
                most = int(np.abs(away).max(initial=0))
                squares = ((away if most**2 * away.shape[1] < 2**62 else away.astype(object)) ** 2).sum(axis=1)
                exact = pa.array([None if v >= 10**38 else v for v in map(int, squares)], pa.decimal128(38, 0))
                rounds = len(some)
                at_row = pa.array(np.repeat(np.arange(rounds), m))
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column("vec_id").take(at_row),
                        pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), rounds)),
                        pa.array(np.full(rounds * m, fitted.n)),
                        exact.take(at_row),
                        pa.array(w, mask=np.isnan(w)),
                        pa.array(shares * rounds, pa.float64()),
                        pa.array([error] * (rounds * m), pa.float64()),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(run, f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def fit_transform(table: DataFrame) -> DataFrame:
    """All vectors of (vec_id, embedding), whitened by a fit on all of them."""
    rows = usable(table)
    fitted = fit(rows)
    return transform(rows, fitted, identity_error(rows, fitted))


def query(spark, sf_dir: str) -> DataFrame:
    out = fit_transform(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS long)"))
