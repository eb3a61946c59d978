"""Linear regressions of many feature sets by fold, from one pass over the rows.

Sums and cross-products of all columns are added by fold, each task's in one matrix
a fold. What a fold's regressions train on is the total less the fold's own part, so
no fold is read again, and every feature set's normal equations are a part of the
same matrix. Columns are taken from their mean over all rows first, so that sums keep
their digits. A missing number is the training rows' mean, a missing category a level
of its own, as in ``modelling.prepared``; to leave that until the means by fold are
known, the matrix has a column that says which numbers are there.

The matrix has two columns a number and one a level, MOST_COLUMNS at most; it is all
that the driver sees. A second pass predicts every row by the regressions that didn't
see it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators.modelling import FOLDS, TARGET, categorical, group_folds, regression_metrics
from plinth.storage import checkpoint

MOST_COLUMNS = 2000
ROWS = 8192
MISSING = "missing"
#: Directions of less than this share of the largest are left out of a solution.
FLAT = 1e-10


class Columns:
    """The matrix's columns: one, the target, the numbers, which of them are there, and the levels of the categories."""

    def __init__(self, numbers: list[str], levels: dict[str, list[str]], centre: dict[str, float]):
        self.numbers, self.levels, self.centre = numbers, levels, centre
        k = len(numbers)
        self.number = {c: 2 + i for i, c in enumerate(numbers)}
        self.there = {c: 2 + k + i for i, c in enumerate(numbers)}
        self.level, at = {}, 2 + 2 * k
        for c, names in levels.items():
            self.level[c] = at
            at += len(names)
        self.width = at

    def matrix(self, batch: pa.RecordBatch) -> np.ndarray:
        """A batch's rows, numbers less their centre, 0 where they are missing."""
        out = np.zeros((batch.num_rows, self.width))
        out[:, 0] = 1
        for c, at, there in [(TARGET, 1, None), *((c, self.number[c], self.there[c]) for c in self.numbers)]:
            x = batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
            known = ~np.isnan(x)
            out[:, at] = np.where(known, x - self.centre[c], 0.0)
            if there:
                out[:, there] = known
        for c, names in self.levels.items():
            place = {v: self.level[c] + k for k, v in enumerate(names)}
            out[np.arange(batch.num_rows), [place[v] for v in batch.column(c).to_pylist()]] = 1
        return out


def _moments(rows: DataFrame, columns: Columns) -> dict[int, np.ndarray]:
    """The cross-products of the matrix's columns by fold."""
    upper = np.triu_indices(columns.width)

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            x, fold = columns.matrix(b), b.column("fold").to_numpy()
            for f in np.unique(fold).tolist():
                part = x[fold == f]
                sums[f] = sums.get(f, 0) + part.T @ part
        for f, m in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([m[upper].tolist()])], ["fold", "sums"])

    parts = rows.mapInArrow(run, "fold long, sums array<double>").select("fold", F.posexplode("sums").alias("at", "v"))
    out: dict[int, np.ndarray] = {}
    for r in parts.groupBy("fold", "at").agg(F.sum("v").alias("v")).collect():
        m = out.setdefault(r["fold"], np.zeros((columns.width, columns.width)))
        m[upper[0][r["at"]], upper[1][r["at"]]] = m[upper[1][r["at"]], upper[0][r["at"]]] = r["v"]
    return out


def _solve(m: np.ndarray, columns: Columns, features: list[str]) -> np.ndarray:
    """The regression of the target on features, as weights of the matrix's columns."""
    # Each regressor as a combination of columns: a number less its training mean where it is there, or a level.
    parts = [np.eye(columns.width)[0]]
    for c in features:
        if c in columns.number:
            row = np.zeros(columns.width)
            known = m[columns.there[c], 0]
            row[columns.number[c]] = 1
            row[columns.there[c]] = -m[columns.number[c], 0] / known if known else 0.0
            parts.append(row)
        else:
            parts.extend(np.eye(columns.width)[columns.level[c] : columns.level[c] + len(columns.levels[c])])
    z = np.array(parts)
    normal, right = z @ m @ z.T, z @ m[:, 1]
    size = np.sqrt(np.maximum(np.diag(normal), 0.0))
    size[size <= FLAT * size.max(initial=0.0)] = np.inf
    weights = np.linalg.lstsq(normal / np.outer(size, size), right / size, rcond=FLAT)[0] / size
    return weights @ z


def linear_folds(df: DataFrame, sets: dict[str, list[str]], folds: int = FOLDS, key: str = "component_id", group: str = "spatial_group") -> DataFrame:
    """Out-of-fold predictions of every feature set: key, feature_set, fold, target, prediction.

    No group is in its own training rows. Rows without a target or group take no part; a fold whose other folds hold no rows isn't predicted.
    """
    features = sorted({c for names in sets.values() for c in names})
    text = categorical(df, features)
    numbers = [c for c in features if c not in text]
    kept = df.where(F.col(TARGET).isNotNull())
    dealt = kept.join(group_folds(kept, group, folds), group).select(
        F.col(key), F.col("fold").cast("long").alias("fold"), F.col(TARGET).cast("double").alias(TARGET), *(F.col(c).cast("double").alias(c) for c in numbers), *(F.coalesce(c, F.lit(MISSING)).alias(c) for c in text)
    )
    dealt = checkpoint(dealt, **{f"m{i}": F.avg(c) for i, c in enumerate([TARGET, *numbers])})
    levels = {c: sorted(r[0] for r in dealt.select(c).distinct().limit(MOST_COLUMNS + 1).collect()) for c in text}
    columns = Columns(numbers, levels, {c: dealt.measured[f"m{i}"] or 0.0 for i, c in enumerate([TARGET, *numbers])})
    if columns.width > MOST_COLUMNS:
        raise ValueError(f"{columns.width} columns, more than {MOST_COLUMNS}")
    moments = _moments(dealt, columns)
    total = sum(moments.values(), np.zeros((columns.width, columns.width)))
    weights = {f: np.array([_solve(total - m, columns, names) for names in sets.values()]) for f, m in moments.items() if (total - m)[0, 0] > 0.5}
    names, kind, centre = list(sets), dealt.schema[key].dataType.simpleString(), columns.centre[TARGET]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b = batch.slice(at, ROWS)
                x, fold = columns.matrix(b), b.column("fold").to_numpy()
                for f in [f for f in np.unique(fold).tolist() if f in weights]:
                    mine = np.flatnonzero(fold == f)
                    some = b.take(pa.array(mine))
                    for name, w in zip(names, weights[f], strict=True):
                        label = pa.array([name] * len(mine))
                        yield pa.RecordBatch.from_arrays([some.column(key), label, some.column("fold"), some.column(TARGET), pa.array(x[mine] @ w + centre)], [key, "feature_set", "fold", TARGET, "prediction"])

    return dealt.mapInArrow(run, f"{key} {kind}, feature_set string, fold long, {TARGET} double, prediction double")


def linear_metrics(df: DataFrame, sets: dict[str, list[str]], folds: int = FOLDS, key: str = "component_id", group: str = "spatial_group") -> DataFrame:
    """feature_set, fold, mse, rmse, mae and r2 of ``linear_folds``."""
    return linear_folds(df, sets, folds, key, group).groupBy("feature_set", "fold").agg(*(v.alias(k) for k, v in regression_metrics().items()))
