"""Height models: spatial folds, encoders, cross-validation over pyspark.ml, and imputation."""

from __future__ import annotations

import dataclasses
import itertools

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.functions.numeric import grid_key
from plinth.operators import boosting, forests
from plinth.operators.ranking import quantiles, running_total
from plinth.storage import checkpoint

GRID_M = 1000.0
FOLDS = 5
TARGET, OBSERVED = "target_height", "target_height_is_observed"
MATCH_METRICS = ["max_iou", "mean_iou", "max_overlap_a", "max_overlap_b", "min_dist_m"]

#: Columns that hold the target itself or are derived from it.
LEAKY = {"median_height_b", "target_height_reliability", "n_b_with_height"}

# The models' features and settings.
_BASE = ["median_stairs_b", "median_avg_floor_height_b", "union_area_all"]
_PURPOSE = ["mode_purpose_b"]
_NUMBERS = ["n_a", "n_b", "n_b_with_height", "n_edges_ab"]
_STATS = ("mean", "median", "min", "max", "std", "q25", "q75")
_AREAS = ["sum_area_a", "sum_area_b", "union_area_a", "union_area_b", "union_area_all"]
_KINDS = ["match_type", "match_confidence", "geometry_source"]


def _near(radius: int, stats: tuple[str, ...] = _STATS, indicators: bool = False) -> list[str]:
    """The neighbour features of a radius, and whether their statistics were there."""
    heights = [f"neighbor_height_{s}_{radius}m" for s in stats]
    return [f"n_neighbors_{radius}m", f"n_neighbors_obs_height_{radius}m", *heights, *(f"has_{h}" for h in heights if indicators)]


_WITH_NUMBERS = [*_BASE, *_PURPOSE, *_NUMBERS]
_HONEST = [*_KINDS, "n_a", "n_b", "n_edges_ab", *_AREAS, *_BASE[:2], *_PURPOSE, *_near(50), *_near(100), *(c for r in (50, 100) for c in _near(r, indicators=True) if c.startswith("has_"))]
#: Feature sets by name. ``full`` is kept for parity; it holds LEAKY columns, ``honest`` doesn't.
FEATURE_SETS = {
    "baseline": [*_BASE, *_PURPOSE],
    "plus_n_ab": _WITH_NUMBERS,
    "neighbors_mean": [*_WITH_NUMBERS, *(c for r in (50, 100) for c in _near(r, ("mean",), True))],
    "neighbors_full": [*_WITH_NUMBERS, *(c for r in (50, 100) for c in _near(r, indicators=True))],
    "honest": _HONEST,
    "full": [*_HONEST, "n_b_with_height", "target_height_reliability", "median_height_b"],
}
_TREES = {
    **{k: FEATURE_SETS[k] for k in ("baseline", "plus_n_ab", "neighbors_mean")},
    **{f"neighbors_full_{r}m": [*_WITH_NUMBERS, *_near(r, indicators=True)] for r in (50, 100)},
    "full": FEATURE_SETS["full"],
}
_MEANS = [f"neighbor_height_mean_{r}m" for r in (50, 100)]
#: By kind of model: which sets it is compared on.
MODEL_SETS = {
    "linear": {
        "1_baseline": [*_BASE, *_PURPOSE], "2_n_a_n_b": [*_BASE, *_PURPOSE, "n_a", "n_b"], "3_neighbors_mean": [*_BASE, *_PURPOSE, *_MEANS], "4_neighbors_50m": [*_BASE, *_PURPOSE, *_near(50)],
        "5_neighbors_100m": [*_BASE, *_PURPOSE, *_near(50), *_near(100)], "6_full": [*_BASE, *_PURPOSE, "n_a", "n_b", *_near(50), *_near(100), *_AREAS[:4], "n_edges_ab", *MATCH_METRICS],
    },
    "forest": _TREES,
    "gbt": _TREES,
    "boosted_categories": {k: FEATURE_SETS[k] for k in ("baseline", "full")},
    "histogram": _TREES,
    "ordered_categories": {k: FEATURE_SETS[k] for k in ("baseline", "full")},
}
#: Settings compared; of forest, gbt and boosted_categories as far as pyspark.ml has them: a depth without limit is 30, a least split of 10 a leaf of 10 or 20, and there is no L2 term.
GRIDS = {
    "linear": [{}],
    "forest": {"numTrees": [300], "maxDepth": [30, 15], "minInstancesPerNode": [1, 5, 10, 20]},
    "gbt": {"stepSize": [0.03, 0.05], "maxIter": [300], "maxDepth": [8, 10], "minInstancesPerNode": [20, 50]},
    "boosted_categories": [{"maxIter": 300, "stepSize": 0.05, "maxDepth": 6, "minInstancesPerNode": 10}, {"maxIter": 300, "stepSize": 0.05, "maxDepth": 8, "minInstancesPerNode": 30}],
    "histogram": {"stepSize": [0.03, 0.05], "maxIter": [300], "maxDepth": [None, 8], "minInstancesPerNode": [20, 50], "l2": [0.0, 1.0]},
    "ordered_categories": [{"maxIter": 300, "stepSize": 0.05, "maxDepth": 6, "l2": 3.0}, {"maxIter": 300, "stepSize": 0.05, "maxDepth": 8, "l2": 5.0}],
}
#: The settings of final fits.
BEST = {
    "forest": {"numTrees": 300, "maxDepth": 15, "minInstancesPerNode": 5},
    "gbt": {"stepSize": 0.05, "maxIter": 300, "maxDepth": 8, "minInstancesPerNode": 20},
    "boosted_categories": {"maxIter": 300, "stepSize": 0.05, "maxDepth": 6, "minInstancesPerNode": 10},
    "histogram": {"stepSize": 0.05, "maxIter": 300, "maxDepth": 8, "minInstancesPerNode": 20, "l2": 0.0},
    "ordered_categories": {"maxIter": 300, "stepSize": 0.05, "maxDepth": 6, "l2": 3.0},
}


def spatial_groups(df: DataFrame, x: str = "cx", y: str = "cy", size: float = GRID_M, name: str = "spatial_group") -> DataFrame:
    """Add the grid cell of the centroid; null without one."""
    return df.withColumn(name, grid_key(x, y, size))


def group_sizes(df: DataFrame, group: str = "spatial_group") -> DataFrame:
    """One row: number of groups, and mean, least and largest size."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("n_groups"), F.avg("n").alias("mean_size"), F.min("n").alias("min_size"), F.max("n").alias("max_size"))


def _deal(sizes: list[tuple[int, int]], folds: int) -> list[tuple[int, int, int, list[int]]]:
    """Deal groups to folds, largest first, each to the fold with the fewest rows (ties: the first).

    ``sizes``: (rows, how many groups of so many rows), largest first. Returns (rows, first place, places, folds in turn):
    stretches of places among the groups of one size over which the folds take turns.
    """
    load, out = [0] * folds, []
    for rows, groups in sizes:
        at = 0
        while at < groups:
            order = sorted(range(folds), key=lambda f: (load[f], f))
            least, after = order[0], order[1] if folds > 1 else None
            if after is None:
                turn, times = [0], groups - at
            elif load[least] + rows <= load[order[-1]] - (least > order[-1]):
                # It lags behind: it takes groups alone until another fold comes first.
                turn, times = [least], max(1, -(-(load[after] - load[least] + (least < after)) // rows))
            else:
                # Within a group of each other: from here on the folds take turns in this order.
                turn, times = order, -(-(groups - at) // folds)
            n = min(groups - at, times * len(turn))
            for k, f in enumerate(turn):
                load[f] += rows * (n // len(turn) + (k < n % len(turn)))
            out.append((rows, at, n, turn))
            at += n
    return out


def group_folds(df: DataFrame, group: str = "spatial_group", folds: int = FOLDS) -> DataFrame:
    """(group, fold): groups by size, largest first, ties by key, each to the fold with the fewest rows.

    Groups of one size are dealt together: the driver sees how many groups there
    are of each size, not the groups; their places among equals come from a
    running total and meet the few stretches that the dealing yields.
    """
    spark = df.sparkSession
    counts = checkpoint(df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n")))
    sizes = [(r["n"], r["k"]) for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).collect()]  # a row a size
    dealt = spark.createDataFrame(_deal(sizes, folds), "n long, first long, places long, turn array<int>")
    before, above = [], 0
    for n, k in sizes:
        before.append((n, above))
        above += k
    starts = spark.createDataFrame(before, "n long, above long")
    placed = running_total(counts, [F.desc("n"), F.col(group)], {"place": F.lit(1)}).join(starts, "n").withColumn("at", F.col("place") - F.col("above"))
    met = placed.join(dealt, "n").where("at >= first AND at < first + places")
    return met.select(group, F.expr("turn[cast((at - first) % size(turn) AS int)]").alias("fold"))


def split_observed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to train on, rows to predict)."""
    known = (F.col(OBSERVED) == 1) & F.col(TARGET).isNotNull()
    return df.where(known), df.where(~F.coalesce(known, F.lit(False)))


def categorical(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of the columns that hold text."""
    return [c for c in columns if isinstance(df.schema[c].dataType, T.StringType)]


def fill_categories(df: DataFrame, columns: list[str], value: str = "missing") -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(value)) for c in columns})


def fit_modes(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """The most frequent value of each text column (ties: the smallest); 'missing' for a column without values."""
    row = df.agg(*(F.mode(F.col(c).cast("string"), True).alias(c) for c in columns)).first() if columns else {}
    return {c: row[c] if row[c] is not None else "missing" for c in columns}


def fit_medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Exact interpolated medians, 0 for a column without values."""
    row = quantiles(df, {c: (F.col(c).cast("double"), [0.5]) for c in columns}).first() if columns else {}
    return {c: float(row[c][0]) if row[c] and row[c][0] is not None else 0.0 for c in columns}


def fit_scaler(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation by column (1 where a column is constant)."""
    row = df.agg(*(F.avg(c).alias(f"m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"s_{c}") for c in columns)).first() if columns else {}
    return {c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns}


def scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    """Standardise; nulls become 0, the mean."""
    return df.withColumns({c: F.coalesce((F.col(c) - m) / s, F.lit(0.0)) for c, (m, s) in fitted.items()})


def ordinal_codes(train: DataFrame, column: str) -> DataFrame:
    """(value, code) of a text column's sorted levels."""
    levels = train.select(column).where(F.col(column).isNotNull()).distinct()
    return running_total(levels, [F.col(column)], {"code": F.lit(1)})


def ordinal_encode(df: DataFrame, column: str, codes: DataFrame) -> DataFrame:
    """Replace levels by their codes; -1 for unknown ones."""
    named = codes.select(F.col(column).alias("__level"), F.col("code").cast("double").alias("__code"))
    return df.join(named, F.col(column) == F.col("__level"), "left").withColumn(column, F.coalesce("__code", F.lit(-1.0))).drop("__level", "__code")


def estimator(kind: str, features: list[str], text: list[str], params: dict | None = None) -> Pipeline:
    """A pipeline over ``features``; kinds: linear, forest, gbt, boosted_categories.

    Linear and forest models take categories one-hot, boosted trees as indexes.
    These boosted trees are pyspark.ml's; the kinds histogram and ordered_categories are ``boosting``'s.
    """
    params = params or {}
    numbers = [f for f in features if f not in text]
    stages = [StringIndexer(inputCols=text, outputCols=[f"{c}__i" for c in text], handleInvalid="keep")] if text else []
    if text and kind in ("linear", "forest"):
        stages.append(OneHotEncoder(inputCols=[f"{c}__i" for c in text], outputCols=[f"{c}__v" for c in text], dropLast=False))
        encoded = [f"{c}__v" for c in text]
    else:
        encoded = [f"{c}__i" for c in text]
    stages.append(VectorAssembler(inputCols=[*numbers, *encoded], outputCol="features"))
    made = {
        "linear": lambda: LinearRegression(labelCol=TARGET, regParam=0.0, **params),
        "forest": lambda: RandomForestRegressor(labelCol=TARGET, featureSubsetStrategy="sqrt", seed=42, maxBins=128, **params),
        "gbt": lambda: GBTRegressor(labelCol=TARGET, seed=42, maxBins=128, **params),
        "boosted_categories": lambda: GBTRegressor(labelCol=TARGET, seed=42, maxBins=128, **params),
    }
    return Pipeline(stages=[*stages, made[kind]()])


def prepared(train: DataFrame, other: DataFrame, kind: str, features: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both frames with categories and numbers filled, by what ``train`` holds; the text features.

    Missing categories become the most frequent level for forests and boosted
    trees over codes, and a level of their own for the others.
    """
    text = categorical(train, features)
    numbers = [f for f in features if f not in text]
    frames = [df.withColumns({c: F.col(c).cast("double") for c in numbers}) for df in (train, other)]
    if kind in ("linear", "boosted_categories"):
        frames = [fill_categories(df, text) for df in frames]
    else:
        modes = fit_modes(frames[0], text)
        frames = [df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(m)) for c, m in modes.items()}) if text else df for df in frames]
    if kind == "linear":
        fitted = fit_scaler(frames[0], numbers)
        frames = [scale(df, fitted) for df in frames]
    elif kind == "boosted_categories":
        frames = [df.fillna(0.0, numbers) for df in frames]
    else:
        medians = fit_medians(frames[0], numbers)
        frames = [df.fillna(medians) if medians else df for df in frames]
    return frames[0], frames[1], text


_NAMES = {"maxIter": "rounds", "stepSize": "rate", "maxDepth": "depth", "minInstancesPerNode": "least", "l2": "l2"}
_FOREST_NAMES = {"numTrees": "trees", "maxDepth": "depth", "minInstancesPerNode": "least", "maxBins": "bins", "seed": "seed"}
#: Settings, how text is encoded, and whether missing numbers become medians: histogram grows trees best node first up to
#: 31 leaves over sorted levels' codes, ordered_categories symmetric trees over ordered target statistics.
_BOOSTERS = {
    "histogram": (boosting.Settings(depth=None, leaves=31, least=20), "codes", True),
    "ordered_categories": (boosting.Settings(l2=3.0, symmetric=True), "statistics", False),
}


def _boosted(df: DataFrame, kind: str, features: list[str], params: dict | None, models: int, key: str) -> tuple[DataFrame, list[list[boosting.Tree]], list[str]]:
    """Predictions of each fold's rows, every model's trees, and the features in their order. Beside ordered categories missing neighbour heights are 0."""
    given, encode, fill = _BOOSTERS[kind]
    settings = dataclasses.replace(given, **{_NAMES[k]: v for k, v in (params or {}).items()})
    text = categorical(df, features)
    numbers = [f for f in features if f not in text]
    near = [c for c in numbers if c.startswith("neighbor_height_")]
    rows = df if fill or not near else df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in near})
    predicted, trees = boosting.boost(rows, numbers, text, TARGET, models, settings, key, encode, fill)
    return predicted, trees, [*numbers, *text]


def cross_validate(df: DataFrame, kind: str, features: list[str], params: dict | None = None, folds: int = FOLDS, key: str = "component_id", group: str = "spatial_group") -> DataFrame:
    """Out-of-fold predictions: key, fold, target, prediction. No group is in its own training rows."""
    dealt = checkpoint(df.join(group_folds(df, group, folds), group))
    if kind in _BOOSTERS:  # all folds in the same jobs
        return _boosted(dealt, kind, features, params, folds, key)[0].where(F.col(TARGET).isNotNull())
    if kind == "forest":
        settings = forests.Settings(**{_FOREST_NAMES[k]: v for k, v in (params or {}).items()})
        text = categorical(dealt, features)
        return forests.forest(dealt, [f for f in features if f not in text], text, TARGET, folds, settings, key).where(F.col(TARGET).isNotNull())
    out = None
    for k in range(folds):
        train, test, text = prepared(dealt.where(F.col("fold") != k), dealt.where(F.col("fold") == k), kind, features)
        if test.isEmpty() or train.isEmpty():
            continue
        part = estimator(kind, features, text, params).fit(train).transform(test).select(key, "fold", TARGET, "prediction")
        out = part if out is None else out.unionByName(part)
    return out


def regression_metrics(y: str = TARGET, p: str = "prediction") -> dict[str, Column]:
    """mse, rmse, mae and r2 as aggregates."""
    err = F.col(y) - F.col(p)
    mse = F.avg(err * err)
    return {"mse": mse, "rmse": F.sqrt(mse), "mae": F.avg(F.abs(err)), "r2": 1 - F.sum(err * err) / (F.var_pop(y) * F.count(y))}


def fold_metrics(predicted: DataFrame) -> DataFrame:
    """Metrics by fold."""
    return predicted.groupBy("fold").agg(*(v.alias(k) for k, v in regression_metrics().items()))


def fold_summary(by_fold: DataFrame, sample: bool = True) -> DataFrame:
    """Mean and deviation of each metric over folds (ddof 1, or 0)."""
    std = F.stddev_samp if sample else F.stddev_pop
    return by_fold.agg(*(f(m).alias(f"{m}_{n}") for m in ("mse", "rmse", "mae", "r2") for n, f in (("mean", F.avg), ("std", std))))


def combinations(grid: dict[str, list] | list[dict]) -> list[dict]:
    if isinstance(grid, list):
        return grid or [{}]
    return [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]


def compare(df: DataFrame, kind: str, sets: dict[str, list[str]] | None = None, grid: dict[str, list] | list[dict] | None = None, folds: int = FOLDS) -> DataFrame:
    """The folds' mean metrics of each feature set and combination of settings, best (rmse, then mae) first.

    By default the sets and settings that the kind of model is compared on.
    """
    sets, grid = MODEL_SETS[kind] if sets is None else sets, GRIDS[kind] if grid is None else grid
    out = None
    for (name, features), params in itertools.product(sets.items(), combinations(grid)):
        by_fold = fold_metrics(cross_validate(df, kind, features, params, folds))
        row = by_fold.agg(*(F.avg(m).alias(m) for m in ("mse", "rmse", "mae", "r2")))
        row = checkpoint(row.select(F.lit(kind).alias("model"), F.lit(name).alias("feature_set"), F.lit(str(params)).alias("params"), "mse", "rmse", "mae", "r2"))
        out = row if out is None else out.unionByName(row)
    return out.orderBy("rmse", "mae", "feature_set", "params")


def best(compared: DataFrame) -> DataFrame:
    """One row: the model, set and settings of the least rmse."""
    at = F.struct("rmse", "mae", "feature_set", "params")
    return compared.agg(F.min_by(F.struct("model", "feature_set", "params", "rmse"), at).alias("b")).select("b.*")


def top_features(importance: DataFrame, n: int = 20) -> DataFrame:
    """The n most important features, the least of them first."""
    return importance.orderBy(F.desc("importance"), "feature").limit(n).orderBy("importance", F.desc("feature"))


def fit_and_predict(df: DataFrame, kind: str, features: list[str], params: dict | None = None, key: str = "component_id") -> tuple[DataFrame, DataFrame]:
    """(predictions for unobserved rows, feature importances, largest first) of a model fitted on all observed rows."""
    train, rest = split_observed(df)
    if kind in _BOOSTERS:
        rows = train.withColumn("fold", F.lit(-1)).unionByName(rest.withColumns({"fold": F.lit(0), TARGET: F.lit(None).cast("double")}))
        predicted, trees, names = _boosted(rows, kind, features, params, 1, key)
        shares = [(n, float(w)) for n, w in boosting.importances(trees[0], names).items()]
        told = df.sparkSession.createDataFrame(shares, "feature string, importance double").orderBy(F.desc("importance"), "feature")
        return predicted.select(key, F.col("prediction").alias("target_height_predicted")), told
    train, rest, text = prepared(train, rest, kind, features)
    model = estimator(kind, features, text, params).fit(train)
    predicted = model.transform(rest).select(key, F.col("prediction").alias("target_height_predicted"))
    last = model.stages[-1]
    weights = (last.coefficients if kind == "linear" else last.featureImportances).toArray().tolist()
    attrs = itertools.chain.from_iterable(model.transform(train.limit(1)).schema["features"].metadata["ml_attr"]["attrs"].values())
    names = {a["idx"]: a["name"] for a in attrs}
    rows = [(names[k], float(w)) for k, w in enumerate(weights)]
    return predicted, df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
