"""Validation of the final table of filled heights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions.numeric import VALIDATION_WEIGHTS, number, validation_label, validation_score
from plinth.operators.ranking import quantiles
from plinth.storage import checkpoint

#: Where a filled height comes from.
OBSERVED, PREDICTED = "observed", "catboost"
GEOMETRY_COUNTS = ("invalid_geom", "empty_geom", "zero_area", "negative_area")


def fill_heights(df: DataFrame, predictions: DataFrame, key: str = "component_id", target: str = "target_height", predicted: str = "target_height_predicted") -> DataFrame:
    """Left-join predictions (key, predicted); observed targets stay, others take the prediction."""
    seen = F.col("target_height_is_observed") == 1
    return df.join(predictions.select(key, predicted), key, "left").withColumns({
        "target_height_filled": F.when(seen, F.col(target)).otherwise(F.col(predicted)),
        "target_height_fill_source": F.when(seen, OBSERVED).otherwise(PREDICTED),
        "target_height_was_predicted": F.when(seen, 0).otherwise(1),
    })


def integrity() -> dict[str, Column]:
    """Counts that should all be 0.

    ``flag_mismatch`` counts rows whose flag and source disagree.
    """
    was = F.col("target_height_was_predicted")
    agree = ((was == 0) & (F.col("target_height_fill_source") == OBSERVED)) | ((was == 1) & (F.col("target_height_fill_source") == PREDICTED))
    return {
        "filled_missing": F.count_if(F.col("target_height_filled").isNull()),
        "observed_changed": F.count_if((was == 0) & F.coalesce(F.col("target_height") != F.col("target_height_filled"), F.lit(False))),
        "predicted_with_original": F.count_if((was == 1) & F.col("target_height").isNotNull()),
        "flag_mismatch": F.count_if(~F.coalesce(agree, F.lit(False))),
    }


def ranges() -> dict[str, Column]:
    h, s = number("target_height_filled"), number("median_stairs_b")
    return {
        "height_min": F.min(h), "height_max": F.max(h), "height_negative": F.count_if(h < 0), "above_50": F.count_if(h > 50),
        "above_300": F.count_if(h > 300), "above_500": F.count_if(h > 500), "stairs_min": F.min(s), "stairs_max": F.max(s), "stairs_negative": F.count_if(s < 0),
    }


def check(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """One row: total and the values, in one pass."""
    return df.agg(F.count(F.lit(1)).alias("total"), *(v.alias(k) for k, v in values.items()))


def spatial_gap(df: DataFrame) -> DataFrame:
    """Observed heights against their neighbours' mean within 100 m: rows, mean and quantiles of the gap, how many above 20 m."""
    rows = df.where("target_height_was_predicted = 0 AND n_neighbors_100m > 0 AND neighbor_height_mean_100m IS NOT NULL")
    gap = F.abs(number("target_height_filled") - number("neighbor_height_mean_100m"))
    qs = (0.5, 0.75, 0.9, 0.95, 0.99)
    rows = checkpoint(rows.select(gap.alias("gap")))  # the neighbours' join behind it is computed once
    out = rows.agg(F.count("gap").alias("n"), F.avg("gap").alias("mean"), F.count_if(F.col("gap") > 20).alias("above_20")).crossJoin(quantiles(rows, {"q": (F.col("gap"), list(qs))}))  # a row each
    return out.select("n", "mean", *(F.col("q")[k].alias(f"p{round(q * 100)}") for k, q in enumerate(qs)), "above_20")


def extreme(df: DataFrame, above: float = 400.0, key: str = "component_id") -> DataFrame:
    """The first observed object above a height, with its neighbours' mean."""
    rows = df.where((F.col("target_height_was_predicted") == 0) & (number("target_height_filled") > above) & (F.col("n_neighbors_100m") > 0))
    return rows.orderBy(key).limit(1).select(key, "target_height_filled", "neighbor_height_mean_100m")


def score(df: DataFrame, geometry: dict[str, Column] | None = None) -> DataFrame:
    """One row: total, the counts that are weighed, score and label. ``geometry``: counts of bad geometries, 0 where not given."""
    counts = {c: F.lit(0) for c in GEOMETRY_COUNTS} | (geometry or {}) | integrity() | {"above_500": ranges()["above_500"]}
    out = check(df, {c: counts[c] for c in VALIDATION_WEIGHTS}).withColumn("score", validation_score())
    return out.withColumn("label", validation_label("score"))
