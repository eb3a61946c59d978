"""Point tables for maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions.geometry import utm_to_degrees
from plinth.functions.numeric import confidence_score, score_colour
from plinth.operators.profiling import fixed_sample


def located(df: DataFrame, x: str = "cx", y: str = "cy") -> DataFrame:
    """Add lon and lat of UTM coordinates."""
    lon, lat = utm_to_degrees(F.col(x), F.col(y))
    return df.withColumns({"lon": lon, "lat": lat})


def height_points(df: DataFrame, most: float | None = 200.0) -> DataFrame:
    """lat, lon and weight (filled height), without nulls, up to ``most`` if given."""
    rows = df.select("lat", "lon", F.col("target_height_filled").alias("weight")).dropna()
    return rows if most is None else rows.where(F.col("weight") <= most)


def confidence_points(df: DataFrame, key: str = "component_id", share: float | None = None) -> DataFrame:
    """Points with confidence score, colour and tooltip; a fixed share of them if given."""
    score = confidence_score("target_height_reliability", "target_height_was_predicted")
    out = df.withColumn("confidence_score", score).select(
        key, "lat", "lon", "confidence_score", score_colour("confidence_score").alias("colour"),
        F.format_string("%s: %.1f", F.col("match_type"), F.col("target_height_filled")).alias("tooltip"),
    )
    return out if share is None else fixed_sample(out, round(share * out.count()), key)


def confidence_heat(df: DataFrame) -> DataFrame:
    """lat, lon and confidence score as weight."""
    return df.select("lat", "lon", confidence_score("target_height_reliability", "target_height_was_predicted").alias("weight")).dropna()


# Colours of five steps from low to high.
SHADES = ("#ffffb2", "#fecc5c", "#fd8d3c", "#f03b20", "#bd0026")


def shaded(points: DataFrame, weight: str = "weight") -> DataFrame:
    """Add the colour of each point's step of SHADES, equal steps between the least and the greatest weight."""
    ends = points.agg(F.min(weight).alias("__lo"), F.max(weight).alias("__hi"))
    share = (F.col(weight) - F.col("__lo")) / F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0))
    step = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * len(SHADES)).cast("int"), F.lit(len(SHADES) - 1))
    return points.crossJoin(F.broadcast(ends)).withColumn("colour", F.element_at(F.array(*map(F.lit, SHADES)), step + 1)).drop("__lo", "__hi")  # one row
