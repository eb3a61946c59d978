"""Cleaning steps: each takes a frame and gives the kept rows; drops go to an audit with their reason.

Rows keep ``row_idx`` (their order in the source), ``status``, ``quality_flags``
and ``drop_reason``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import kernels
from plinth.functions.ragged import read_polygons
from plinth.operators.ranking import group_quantiles, quantiles
from plinth.storage import checkpoint

MIN_AREA = 15.0
MAX_FLOOR_HEIGHT = 10.0
CLEAN, REPAIRED, DROPPED = "clean", "repaired", "dropped"
AUDIT = ["row_idx", "drop_reason"]


def begin(df: DataFrame, row_idx: str | Column = "id", junk: str = "Unnamed: 0") -> DataFrame:
    """Drop the junk index column; add row_idx and the status columns; NaN in doubles becomes null."""
    df = df.drop(junk)
    doubles = {c: F.nanvl(F.col(f"`{c}`"), F.lit(None)) for c, t in df.dtypes if t in ("double", "float")}
    at = F.col(row_idx) if isinstance(row_idx, str) else row_idx
    return df.withColumns({**doubles, "row_idx": at, "status": F.lit(CLEAN), "quality_flags": F.lit(""), "drop_reason": F.lit("")})


def split(df: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(rows for which ``reason`` is null, audit of the others)."""
    told = df.withColumn("__reason", reason)
    kept = told.where(F.col("__reason").isNull()).drop("__reason")
    gone = told.where(F.col("__reason").isNotNull()).withColumns({"status": F.lit(DROPPED), "drop_reason": F.col("__reason")})
    return kept, gone.select(*AUDIT)


def _repair(df: DataFrame, where: Column, flag: str, values: dict[str, Column]) -> DataFrame:
    """Set ``values`` where ``where`` holds, with status and flag; all computed from the rows as they came."""
    sure = F.coalesce(where, F.lit(False))
    changed = {**values, "status": F.lit(REPAIRED), "quality_flags": F.concat("quality_flags", F.lit(f"{flag};"))}
    return df.withColumns({c: F.when(sure, v).otherwise(F.col(c)) for c, v in changed.items()})


def drop_null(df: DataFrame, column: str, reason: str) -> tuple[DataFrame, DataFrame]:
    return split(df, F.when(F.col(column).isNull(), reason))


def drop_small(df: DataFrame, area: str = "area", least: float = MIN_AREA) -> tuple[DataFrame, DataFrame]:
    """Areas below ``least`` go; the bound itself stays."""
    return split(df, F.when(F.col(area) < least, "small_utility_object"))


def swap_floors(df: DataFrame, low: str = "gkh_floor_count_min", high: str = "gkh_floor_count_max") -> DataFrame:
    """Exchange the two where the lower is above the upper."""
    return _repair(df, F.col(low) > F.col(high), "swapped_min_max", {low: F.col(high), high: F.col(low)})


def fill_by_group_median(df: DataFrame, column: str, group: str, where: Column, flag: str) -> DataFrame:
    """Fill where ``where`` holds: the group's median (of all its values), else the median of all rows.

    Rows of a null group have no group median. The two columns are kept once and
    all medians come from them, with no group's values in one task however many it
    has. The group medians are joined back; the optimiser broadcasts them by measured size.
    """
    values = checkpoint(df.select(group, column))
    medians = group_quantiles(values, group, column, [0.5]).select(F.col(group).alias("__g"), F.col("q")[0].alias("__m"))
    overall = quantiles(values, {"q": (F.col(column), [0.5])}).select(F.col("q")[0].alias("__all"))
    joined = df.join(medians, F.col(group) == F.col("__g"), "left").crossJoin(F.broadcast(overall))
    value = F.coalesce("__m", "__all")
    # A group whose values are all null has a null median of its own, which stays.
    value = F.when(F.col("__g").isNotNull(), F.col("__m")).otherwise(value)
    return _repair(joined, where, flag, {column: value}).drop("__g", "__m", "__all")


def fill_floor_height(df: DataFrame) -> DataFrame:
    """Zero floor heights are placeholders; the medians include them."""
    return fill_by_group_median(df, "avg_floor_height", "purpose_of_building", F.col("avg_floor_height") == 0, "filled_avg_floor_height")


def outlier_reason() -> Column:
    """Why a row of B goes: its reasons joined by ``;``, null if none."""
    stairs = F.when(F.col("stairs") <= 0, "stairs_invalid")
    floor = F.when(F.col("avg_floor_height") > MAX_FLOOR_HEIGHT, "avg_floor_height_too_high")
    height = F.when(F.col("height").isNull(), "missing_height")
    said = F.concat_ws(";", stairs, floor, height)
    return F.when(said != "", said)


def drop_outliers(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return split(df, outlier_reason())


def drop_duplicates(df: DataFrame, key: list[str], order: str = "row_idx") -> tuple[DataFrame, DataFrame]:
    """The first row of each key stays; nulls in keys equal each other, and ``order`` is unique.

    The first of each key is found by an aggregate and joined back, so a key
    that many rows share doesn't gather them in one task.
    """
    firsts = df.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(key))).agg(F.min(order).alias("__first"))
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(key)]
    told = df.join(firsts, same, "left")
    kept, gone = split(told, F.when(F.col(order) > F.col("__first"), "duplicate"))
    return kept.drop("__first", *(f"__k{i}" for i in range(len(key)))), gone


def fill_purpose(df: DataFrame, value: str = "unknown") -> DataFrame:
    """Null purposes become ``value``, without a status or flag."""
    return df.withColumn("purpose_of_building", F.coalesce("purpose_of_building", F.lit(value)))


def fill_stairs(df: DataFrame) -> DataFrame:
    return fill_by_group_median(df, "stairs", "purpose_of_building", F.col("stairs").isNull(), "filled_stairs")


def relevance(df: DataFrame, irrelevant: str, purpose: str = "purpose_of_building") -> DataFrame:
    """Add is_relevant_building: false for the purpose that is no building."""
    told = F.coalesce(F.col(purpose) != irrelevant, F.lit(True)) if purpose in df.columns else F.lit(True)
    return df.withColumn("is_relevant_building", told & (F.col("status") != DROPPED))


def relevant_only(df: DataFrame) -> DataFrame:
    """The relevant rows, if the frame says which they are."""
    return df.where("is_relevant_building") if "is_relevant_building" in df.columns else df


def parse_geometry(df: DataFrame, wkt: str, degrees: bool = True) -> DataFrame:
    """Add what cleaning needs of a WKT column, in one pass that is kept (of a stream: that runs on): ``wkb`` (repaired where that was needed),
    ``parsed``, ``was_valid``, ``repaired``, ``holes`` (bad ones) and ``area`` (of Web Mercator where the text is in degrees)."""
    out = df.withColumn("__p", read_polygons(F.col(wkt), degrees)).select("*", "__p.*").drop("__p")
    return out if df.isStreaming else checkpoint(out)


def clean_geometry(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows, audit) of ``parse_geometry``'s rows: WKT that can't be parsed, geometries that can't be repaired and
    polygons with bad holes go. A repair of the geometry sets neither status nor flag; ``repaired`` tells of it."""
    kept, broken = split(parsed, F.when(~F.col("parsed"), "broken_wkt"))
    kept, invalid = drop_null(kept, "wkb", "invalid_geometry")
    kept, holed = split(kept, F.when(F.col("holes") > 0, "invalid_holes"))
    return kept, broken.unionByName(invalid).unionByName(holed)


def geometry_counts(parsed: DataFrame) -> DataFrame:
    """One row: rows, and how many were unparsable, empty, invalid, repaired, and with bad holes."""
    shape = kernels.wkb_to_geometry(F.col("wkb"))
    rows = parsed.select("parsed", "was_valid", "repaired", "holes", (F.size(shape) == 0).alias("empty"))
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~F.col("parsed")).alias("broken_wkt"), F.count_if("empty").alias("empty_geometry"), F.count_if(F.col("parsed") & ~F.col("was_valid")).alias("invalid_geometry"),
        F.count_if("repaired").alias("repaired_geometry"), F.count_if(F.col("holes") > 0).alias("invalid_holes"),
    )


def _begin(raw: DataFrame, wkt: str | None, degrees: bool) -> tuple[DataFrame, DataFrame]:
    """(rows with status columns, audit of bad geometries): with ``wkt``, geometry is parsed, judged and measured; else rows come measured."""
    rows = begin(raw, "__at").drop("__at") if "__at" in raw.columns else begin(raw)
    return clean_geometry(parse_geometry(rows, wkt, degrees)) if wkt else (rows, rows.select(*AUDIT).limit(0))


def clean_a(raw: DataFrame, irrelevant: str, duplicate_key: list[str], wkt: str | None = None, degrees: bool = True) -> tuple[DataFrame, DataFrame]:
    """(clean rows, audit) of source A; ``wkt`` names the column of WKT, without which rows come with their area."""
    kept, shapes = _begin(raw, wkt, degrees)
    kept, small = drop_small(kept)
    kept, twice = drop_duplicates(swap_floors(kept), duplicate_key)
    return relevance(kept, irrelevant), shapes.unionByName(small).unionByName(twice)


def clean_b(raw: DataFrame, irrelevant: str, duplicate_key: list[str], wkt: str | None = None, degrees: bool = True) -> tuple[DataFrame, DataFrame]:
    """(clean rows, audit) of source B. Zero floor heights are filled before outliers are judged."""
    kept, shapes = _begin(raw, wkt, degrees)
    kept, small = drop_small(kept)
    kept, bad = drop_outliers(fill_floor_height(kept))
    kept, twice = drop_duplicates(kept, duplicate_key)
    return relevance(fill_stairs(fill_purpose(kept)), irrelevant), shapes.unionByName(small).unionByName(bad).unionByName(twice)


def summary(source: str, raw: DataFrame, clean: DataFrame, audit: DataFrame) -> DataFrame:
    """(source, metric, value): rows in, dropped by reason, kept, repaired, relevant; all counted from the data."""
    kept = clean.agg(F.count(F.lit(1)).alias("kept"), F.count_if(F.col("status") == REPAIRED).alias("repaired"), F.count_if("is_relevant_building").alias("relevant"))
    kept = kept.crossJoin(raw.agg(F.count(F.lit(1)).alias("original")))
    rows = kept.unpivot([], ["original", "kept", "repaired", "relevant"], "metric", "value")
    dropped = audit.groupBy(F.concat(F.lit("dropped:"), "drop_reason").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    return rows.unionByName(dropped).select(F.lit(source).alias("source"), "metric", "value")


def consistency(df: DataFrame) -> DataFrame:
    """One row: rows, and how many have under 2 or over 6 m a floor or a height more than 10 m off."""
    per = F.try_divide("height", "stairs")
    off = F.abs(F.col("height") - F.col("stairs") * F.col("avg_floor_height"))
    known = F.col("stairs").isNotNull() & F.col("height").isNotNull() & F.col("avg_floor_height").isNotNull()
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(known & (per < 2)).alias("low_floor"), F.count_if(known & (per > 6)).alias("high_floor"), F.count_if(known & (off > 10)).alias("large_error"))
