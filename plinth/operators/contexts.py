"""What the two reports say: cards, boxes and comparisons as plain dictionaries, and the pages made of them.

All counts come from single aggregation rows; numbers are formatted by the same
expressions as in tables.
"""

from __future__ import annotations

import html
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import geometry as geo
from plinth.functions import kernels
from plinth.functions.numeric import format_float, format_int, format_percent, number, quality_label, quality_score, safe_float, safe_int
from plinth.operators import profiling as p
from plinth.operators import validation
from plinth.operators.reporting import PAGE, histogram_svg
from plinth.sources.writers import metric_values

# The counts that make up a source's flags, by the book's metric names.
FLAGS = {
    "A": ["A_area_le_0", "A_floor_min_gt_floor_max"],
    "B": ["B_stairs_le_0", "B_stairs_gt_100", "B_avg_floor_height_le_0", "B_avg_floor_height_gt_10", "B_height_le_0", "B_height_gt_300"],
}
SOURCES = ("A", "B")
_COUNTS = ["rows_with_missing", "invalid_geom", "null_geom", "empty_geom", "signature_dups"]


def _one(df: DataFrame) -> dict[str, Any]:
    return df.first().asDict()


def _formatted(spark, values: dict[str, Any], columns: dict[str, Column]) -> dict[str, Any]:
    """``values`` (numbers or texts, as a one-row frame of texts) and the columns computed from them."""
    row = spark.range(1).select(*(F.lit(None if v is None else str(v)).alias(k) for k, v in values.items()))
    return _one(row.select(*(c.alias(k) for k, c in columns.items())))


def dataset_block(raw: DataFrame, book: dict[str, DataFrame], source: str) -> dict[str, Any]:
    """All figures of one source, plain and formatted, with its score and label."""
    metrics: dict[str, Any] = {}
    for sheet in ("ovw_dataset_shapes", "geo_basic_quality", "qlt_wkt_parse", "qlt_basic_numeric", f"holes_{source}_summary", "area_diff_thresholds"):
        if sheet in book and "metric" in book[sheet].columns:
            metrics |= metric_values(book[sheet])
    twice = book[f"dup_sig_{source}_summary"].first() if f"dup_sig_{source}_summary" in book else None
    cells = book[f"ovw_source_{source}_na"].agg(F.sum("na_count")).first()[0] if f"ovw_source_{source}_na" in book else 0
    missing = _one(p.any_null(raw))
    values = {
        "total": metrics.get(f"source_{source}_rows"), "cols": metrics.get(f"source_{source}_cols"), "rows_with_missing": missing["rows_with_missing"], "total_missing_cells": cells,
        "invalid_geom": metrics.get(f"{source}_invalid_geometry"), "null_geom": metrics.get(f"{source}_geometry_null"), "empty_geom": metrics.get(f"{source}_empty_geometry"),
        "parse_rate": metrics.get(f"{source}_parse_success_rate"), "signature_dups": twice["duplicates"] if twice else 0, "invalid_holes": metrics.get("invalid_holes"),
        "area_mismatch": metrics.get("area_diff_pct_gt_10pct") if source == "A" else 0, **{f"flag{k}": metrics.get(name) for k, name in enumerate(FLAGS[source])},
    }
    whole = [k for k in values if k != "parse_rate"]
    flags = sum((F.col(f"flag{k}") for k in range(len(FLAGS[source]))), F.lit(0))
    spark = raw.sparkSession
    row = spark.range(1).select(*(F.lit(None if v is None else str(v)).alias(k) for k, v in values.items()))
    row = row.select(*(safe_int(k).alias(k) for k in whole), safe_float("parse_rate").alias("parse_rate")).withColumn("numeric_flags", flags).withColumn("score", quality_score()).withColumn("risk_label", quality_label("score"))
    shown = ["total", "cols", "total_missing_cells", "numeric_flags", "area_mismatch", "invalid_holes", *_COUNTS]
    row = row.select("*", *(format_int(c).alias(f"{c}_fmt") for c in shown), *(format_percent(c, "total").alias(f"{c}_pct") for c in _COUNTS), F.concat(format_float(F.col("parse_rate") * 100), F.lit("%")).alias("parse_pct"))
    return {"name": f"Source {source}"} | {k: v for k, v in _one(row).items() if not k.startswith("flag")}


def eda_context(sources: dict[str, DataFrame], book: dict[str, DataFrame], title: str = "EDA quality", logo: str = "") -> dict[str, Any]:
    """The first report: cards over both sources, a block for each, and the comparison of the two."""
    blocks = [dataset_block(sources[s], book, s) for s in SOURCES]
    spark = sources["A"].sparkSession
    sums = {k: sum(b[k] for b in blocks) for k in ("total", "rows_with_missing", "invalid_geom", "signature_dups")}
    said = _formatted(spark, sums, {k: format_int(F.col(k).cast("long")) for k in sums})
    labels = {"total": "Objects", "rows_with_missing": "Rows with gaps", "invalid_geom": "Invalid geometries", "signature_dups": "Likely duplicates"}
    tones = {"total": "dark", "rows_with_missing": "light", "invalid_geom": "red", "signature_dups": "light"}
    compare = [{"label": labels[k], "a": blocks[0][k], "b": blocks[1][k], "a_fmt": blocks[0][f"{k}_fmt"], "b_fmt": blocks[1][f"{k}_fmt"], "max": max(blocks[0][k], blocks[1][k], 1)} for k in labels]
    return {
        "title": title, "logo": logo, "hero_total": said["total"], "cards": [{"label": labels[k], "value": said[k], "tone": tones[k]} for k in labels], "datasets": blocks, "compare_rows": compare,
        "notes": ["Gaps count rows with at least one missing value, over the whole table.", "Geometry weighs most in the score: matching relies on it."],
    }


def geometry_counts(df: DataFrame, wkb: str = "rep_geometry") -> dict[str, Column]:
    """Aggregates over rows of ``with_geometry``: parsed, invalid, empty, of no and of negative area."""
    return {
        "parsed_ok": F.count("__g"), "invalid_geom": F.count_if(F.col("__g").isNotNull() & ~F.col("__valid")), "empty_geom": F.count_if(F.size("__g") == 0),
        "zero_area": F.count_if(F.col("__area") == 0), "negative_area": F.count_if(F.col("__area") < 0),
    }


def with_geometry(df: DataFrame, wkb: str = "rep_geometry") -> DataFrame:
    """Add the parsed representative geometry, its validity and its area; ValueError without that column."""
    if wkb not in df.columns:
        raise ValueError(f"the table has no column {wkb}")
    out = df.withColumns({"__g": kernels.wkb_to_geometry(F.col(wkb)), "__valid": kernels.st_is_valid(F.col(wkb))})
    return out.withColumn("__area", geo.area("__g"))


_GAPS = ["target_height_filled", "target_height_was_predicted", "union_area_all", "median_stairs_b", "median_avg_floor_height_b"]


def validation_context(table: DataFrame, title: str = "Validation", logo: str = "", bins: int = 30) -> dict[str, Any]:
    """The second report, of a filled table: geometry, completeness, ranges, the model's part, neighbours, score and histograms."""
    rows = with_geometry(table)
    shapes = geometry_counts(rows)
    area = number("union_area_all")
    counts = validation.integrity() | validation.ranges() | shapes | {
        **{f"{c}_missing": F.count_if(F.col(c).isNull()) for c in _GAPS}, "area_min": F.min(area), "area_max": F.max(area), "area_negative": F.count_if(area < 0),
        "observed_count": F.count_if(F.col("target_height_was_predicted") == 0), "predicted_count": F.count_if(F.col("target_height_was_predicted") == 1),
    }
    raw = _one(validation.check(rows, counts))
    scored = _one(validation.score(rows, {k: v for k, v in shapes.items() if k != "parsed_ok"}))
    spark = table.sparkSession
    whole = [k for k in raw if not k.endswith(("_min", "_max"))]
    values = {k: raw[k] for k in raw} | {"filled": raw["total"] - raw["filled_missing"], "sound": raw["parsed_ok"] - raw["invalid_geom"]}
    columns = {f"{k}_fmt": format_int(F.col(k).cast("long")) for k in [*whole, "filled", "sound"]} | {f"{k}_pct": format_percent(F.col(k).cast("long"), F.col("total").cast("long")) for k in [*whole, "filled", "sound"]}
    columns |= {f"{k}_fmt": format_float(F.col(k).cast("double"), 1) for k in raw if k.endswith(("_min", "_max"))}
    said = _formatted(spark, values, columns)
    five = {}
    for name, flag in (("observed", 0), ("predicted", 1)):
        stats = _one(p.describe5(table.where(F.col("target_height_was_predicted") == flag), "target_height_filled"))
        five[name] = _formatted(spark, stats, {k: format_float(F.col(k).cast("double"), 2) for k in stats})
    gap = _one(validation.spatial_gap(table))
    gap_said = _formatted(spark, {k: 0 if v is None else v for k, v in gap.items()}, {k: (format_int(F.col(k).cast("long")) if k in ("n", "above_20") else format_float(F.col(k).cast("double"), 1)) for k in gap})
    sources = {r["target_height_fill_source"]: r["count"] for r in p.value_counts(table, "target_height_fill_source", 20).collect()}
    tall = validation.extreme(table).first()
    heights = table.where("target_height_filled IS NOT NULL")

    def box(k: str, v: str, n: str = "") -> dict[str, str]:
        return {"k": k, "v": v, "n": n}

    return {
        "title": title, "logo": logo, "hero_total": said["total_fmt"], "cols": len(table.columns), "score": scored["score"], "label": scored["label"],
        "cards": [
            {"label": "Buildings", "value": said["total_fmt"], "tone": "dark"}, {"label": "Heights filled", "value": said["filled_pct"], "tone": "light"},
            {"label": "Sound geometry", "value": said["sound_pct"], "tone": "red" if raw["invalid_geom"] or raw["empty_geom"] or raw["zero_area"] else "light"}, {"label": "By the model", "value": said["predicted_count_pct"], "tone": "light"},
        ],
        "geometry": [box("parsed", said["parsed_ok_fmt"], said["parsed_ok_pct"]), box("invalid", said["invalid_geom_fmt"], said["invalid_geom_pct"]), box("empty / no area", f"{said['empty_geom_fmt']} / {said['zero_area_fmt']}"), box("negative area", said["negative_area_fmt"])],
        "completeness": [box(c, said[f"{c}_missing_fmt"], said[f"{c}_missing_pct"]) for c in _GAPS],
        "ranges": [
            box("height", f"{said['height_min_fmt']} to {said['height_max_fmt']} m", f"negative: {said['height_negative_fmt']}"), box("floors", f"{said['stairs_min_fmt']} to {said['stairs_max_fmt']}", f"negative: {said['stairs_negative_fmt']}"),
            box("area", f"{said['area_min_fmt']} to {said['area_max_fmt']} m2", f"negative: {said['area_negative_fmt']}"), box("over 50 / 300 / 500 m", f"{said['above_50_fmt']} / {said['above_300_fmt']} / {said['above_500_fmt']}"),
        ],
        "model": [box("observed", said["observed_count_fmt"], said["observed_count_pct"]), box("predicted", said["predicted_count_fmt"], said["predicted_count_pct"]), box("observed changed", said["observed_changed_fmt"]), box("predicted with original", said["predicted_with_original_fmt"]), box("flag and source disagree", said["flag_mismatch_fmt"])],
        "observed_vs_predicted": [{"label": k, "a": five["observed"][k], "b": five["predicted"][k]} for k in ("mean", "median", "min", "max", "std")],
        "spatial": [box("checked", gap_said["n"]), box("mean / median gap", f"{gap_said['mean']} / {gap_said['p50']} m"), box("75 / 90 / 95 / 99 %", " / ".join(gap_said[q] for q in ("p75", "p90", "p95", "p99"))), box("over 20 m", gap_said["above_20"])],
        "fill_sources": sources, "extreme": tall.asDict() if tall else None,
        "histograms": {
            "up to 100 m": histogram_svg(p.histogram(heights.where("target_height_filled <= 100"), "target_height_filled", bins), bins),
            "all": histogram_svg(p.histogram(heights, "target_height_filled", bins), bins),
        },
    }


def _table(rows: list[dict[str, Any]], columns: list[str]) -> str:
    head = "".join(f"<th>{html.escape(c)}</th>" for c in columns)
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{html.escape(str(r.get(c, '')))}</td>" for c in columns) + "</tr>" for r in rows) + "</table>"


def render(context: dict[str, Any]) -> str:
    """A page of a context: every list of its dictionaries becomes a table."""
    parts = [f"<p><img src='{html.escape(context['logo'])}' alt=''></p>"] if context.get("logo") else []
    if "score" in context:
        parts.append(f"<p>Score {context['score']}: {html.escape(context['label'])}</p>")
    for key, value in context.items():
        if isinstance(value, list) and value and isinstance(value[0], dict):
            parts.append(f"<h2>{html.escape(key.replace('_', ' '))}</h2>" + _table(value, list(value[0])))
        elif isinstance(value, list):
            parts.append("<ul>" + "".join(f"<li>{html.escape(str(v))}</li>" for v in value) + "</ul>")
        elif key == "histograms":
            parts += [f"<h2>{html.escape(name)}</h2>{svg}" for name, svg in value.items()]
        elif isinstance(value, dict) and value:
            parts.append(f"<h2>{html.escape(key.replace('_', ' '))}</h2>" + _table([value], list(value)))
    return PAGE.substitute(title=html.escape(context["title"]), body="".join(parts))
