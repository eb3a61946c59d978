"""The profiling book (named tables in sections), report contexts and their HTML."""

from __future__ import annotations

import html
from string import Template

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import geometry as geo
from plinth.functions import kernels, pairs
from plinth.functions.numeric import format_int, format_percent, quality_label, quality_score, try_ratio
from plinth.operators import profiling as p
from plinth.operators.spatial_join import BOX, box_groups
from plinth.storage import checkpoint

# Sample sizes, percentiles and column lists of the book.
SAMPLE_WKT, SAMPLE_NEIGHBORS, SAMPLE_NEAR = 2000, 3000, 2000
WIDE, TAIL = [0.01, 0.05, 0.5, 0.95, 0.99], [0.5, 0.9, 0.95, 0.99]
ADDRESS = ["subject", "district", "type", "locality", "type_street", "name_street", "number", "letter", "fraction", "housing", "building"]
NUMBERS = {"A": ["area_sq_m", "gkh_floor_count_min", "gkh_floor_count_max"], "B": ["number", "stairs", "avg_floor_height", "height"]}
LABEL = {"A": "title", "B": "purpose_of_building"}
WKT = {"A": "geometry", "B": "wkt"}
NEAR_OVERLAP, NEAR_DISTANCE = 0.8, 1.0
CELL_M = 128.0

Sheet = tuple[str, str, str, DataFrame]


def measured(df: DataFrame, wkt: str) -> DataFrame:
    """Add wkb, its geometry in Web Mercator (g, and as wkb_m), and all measures; null where the WKT can't be parsed."""
    out = df.withColumn("wkb", kernels.wkt_to_wkb(F.col(wkt))).withColumn("g4326", kernels.wkb_to_geometry(F.col("wkb")))
    out = out.withColumn("g", geo.to_mercator("g4326")).withColumns({"wkb_m": kernels.geometry_to_wkb(F.col("g")), "geom_area_m2": geo.area("g"), "perimeter_m": geo.perimeter("g"), "c": geo.centroid("g"), "box": geo.bounds("g"), "geom_type": geo.geom_type("g4326")})
    out = out.withColumns({"centroid_x": F.col("c.x"), "centroid_y": F.col("c.y"), "bbox_width_m": F.col("box.maxx") - F.col("box.minx"), "bbox_height_m": F.col("box.maxy") - F.col("box.miny"), **{c: F.col(f"box.{c}") for c in BOX}})
    out = out.withColumn("bbox_area_m2", F.col("bbox_width_m") * F.col("bbox_height_m"))
    return out.withColumns({
        "compactness": geo.compactness("geom_area_m2", "perimeter_m"), "rectangularity": geo.rectangularity("geom_area_m2", "bbox_area_m2"), "elongation": geo.elongation("bbox_width_m", "bbox_height_m"),
        "is_valid": kernels.st_is_valid(F.col("wkb")), "bad_holes": kernels.st_bad_holes(F.col("wkb"), False), "geom_hash": F.md5("wkb"), "geom_signature": geo.signature("geom_type", "geom_area_m2", *BOX),
    }).drop("c", "box")


_SHAPE = ["id", "wkb_m", "geom_area_m2", *BOX]


def neighbor_counts(sample: DataFrame, full: DataFrame) -> DataFrame:
    """Add neighbors_cnt: other shapes that a row's shape meets; null without a shape. Met shapes are counted in the tasks that find them."""

    def found(left: pa.Table, right: pa.Table):
        a, b = (pairs.Side(t["wkb_m"].to_pylist()) for t in (left, right))
        count = np.zeros(left.num_rows, np.int64)

        def take(ij):
            if ij is None:
                some = np.flatnonzero(count)
                return pa.Table.from_arrays([left["id"].combine_chunks().take(pa.array(some)), pa.array(count[some])], ["__id", "__n"])
            count[:] += np.bincount(ij[0][pairs.measures(a, b, *ij)[0] == 0], minlength=len(count))
            return None

        return take

    kind = sample.schema["id"].dataType.simpleString()
    counts = box_groups(sample.select(*_SHAPE), full.select(*_SHAPE), CELL_M, found, f"__id {kind}, __n long").groupBy("__id").agg((F.sum("__n") - 1).alias("__n"))
    out = sample.join(counts, F.col("id") == F.col("__id"), "left")
    return out.withColumn("neighbors_cnt", F.when(F.col("wkb").isNotNull() & (F.size("g4326") > 0), F.coalesce("__n", F.lit(0)))).drop("__id", "__n")


def near_duplicates(df: DataFrame, overlap: float = NEAR_OVERLAP) -> DataFrame:
    """Unordered pairs whose shapes each overlap the other by more than ``overlap``."""

    def found(left: pa.Table, right: pa.Table):
        a, b = (pairs.Side(t["wkb_m"].to_pylist()) for t in (left, right))
        (ids, areas), (rids, rareas) = ((t["id"].combine_chunks(), t["geom_area_m2"].to_numpy()) for t in (left, right))

        def take(ij):
            if ij is None:
                return None
            i, j = ij
            first = pc.less(ids.take(pa.array(i)), rids.take(pa.array(j))).to_numpy(zero_copy_only=False)
            i, j = i[first], j[first]
            dist, inter = pairs.measures(a, b, i, j)
            ratio = np.minimum(inter / areas[i], inter / rareas[j])
            for k in np.flatnonzero((dist == 0) & (np.abs(ratio - overlap) < 1e-9)).tolist():  # rounding decides: as the row-wise kernel does
                inter[k] = kernels.intersection_area(a.shapes[i[k]], b.shapes[j[k]])
            near = (dist == 0) & (ratio > overlap - 1e-9)
            i, j = pa.array(i[near]), pa.array(j[near])
            columns = [ids.take(i), rids.take(j), pa.array(inter[near]), pa.array(areas).take(i), pa.array(rareas).take(j)]
            return pa.Table.from_arrays(columns, ["id_i", "id_j", "inter_area", "wi", "wj"])

        return take

    rows, kind = df.where("geom_area_m2 > 0").select(*_SHAPE), df.schema["id"].dataType.simpleString()
    out = box_groups(rows, rows, CELL_M, found, f"id_i {kind}, id_j {kind}, inter_area double, wi double, wj double")
    out = out.select("id_i", "id_j", "inter_area", try_ratio("inter_area", "wi").alias("ratio_i"), try_ratio("inter_area", "wj").alias("ratio_j"))
    return out.where((F.col("ratio_i") > overlap) & (F.col("ratio_j") > overlap))


def _count_where(test: str) -> Column:
    return F.count_if(F.expr(test))


def eda_book(a: DataFrame, b: DataFrame, order: str = "id") -> list[Sheet]:
    """All sheets for the two raw sources (WKT in degrees; ``order`` stands for file order)."""
    raw = {"A": a, "B": b}
    full = {s: checkpoint(measured(df, WKT[s])) for s, df in raw.items()}
    out: list[Sheet] = []

    def add(section: str, name: str, said: str, df: DataFrame) -> None:
        out.append((section, name, said, df))

    def joined(name_of) -> DataFrame:
        """One metric table from both sources."""
        return name_of("A").unionByName(name_of("B"))

    add("overview", "ovw_dataset_shapes", "rows and columns", joined(lambda s: p.metrics(raw[s], {f"source_{s}_rows": F.count(F.lit(1)), f"source_{s}_cols": F.max(F.lit(len(raw[s].columns)))})))
    for s, df in raw.items():
        add("overview", f"ovw_source_{s}_head", f"first rows of {s}", p.head(df, 5, order))
        add("overview", f"ovw_source_{s}_na", f"nulls by column of {s}", p.null_share(df).select("column", "na_count"))
    for s, df in raw.items():
        add("numeric", f"num_{s}_raw_geom_types", f"first word of {s}'s WKT", p.value_counts(df.select(geo.wkt_token(WKT[s]).alias("geom_type")), "geom_type", 10))
        add("numeric", f"num_{s}_describe", f"numbers of {s}", p.describe(df, [c for c in NUMBERS[s] if c in df.columns], WIDE))
    add("quality", "qlt_wkt_parse", "share of WKT that parses, in a sample", joined(lambda s: p.metrics(p.fixed_sample(full[s], SAMPLE_WKT, order), {f"{s}_parse_success_rate": F.avg(F.col("wkb").isNotNull().cast("double")), f"{s}_sample_size": F.count(F.lit(1))})))
    checks = {
        "A": {"A_area_le_0": "area_sq_m <= 0", "A_floor_min_gt_floor_max": "gkh_floor_count_min > gkh_floor_count_max"},
        "B": {"B_stairs_le_0": "stairs <= 0", "B_stairs_gt_100": "stairs > 100", "B_avg_floor_height_le_0": "avg_floor_height <= 0", "B_avg_floor_height_gt_10": "avg_floor_height > 10", "B_height_le_0": "height <= 0", "B_height_gt_300": "height > 300"},
    }
    add("quality", "qlt_basic_numeric", "numbers out of range", joined(lambda s: p.metrics(raw[s], {k: _count_where(t) for k, t in checks[s].items()})))
    derived = b.withColumns({"height_per_floor": try_ratio("height", "stairs"), "height_error_abs": F.abs(F.col("height") - F.col("stairs") * F.col("avg_floor_height"))})
    add("derived_height", "drv_height_per_floor_desc", "height per floor", p.describe(derived, ["height_per_floor"], WIDE))
    add("derived_height", "drv_height_per_floor_chk", "implausible height per floor", p.metrics(derived, {"height_per_floor_lt_2": _count_where("height_per_floor < 2"), "height_per_floor_gt_6": _count_where("height_per_floor > 6")}))
    add("derived_height", "drv_height_error_desc", "height against floors times floor height", p.describe(derived, ["height_error_abs"], TAIL))
    add("derived_height", "drv_avg_floor_height_top", "most frequent floor heights", p.value_counts(b, "avg_floor_height", 20))
    add("categorical", "cat_A_tags_top30", "most frequent tags", p.value_counts(a, "tags", 30))
    add("categorical", "cat_B_purpose_top30", "most frequent purposes", p.value_counts(b, "purpose_of_building", 30))
    address = [c for c in ADDRESS if c in b.columns]
    if address:
        add("categorical", "cat_B_addr_na_share", "nulls in address columns, percent", p.null_share(b, address).select("column", "na_share_pct").orderBy(F.desc("na_share_pct"), "column"))
    has = F.expr("name_street IS NOT NULL AND number IS NOT NULL") if {"name_street", "number"} <= set(b.columns) else F.lit(False)
    add("categorical", "cat_B_basic_addr_cov", "rows with street and number", p.metrics(b, {"B_with_basic_address_share": F.avg(has.cast("double")), "B_with_basic_address_count": F.count_if(has)}))
    add("geometry_basic", "geo_basic_quality", "null, invalid and empty geometries", joined(lambda s: p.metrics(full[s], {f"{s}_geometry_null": _count_where("wkb IS NULL"), f"{s}_invalid_geometry": _count_where("NOT is_valid"), f"{s}_empty_geometry": _count_where("size(g4326) = 0")})))
    for s, df in full.items():
        add("geometry_basic", f"geo_{s}_types", f"types of {s}'s geometries", p.value_counts(df, "geom_type"))
    add("geom_stats", "gst_centroid_nulls", "geometries without a centroid", joined(lambda s: p.metrics(full[s], {f"{s}_centroid_null": _count_where("centroid_x IS NULL")})))
    for s, df in full.items():
        add("geom_stats", f"gst_{s}_bbox_stats", f"bounding boxes of {s}", p.describe(df, ["bbox_width_m", "bbox_height_m", "bbox_area_m2"], WIDE))
        add("geom_stats", f"gst_{s}_centroid_head", f"first centroids of {s}", p.existing(p.head(df, 5, order), ["id", "centroid_x", "centroid_y"]))
    compared = full["A"].withColumn("area_diff_abs", F.abs(F.col("geom_area_m2") - F.col("area_sq_m"))).withColumn("area_diff_pct", F.expr("CASE WHEN area_sq_m > 0 THEN area_diff_abs / area_sq_m END"))
    add("area_checks", "area_compare_stats", "stated against measured area", p.describe(compared, ["area_sq_m", "geom_area_m2", "area_diff_abs", "area_diff_pct"], TAIL))
    add("area_checks", "area_diff_thresholds", "large differences of area", p.metrics(compared, {f"area_diff_pct_gt_{k}pct": _count_where(f"area_diff_pct > {k / 100}") for k in (10, 25, 50)}))
    add("area_checks", "area_top_mismatch", "largest differences of area", p.top_k(compared, "area_diff_pct", 10, "id", ["id", "title", "area_sq_m", "geom_area_m2", "area_diff_abs", "area_diff_pct"]))
    for s, df in full.items():
        add("shape_features", f"shp_{s}_stats", f"shapes of {s}", p.describe(df, ["geom_area_m2", "perimeter_m", "compactness", "rectangularity", "elongation"], WIDE))
        add("shape_features", f"shp_{s}_elongated_top", f"longest shapes of {s}", p.top_k(df, "elongation", 10, "id", ["id", LABEL[s], "geom_area_m2", "elongation", "compactness", "rectangularity"]))
    for s, df in full.items():
        counted = checkpoint(neighbor_counts(p.fixed_sample(df, SAMPLE_NEIGHBORS, order), df))
        add("neighbors", f"nbr_{s}_stats", f"shapes that meet, in a sample of {s}", p.describe(counted, ["neighbors_cnt"], TAIL))
        add("neighbors", f"nbr_{s}_top_connected", f"most connected in the sample of {s}", p.top_k(counted, "neighbors_cnt", 10, "id", ["id", LABEL[s], "geom_area_m2", "neighbors_cnt"]))
    for s, df in full.items():
        add("duplicates_exact", f"dup_exact_{s}_summary", f"equal shapes of {s}", p.duplicate_summary(df, "geom_hash"))
        add("duplicates_exact", f"dup_exact_{s}_groups_top", f"largest groups of equal shapes of {s}", p.duplicate_groups(df, "geom_hash", 10).select("geom_hash", "count"))
        add("duplicates_exact", f"dup_exact_{s}_examples", f"rows of such groups of {s}", p.duplicate_examples(df, "geom_hash", ["id", LABEL[s], "geom_area_m2"]))
    for s, df in full.items():
        add("duplicates_signature", f"dup_sig_{s}_summary", f"equal signatures of {s}", p.duplicate_summary(df, "geom_signature"))
        add("duplicates_signature", f"dup_sig_{s}_groups_top", f"largest groups of equal signatures of {s}", p.duplicate_groups(df, "geom_signature", 10).select("geom_signature", "count"))
    for s, df in full.items():
        pairs = checkpoint(near_duplicates(p.fixed_sample(df, SAMPLE_NEAR, order)))
        add("near_duplicates", f"near_dup_{s}_summary", f"nearly equal shapes in a sample of {s}", p.metrics(pairs, {"near_duplicate_pairs_in_sample": F.count(F.lit(1)), "overlap_thresh": F.max(F.lit(NEAR_OVERLAP)), "dist_thresh": F.max(F.lit(NEAR_DISTANCE))}))
        add("near_duplicates", f"near_dup_{s}_examples", f"such pairs of {s}", pairs.orderBy("id_i", "id_j").limit(100))
    for s, df in full.items():
        add("invalid_holes", f"holes_{s}_summary", f"bad holes of {s}", p.metrics(df, {"invalid_holes": F.coalesce(F.sum("bad_holes"), F.lit(0))}))
        add("invalid_holes", f"holes_{s}_examples", f"shapes of {s} with bad holes", df.where("bad_holes > 0").select("id", "bad_holes"))
    for s, df in full.items():
        add("flat_exports", f"flat_{s}_metrics", f"{s} with its measures, without geometry", df.drop("wkb", "wkb_m", "g", "g4326", WKT[s]))
    return out


def dataset_block(name: str, raw: DataFrame, full: DataFrame) -> DataFrame:
    """One row of a report: rows, nulls, geometry counts, score and label of a source."""
    missing = p.any_null(raw).crossJoin(full.agg(
        _count_where("wkb IS NOT NULL AND NOT is_valid").alias("invalid_geom"), _count_where("wkb IS NULL").alias("null_geom"), _count_where("size(g4326) = 0").alias("empty_geom"), F.coalesce(F.sum("bad_holes"), F.lit(0)).alias("invalid_holes"),
    )).crossJoin(p.duplicate_summary(full, "geom_signature").select(F.col("duplicates").alias("signature_dups")))
    out = missing.withColumnRenamed("n_rows", "total").withColumn("score", quality_score()).withColumn("risk_label", quality_label("score"))
    return out.select(F.lit(name).alias("name"), "*", format_int("total").alias("rows_fmt"), format_percent("rows_with_missing", "total").alias("rows_with_missing_pct"))


PAGE = Template(
    "<!doctype html><html><head><meta charset='utf-8'><title>$title</title><style>body{font-family:sans-serif;margin:2em}table{border-collapse:collapse;margin:1em 0}"
    "td,th{border:1px solid #ccc;padding:4px 8px;text-align:right}</style></head><body><h1>$title</h1>$body</body></html>"
)


def table_html(caption: str, df: DataFrame, rows: int = 50) -> str:
    """The first rows of a report table."""
    held = df.limit(rows).collect()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in held)
    return f"<h2>{html.escape(caption)}</h2><table><tr>{head}</tr>{body}</table>"


def histogram_svg(bins: DataFrame, n: int, width: int = 620, height: int = 190) -> str:
    """Bars of a (bin, count) table of n bins."""
    counts = {r["bin"]: r["count"] for r in bins.collect()}  # n rows at most
    most, step = max(counts.values(), default=1), width / n
    bars = "".join(f"<rect x='{(k - 1) * step:.1f}' y='{height - height * c / most:.1f}' width='{step - 1:.1f}' height='{height * c / most:.1f}'/>" for k, c in sorted(counts.items()))
    return f"<svg xmlns='http://www.w3.org/2000/svg' width='{width}' height='{height}' fill='#4a7'>{bars}</svg>"


def page(title: str, parts: list[str]) -> str:
    return PAGE.substitute(title=html.escape(title), body="".join(parts))
