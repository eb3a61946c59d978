"""Queries over raw polygons, from WKT to the final table of buildings, and the SQL each is held against.

The fixtures' rectangles become polygons: of two in three the upper right quarter
is cut out, so shapes and their boxes differ and the cut-out of one may hold
another. Such a shape is two rectangles, so every measure still has a closed form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import geometry as geo
from plinth.functions import kernels
from plinth.functions.numeric import VALIDATION_LABELS, VALIDATION_WORST
from plinth.operators import cleaning, matching, modelling, reporting, validation
from plinth.plans import footprints as fp
from plinth.plans.fixtures import IRRELEVANT, footprints_a, footprints_b, oracle
from plinth.sources import geoparquet
from plinth.storage import checkpoint, row_count, staging_path

#: Added to the ids of copied rows.
COPY = 10_000_000
_BAD = "POLYGON ((0 0, 1 1"


def _text(corners: list[tuple[Column, Column]]) -> Column:
    ring = [F.concat_ws(" ", x.cast("string"), y.cast("string")) for x, y in [*corners, corners[0]]]
    return F.concat(F.lit("(("), F.concat_ws(", ", *ring), F.lit(")"))


def notched(df: DataFrame) -> DataFrame:
    """Add nw and nh (size of the cut-out), xm and ym (its corner), and the polygon's WKT without its last bracket."""
    cut = (F.col("id") % 3 != 0).cast("double")
    df = df.withColumns({"nw": F.col("w") / 2 * cut, "nh": F.col("h") / 2 * cut})
    df = df.withColumns({"xm": F.col("maxx") - F.col("nw"), "ym": F.col("maxy") - F.col("nh")})
    x1, y1, x2, y2, xm, ym = (F.col(c) for c in ("minx", "miny", "maxx", "maxy", "xm", "ym"))
    whole, cut_out = _text([(x1, y1), (x2, y1), (x2, y2), (x1, y2)]), _text([(x1, y1), (x2, y1), (x2, ym), (xm, ym), (xm, y2), (x1, y2)])
    return df.withColumn("ring", F.when(F.col("nw") > 0, cut_out).otherwise(whole))


def _touching(df: DataFrame) -> Column:
    """A hole that touches the shell's lower side in a point."""
    x, y, w, h = (F.col(c) for c in ("minx", "miny", "w", "h"))
    return _text([(x + w / 4, y), (x + w * 3 / 8, y + h / 4), (x + w / 8, y + h / 4)])


def _inner() -> Column:
    """A hole that touches nothing."""
    x, y, w, h = (F.col(c) for c in ("minx", "miny", "w", "h"))
    return _text([(x + w / 8, y + h / 8), (x + w / 4, y + h / 8), (x + w / 4, y + h / 4), (x + w / 8, y + h / 4)])


def raw_polygons(df: DataFrame) -> DataFrame:
    """Raw rows: every 53rd text is broken, every 59th polygon has a bad hole, and every 17th row stands twice."""
    df = notched(df)
    hole = F.when(F.col("id") % 59 == 0, F.concat(F.lit(", "), F.expr("substring(__hole, 2)"))).otherwise("")
    df = df.withColumn("__hole", _touching(df))
    df = df.withColumn("wkt", F.when(F.col("id") % 53 == 0, _BAD).otherwise(F.concat(F.lit("POLYGON "), "ring", hole, F.lit(")"))))
    df = df.drop("__hole", "ring", "area", "perimeter", "cx", "cy", "minx", "miny", "maxx", "maxy")
    return df.unionByName(df.where("id % 17 = 0").withColumn("id", F.col("id") + COPY))


# ---- cleaning, in degrees

_SCALE, _EAST, _NORTH = 2e-5, 30.0, 59.8


def _degrees(df: DataFrame) -> DataFrame:
    """The rectangles in degrees."""
    at = {c: F.lit(_EAST) + F.col(c) * _SCALE for c in ("minx", "maxx")} | {c: F.lit(_NORTH) + F.col(c) * _SCALE for c in ("miny", "maxy")}
    return df.withColumns(at).withColumns({"w": F.col("maxx") - F.col("minx"), "h": F.col("maxy") - F.col("miny")})


def _faulty(df: DataFrame) -> DataFrame:
    """Raw rows in degrees with all kinds of faults."""
    df = notched(_degrees(df))
    x1, y1, x2, y2 = (F.col(c) for c in ("minx", "miny", "maxx", "maxy"))
    bow = F.concat(F.lit("POLYGON "), _text([(x1, y1), (x2, y2), (x2, y1), (x1, y2)]), F.lit(")"))
    plain = F.concat(F.lit("POLYGON "), "ring", F.lit(")"))
    holed = {n: F.concat(F.lit("POLYGON "), "ring", F.lit(", "), F.expr(f"substring({n}, 2)"), F.lit(")")) for n in ("__touching", "__inner")}
    df = df.withColumns({"__touching": _touching(df), "__inner": _inner()})
    k = F.col("id")
    text = F.when(k % 53 == 0, _BAD).when(k % 47 == 0, F.lit(None)).when(k % 43 == 0, "POINT (1 2)").when(k % 41 == 0, "POLYGON EMPTY").when(k % 37 == 0, "POLYGON ((30 59, 31 59, 30 59, 30 59))")
    return df.select("id", text.when(k % 31 == 0, bow).when(k % 59 == 0, holed["__touching"]).when(k % 29 == 0, holed["__inner"]).otherwise(plain).alias("wkt"))


def geometry_audit(spark, sf_dir: str) -> DataFrame:
    """Each raw row's fate in geometry cleaning and the area filter, with the area of what is kept."""
    out = None
    for name, rows in (("A", footprints_a(spark, sf_dir)), ("B", footprints_b(spark, sf_dir))):
        parsed = cleaning.parse_geometry(cleaning.begin(_faulty(rows)), "wkt")
        kept, bad = cleaning.clean_geometry(parsed)
        kept, small = cleaning.drop_small(kept)
        none = {"repaired": F.lit(None).cast("boolean"), "area": F.lit(None).cast("double")}
        part = kept.select("row_idx", F.lit("").alias("drop_reason"), "repaired", F.round("area", 2).alias("area")).unionByName(bad.unionByName(small).withColumns(none))
        part = part.select(F.lit(name).alias("source"), "*")
        out = part if out is None else out.unionByName(part)
    return out


def _y(lat: str) -> str:
    return f"ln(tan(pi() / 4 + radians({lat}) / 2)) * {geo.RADIUS}"


def _x(lon: str) -> str:
    return f"radians({lon}) * {geo.RADIUS}"


_SPAN = "({0} - {1})"
_AUDIT_CTES = [
    f"dg AS (SELECT 'A' AS source, id, {_EAST} + x0 * {_SCALE} AS x1, {_EAST} + (x0 + w) * {_SCALE} AS x2, {_NORTH} + y0 * {_SCALE} AS y1, {_NORTH} + (y0 + h) * {_SCALE} AS y2 FROM fa "
    f"UNION ALL SELECT 'B', id, {_EAST} + x0 * {_SCALE}, {_EAST} + (x0 + w) * {_SCALE}, {_NORTH} + y0 * {_SCALE}, {_NORTH} + (y0 + h) * {_SCALE} FROM fb)",
    "dn AS (SELECT *, CASE WHEN id % 3 <> 0 THEN x2 - (x2 - x1) / 2 ELSE x2 END AS xm, CASE WHEN id % 3 <> 0 THEN y2 - (y2 - y1) / 2 ELSE y2 END AS ym, "
    "x1 + (x2 - x1) / 8 AS hx1, x1 + (x2 - x1) / 4 AS hx2, y1 + (y2 - y1) / 8 AS hy1, y1 + (y2 - y1) / 4 AS hy2 FROM dg)",
    "dm AS (SELECT source, id, " + ", ".join(f"{_x(c)} AS {c}" for c in ("x1", "x2", "xm", "hx1", "hx2")) + ", " + ", ".join(f"{_y(c)} AS {c}" for c in ("y1", "y2", "ym", "hy1", "hy2")) + " FROM dn)",
    "da AS (SELECT *, (x2 - x1) * (y2 - y1) - (x2 - xm) * (y2 - ym) - CASE WHEN id % 29 = 0 AND id % 59 <> 0 THEN (hx2 - hx1) * (hy2 - hy1) ELSE 0 END AS plain, (x2 - x1) * (y2 - y1) / 2 AS bow FROM dm)",
    "dr AS (SELECT source, id, CASE WHEN id % 31 = 0 THEN bow WHEN id % 41 = 0 THEN 0 ELSE plain END AS area, id % 31 = 0 AS repaired, CASE WHEN id % 53 = 0 OR id % 47 = 0 OR id % 43 = 0 THEN 'broken_wkt' WHEN id % 41 = 0 THEN NULL "
    "WHEN id % 37 = 0 THEN 'invalid_geometry' WHEN id % 31 = 0 THEN NULL WHEN id % 59 = 0 THEN 'invalid_holes' END AS reason FROM da)",
    "df AS (SELECT source, id, area, repaired AND id % 41 <> 0 AS repaired, coalesce(reason, CASE WHEN area < 15 THEN 'small_utility_object' END) AS reason FROM (SELECT * REPLACE (CASE WHEN id % 41 = 0 THEN 0 ELSE area END AS area) FROM dr))",
]
GEOMETRY_AUDIT = oracle(
    "SELECT source, id AS row_idx, coalesce(reason, '') AS drop_reason, CASE WHEN reason IS NULL THEN repaired END AS repaired, CASE WHEN reason IS NULL THEN round(area, 2) END AS area FROM df", *_AUDIT_CTES
)


def geometry_summary(spark, sf_dir: str) -> DataFrame:
    rows = _faulty(footprints_a(spark, sf_dir))
    return cleaning.geometry_counts(cleaning.parse_geometry(cleaning.begin(rows), "wkt"))


GEOMETRY_SUMMARY = oracle(
    "SELECT count(*) AS total, count(*) FILTER (reason = 'broken_wkt') AS broken_wkt, count(*) FILTER (reason IS DISTINCT FROM 'broken_wkt' AND id % 41 = 0) AS empty_geometry, "
    "count(*) FILTER (reason IS DISTINCT FROM 'broken_wkt' AND id % 41 <> 0 AND (id % 37 = 0 OR id % 31 = 0)) AS invalid_geometry, "
    "count(*) FILTER (reason IS DISTINCT FROM 'broken_wkt' AND id % 41 <> 0 AND id % 37 <> 0 AND id % 31 = 0) AS repaired_geometry, count(*) FILTER (reason = 'invalid_holes') AS invalid_holes FROM df WHERE source = 'A'",
    *_AUDIT_CTES,
)

# ---- from raw polygons to buildings, in metres

_BOX = ["x0", "y0", "w", "h", "nw"]


def cleaned(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both sources from raw WKT: cleaned, relevant only, with uids and shapes."""
    out = []
    for source, raw, clean in (("A", footprints_a, cleaning.clean_a), ("B", footprints_b, cleaning.clean_b)):
        kept, _ = clean(raw_polygons(raw(spark, sf_dir)), IRRELEVANT, ["wkb"], wkt="wkt", degrees=False)
        rows = checkpoint(matching.shapes(cleaning.relevant_only(kept), degrees=False))  # numbering reads them twice
        out.append(checkpoint(matching.with_uids(rows, source, "row_idx")))
    return out[0], out[1]


_SHAPE = (
    "SELECT *, maxx - nw AS xm, maxy - nh AS ym, (w * (h - nh) * (x0 + w / 2) + (w - nw) * nh * (x0 + (w - nw) / 2)) / area AS cx, (w * (h - nh) * (y0 + (h - nh) / 2) + (w - nw) * nh * (y0 + h - nh / 2)) / area AS cy "
    "FROM (SELECT * EXCLUDE (cx, cy) REPLACE (w * h - nw * nh AS area) FROM (SELECT *, CASE WHEN id % 3 <> 0 THEN w / 2 ELSE 0 END AS nw, CASE WHEN id % 3 <> 0 THEN h / 2 ELSE 0 END AS nh FROM {0})) WHERE id % 53 <> 0 AND id % 59 <> 0"
)
_TWICE = "SELECT * FROM {0} UNION ALL SELECT * REPLACE (id + {1} AS id) FROM {0} WHERE id % 17 = 0"
_FIRST = "row_number() OVER (PARTITION BY x0, y0, w, h, nw ORDER BY id)"


def _pieces(t: str) -> list[tuple[str, str, str, str]]:
    """The two rectangles of a shape of alias t: lower part, and what stands left of the cut-out."""
    return [(f"{t}.minx", f"{t}.miny", f"{t}.maxx", f"{t}.ym"), (f"{t}.minx", f"{t}.ym", f"{t}.xm", f"{t}.maxy")]


def _shared(a, b) -> str:
    return f"greatest(0.0, least({a[2]}, {b[2]}) - greatest({a[0]}, {b[0]})) * greatest(0.0, least({a[3]}, {b[3]}) - greatest({a[1]}, {b[1]}))"


def _apart(a, b) -> str:
    return f"sqrt(greatest(0.0, {b[0]} - {a[2]}, {a[0]} - {b[2]}) ** 2 + greatest(0.0, {b[1]} - {a[3]}, {a[1]} - {b[3]}) ** 2)"


_INTER = " + ".join(_shared(p, q) for p in _pieces("a") for q in _pieces("b"))
_DIST = "least(" + ", ".join(_apart(p, q) for p in _pieces("a") for q in _pieces("b")) + ")"
MATCH = [
    f"pa AS ({_SHAPE.format('fa')})",
    f"pb AS ({_SHAPE.format('fb')})",
    f"ra AS ({_TWICE.format('pa', COPY)})",
    f"b1 AS (SELECT * FROM ({_TWICE.format('pb', COPY)}) WHERE area >= 15)",
    fp.B_FILLED,
    f"b3 AS (SELECT * EXCLUDE (nth) REPLACE (coalesce(purpose_of_building, 'unknown') AS purpose_of_building) FROM (SELECT *, {_FIRST} AS nth FROM b2 WHERE {fp.REASON} = '') WHERE nth = 1)",
    fp.B_STAIRS,
    f"a AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS node, 'A_' || (row_number() OVER (ORDER BY id) - 1) AS uid FROM (SELECT *, {_FIRST} AS nth FROM ra WHERE area >= 15) WHERE nth = 1)",
    f"b AS (SELECT *, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY id) - 1 AS node, 'B_' || (row_number() OVER (ORDER BY id) - 1) AS uid FROM b4 WHERE purpose_of_building <> '{IRRELEVANT}')",
    "gaps AS (SELECT a.uid AS uid_a, b.uid AS uid_b, a.node AS node_a, b.node AS node_b, a.area AS area_a, b.area AS area_b, a.perimeter AS perimeter_a, b.perimeter AS perimeter_b, "
    f"{_INTER} AS intersection_area, {_DIST} AS dist_m, sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS centroid_dist_m "
    "FROM a JOIN b ON a.minx <= b.maxx + 0.5 AND b.minx <= a.maxx + 0.5 AND a.miny <= b.maxy + 0.5 AND b.miny <= a.maxy + 0.5)",
    "pairs AS (SELECT *, area_a + area_b - intersection_area AS union_area, least(area_a, area_b) AS min_area FROM gaps WHERE dist_m <= 0.5)",
    *fp.MATCH[4:],
]
GRAPH = [*MATCH, *fp.GRAPH[len(fp.MATCH):]]


def polygon_metrics(spark, sf_dir: str) -> DataFrame:
    found = matching.polygon_pairs(*cleaned(spark, sf_dir))
    metrics = matching.pair_metrics(found, F.col("inter"), F.col("dist"))
    return metrics.select("uid_a", "uid_b", "area_a", "area_b", "perimeter_a", "perimeter_b", *fp.r6(*fp.METRICS))


POLYGON_METRICS = oracle("SELECT uid_a, uid_b, area_a, area_b, perimeter_a, perimeter_b, " + ", ".join(fp.R6.format(m) for m in fp.METRICS) + " FROM metrics", *MATCH)


def graph(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(A, B, edges, members) of the cleaned polygons."""
    a, b = cleaned(spark, sf_dir)
    # Cleaning leaves each polygon once, so every row is a kind.
    a, b = (rows.withColumn("node", F.col("ordinal") + first) for rows, first in ((a, 0), (b, row_count(a))))
    own = [rows.withColumn("n", F.lit(1).cast("long")) for rows in (a, b)]
    edges = matching.linked(*own, shapes=True)
    nodes = a.select("uid", "src", "node", F.col("node").alias("rep")).unionByName(b.select("uid", "src", "node", F.col("node").alias("rep")))
    return a, b, edges, checkpoint(matching.components(nodes, edges))


def match_types(spark, sf_dir: str) -> DataFrame:
    """The flagship: from raw WKT through cleaning, matching and components to the match types of buildings."""
    _, _, edges, members = graph(spark, sf_dir)
    return matching.component_table(members, edges).groupBy("match_type").agg(F.count(F.lit(1)).alias("n"))


def buildings(spark, sf_dir: str) -> DataFrame:
    """The final table of buildings."""
    a, b, edges, members = graph(spark, sf_dir)
    return matching.final_table(a, b, members, edges)


_PLAIN = ["component_id", "match_type", "match_confidence", "geometry_source", "target_height", "target_height_source", "target_height_source_detail", "target_height_reliability", "n_a", "n_b", "uids_a", "uids_b", "n_edges_ab",
          "sum_area_a", "sum_area_b", "n_b_with_height", "median_height_b", "median_stairs_b", "median_avg_floor_height_b", "mode_purpose_b"]
_UNIONS = ["union_area_a", "union_area_b", "union_area_all"]


def final_table(spark, sf_dir: str) -> DataFrame:
    """The final table with lists as text and the representative geometry as its area and centroid."""
    table = buildings(spark, sf_dir)
    lists = {c: F.when(F.size(c) > 0, F.array_join(c, ",")) for c in ("uids_a", "uids_b")}
    rep = geo.area("__g")
    out = table.withColumns(lists).withColumn("__g", kernels.wkb_to_geometry(F.col("rep_geometry"))).withColumn("rep_area", rep)
    rounded = [*_UNIONS, *fp.EDGE_STATS, *fp._ROUNDED, "rep_area", "cx", "cy"]
    return out.select(*_PLAIN, F.col("target_height_is_observed").cast("int").alias("target_height_is_observed"), *(f for f in fp.FEATURES if f not in fp._ROUNDED), *fp.r6(*rounded))


#: From rects (component_id, src, x1, y1, x2, y2): the plane cut at all their edges, and what of it the sides cover.
CELLS = [
    "xs AS (SELECT component_id, x AS x1, lead(x) OVER (PARTITION BY component_id ORDER BY x) AS x2 FROM (SELECT component_id, x1 AS x FROM rects UNION SELECT component_id, x2 FROM rects))",
    "ys AS (SELECT component_id, y AS y1, lead(y) OVER (PARTITION BY component_id ORDER BY y) AS y2 FROM (SELECT component_id, y1 AS y FROM rects UNION SELECT component_id, y2 FROM rects))",
    "cells AS (SELECT xs.component_id, xs.x1, xs.x2, ys.y1, ys.y2, (xs.x2 - xs.x1) * (ys.y2 - ys.y1) AS area, bool_or(r.src = 'A') AS in_a, bool_or(r.src = 'B') AS in_b FROM xs JOIN ys USING (component_id) JOIN rects r "
    "ON r.component_id = xs.component_id AND r.x1 <= xs.x1 AND r.x2 >= xs.x2 AND r.y1 <= ys.y1 AND r.y2 >= ys.y2 GROUP BY ALL)",
    "unions AS (SELECT component_id, sum(area) FILTER (in_a) AS union_area_a, sum(area) FILTER (in_b) AS union_area_b, sum(area) AS union_area_all, "
    + ", ".join(f"sum(area * ({d}1 + {d}2) / 2) FILTER (in_{s}) / sum(area) FILTER (in_{s}) AS c{d}_{s}" for s in "ab" for d in "xy") + " FROM cells GROUP BY component_id)",
    "reps AS (SELECT *, CASE WHEN side = 'A' THEN cx_a ELSE cx_b END AS cx, CASE WHEN side = 'A' THEN cy_a ELSE cy_b END AS cy, CASE WHEN side = 'A' THEN union_area_a ELSE union_area_b END AS rep_area "
    "FROM (SELECT unions.*, CASE WHEN union_area_b IS NULL THEN 'A' WHEN union_area_a IS NULL THEN 'B' WHEN match_type = '1:1' OR least(union_area_a, union_area_b) / greatest(union_area_a, union_area_b) >= 0.7 THEN 'B' ELSE 'A' END AS side "
    "FROM unions JOIN typed USING (component_id)))",
]
_SHP = "shp AS (SELECT uid, minx, miny, maxx, maxy, xm, ym, nw FROM a UNION ALL SELECT uid, minx, miny, maxx, maxy, xm, ym, nw FROM b)"
UNION = [
    *GRAPH, _SHP,
    "rects AS (SELECT component_id, src, " + ", ".join(f"{c} AS {n}" for c, n in zip(_pieces("s")[0], ("x1", "y1", "x2", "y2"), strict=True)) + " FROM members JOIN shp s USING (uid) UNION ALL SELECT component_id, src, "
    + ", ".join(_pieces("s")[1]) + " FROM members JOIN shp s USING (uid) WHERE nw > 0)",
    *CELLS,
]
_FINAL = [
    *UNION,
    f"built AS (SELECT sure.*, sum_area_a, sum_area_b, {', '.join(_UNIONS)}, cx, cy, rep_area, side, median_height_b AS target_height, {fp._DETAIL}, {fp._RELIABILITY} FROM sure JOIN areas USING (component_id) JOIN reps USING (component_id))",
    "near AS (SELECT l.component_id AS id, r.target_height AS nh, sqrt((l.cx - r.cx) * (l.cx - r.cx) + (l.cy - r.cy) * (l.cy - r.cy)) AS d FROM built l JOIN built r ON l.component_id <> r.component_id AND abs(l.cx - r.cx) <= 100 AND abs(l.cy - r.cy) <= 100)",
    f"feats AS (SELECT component_id, {', '.join(fp._stats_sql(r) for r in (50, 100))} FROM built LEFT JOIN near ON component_id = near.id GROUP BY component_id)",
]
FINAL_TABLE = oracle(
    "SELECT component_id, match_type, match_confidence, side AS geometry_source, target_height, CASE WHEN target_height IS NULL THEN 'missing' ELSE 'B_observed' END AS target_height_source, target_height_source_detail, target_height_reliability, "
    "n_a, n_b, uids_a, uids_b, n_edges_ab, sum_area_a, sum_area_b, coalesce(n_b_with_height, 0) AS n_b_with_height, median_height_b, median_stairs_b, median_avg_floor_height_b, mode_purpose_b, "
    "CASE WHEN target_height IS NULL THEN 0 ELSE 1 END AS target_height_is_observed, " + ", ".join(fp.FEATURES) + ", " + ", ".join(fp.R6.format(c) for c in [*_UNIONS, *fp.EDGE_STATS, "rep_area", "cx", "cy"]) + " FROM built JOIN feats USING (component_id)",
    *_FINAL, recursive=True,
)


def union_area(spark, sf_dir: str) -> DataFrame:
    """Union areas of components by side and of all members, and the side that represents each."""
    a, b, edges, members = graph(spark, sf_dir)
    polygons = a.select("uid", "area", "wkb", *matching.BOX).unionByName(b.select("uid", "area", "wkb", *matching.BOX))
    table = matching.component_table(members, edges).select("component_id", "match_type").join(matching.union_areas(members, polygons), "component_id")
    return table.select("component_id", *fp.r6(*_UNIONS), matching.geometry_source().alias("geometry_source"))


UNION_AREA = oracle("SELECT component_id, " + ", ".join(fp.R6.format(c) for c in _UNIONS) + ", side AS geometry_source FROM reps", *UNION, recursive=True)


def merge_summary(spark, sf_dir: str) -> DataFrame:
    a, b, edges, members = graph(spark, sf_dir)
    return matching.summary(matching.component_table(members, edges).join(matching.b_attributes(members, b), "component_id", "left"))


MERGE_SUMMARY = oracle(
    "SELECT count(*) AS total, count(*) FILTER (match_type NOT IN ('A_only', 'B_only')) AS matched, count(*) FILTER (match_type = 'A_only') AS a_only, count(*) FILTER (match_type = 'B_only') AS b_only, count(median_height_b) AS with_height FROM sure",
    *GRAPH, recursive=True,
)


def matched(spark, sf_dir: str) -> DataFrame:
    """The components of both sources, with how sure their match is."""
    _, _, edges, members = graph(spark, sf_dir)
    table = matching.component_table(members, edges).withColumn("match_confidence", matching.match_confidence())
    return matching.matched(table).select("component_id", "match_type", "match_confidence")


MATCHED = oracle("SELECT component_id, match_type, match_confidence FROM sure WHERE match_type NOT IN ('A_only', 'B_only')", *GRAPH, recursive=True)
MATCH_TYPES = oracle("SELECT match_type, count(*) AS n FROM typed GROUP BY match_type", *GRAPH, recursive=True)


def filled(spark, sf_dir: str) -> DataFrame:
    """The whole chain: buildings, a model of their heights, and the heights that were missing filled."""
    table = checkpoint(buildings(spark, sf_dir))
    predicted, _ = modelling.fit_and_predict(table, "linear", modelling.FEATURE_SETS["baseline"])
    return validation.fill_heights(table, predicted)


def whole_chain(spark, sf_dir: str) -> DataFrame:
    """Validation of the filled table: what it counts doesn't depend on the values that a model gives."""
    table = checkpoint(filled(spark, sf_dir))
    parsed = kernels.wkb_to_geometry(F.col("rep_geometry"))
    shapes = checkpoint(table.select("*", kernels.st_is_valid(F.col("rep_geometry")).alias("__valid"), parsed.alias("__g")).withColumn("__area", geo.area("__g")))
    geometry = {
        "invalid_geom": F.count_if(~F.col("__valid")), "empty_geom": F.count_if(F.size("__g") == 0), "zero_area": F.count_if(F.col("__area") == 0), "negative_area": F.count_if(F.col("__area") < 0),
    }
    out = validation.score(shapes, geometry)
    kinds = shapes.agg(F.count_if(F.expr("target_height_was_predicted = 0")).alias("observed"), F.count_if(F.expr("target_height_was_predicted = 1")).alias("predicted"))
    return out.crossJoin(kinds).select("total", "observed", "predicted", "invalid_geom", "empty_geom", "zero_area", "negative_area", "filled_missing", "flag_mismatch", "observed_changed", "predicted_with_original", "score", "label")


_TOP = max(VALIDATION_LABELS)
WHOLE_CHAIN = oracle(
    "SELECT count(*) AS total, count(median_height_b) AS observed, count(*) - count(median_height_b) AS predicted, 0 AS invalid_geom, 0 AS empty_geom, 0 AS zero_area, 0 AS negative_area, 0 AS filled_missing, 0 AS flag_mismatch, "
    f"0 AS observed_changed, 0 AS predicted_with_original, 100 AS score, '{VALIDATION_LABELS.get(_TOP, VALIDATION_WORST)}' AS label FROM sure",
    *GRAPH, recursive=True,
)


# ---- shapes that meet, in Web Mercator

def _two(df: DataFrame) -> DataFrame:
    """The footprints in degrees, and every seventh again half a unit to the right."""
    rows = df.select("id", "minx", "miny", "maxx", "maxy", "w", "h")
    rows = rows.unionByName(rows.where("id % 7 = 0").withColumns({"id": -1 - F.col("id"), "minx": F.col("minx") + 0.5, "maxx": F.col("maxx") + 0.5}))
    return notched(_degrees(rows)).select("id", F.concat(F.lit("POLYGON "), "ring", F.lit(")")).alias("wkt"))


def meeting_shapes(spark, sf_dir: str) -> DataFrame:
    rows = checkpoint(reporting.measured(_two(footprints_a(spark, sf_dir)), "wkt"))
    return reporting.neighbor_counts(rows, rows).select("id", "neighbors_cnt")


def near_duplicates(spark, sf_dir: str) -> DataFrame:
    rows = checkpoint(reporting.measured(_two(footprints_b(spark, sf_dir)), "wkt"))
    return reporting.near_duplicates(rows).select("id_i", "id_j", *(F.round(c, 5).alias(c) for c in ("ratio_i", "ratio_j")))


def _two_sql(table: str) -> list[str]:
    return [
        f"t0 AS (SELECT id, x0, y0, w, h FROM {table} UNION ALL SELECT -1 - id, x0 + 0.5, y0, w, h FROM {table} WHERE id % 7 = 0)",
        f"t1 AS (SELECT id, {_EAST} + x0 * {_SCALE} AS minx, {_EAST} + (x0 + w) * {_SCALE} AS maxx, {_NORTH} + y0 * {_SCALE} AS miny, {_NORTH} + (y0 + h) * {_SCALE} AS maxy FROM t0)",
        "t2 AS (SELECT *, CASE WHEN id % 3 <> 0 THEN maxx - (maxx - minx) / 2 ELSE maxx END AS xm, CASE WHEN id % 3 <> 0 THEN maxy - (maxy - miny) / 2 ELSE maxy END AS ym FROM t1)",
        "t3 AS (SELECT id, " + ", ".join(f"{_x(c)} AS {c}" for c in ("minx", "maxx", "xm")) + ", " + ", ".join(f"{_y(c)} AS {c}" for c in ("miny", "maxy", "ym")) + " FROM t2)",
        "t AS (SELECT *, (maxx - minx) * (maxy - miny) - (maxx - xm) * (maxy - ym) AS area FROM t3)",
    ]


def _meet(p, q, slack: str = "1e-6") -> str:
    return f"({p[0]} <= {q[2]} + {slack} AND {q[0]} <= {p[2]} + {slack} AND {p[1]} <= {q[3]} + {slack} AND {q[1]} <= {p[3]} + {slack})"


MEETING_SHAPES = oracle(
    "SELECT l.id, count(*) - 1 AS neighbors_cnt FROM t l JOIN t r ON " + " OR ".join(_meet(p, q) for p in _pieces("l") for q in _pieces("r")) + " GROUP BY l.id", *_two_sql("fa")
)
_LR = " + ".join(_shared(p, q) for p in _pieces("l") for q in _pieces("r"))
NEAR_DUPLICATES = oracle(
    "SELECT id_i, id_j, round(inter / area_i, 5) AS ratio_i, round(inter / area_j, 5) AS ratio_j FROM (SELECT l.id AS id_i, r.id AS id_j, l.area AS area_i, r.area AS area_j, "
    f"{_LR} AS inter FROM t l JOIN t r ON l.id < r.id AND l.minx <= r.maxx AND r.minx <= l.maxx AND l.miny <= r.maxy AND r.miny <= l.maxy) WHERE inter / area_i > 0.8 AND inter / area_j > 0.8",
    *_two_sql("fb"),
)

# ---- buildings at any angle that share walls

_TURN, _UTM_X, _UTM_Y = 0.37, 500_000.0, 6_600_000.0


def _turned(points: list[tuple[Column, Column]]) -> Column:
    """The WKT ring of points in a building's own frame, turned by its angle and moved to its place."""
    a = F.col("id") * _TURN
    return _text([(F.lit(_UTM_X) + F.col("x0") + x * F.cos(a) - y * F.sin(a), F.lit(_UTM_Y) + F.col("y0") + x * F.sin(a) + y * F.cos(a)) for x, y in points])


def party_walls(spark, sf_dir: str) -> DataFrame:
    """Of each footprint at an angle: a terrace of three houses whose walls are shared in part, dissolved; and an outline that runs
    back along its own wall into an annex, repaired."""
    df = footprints_a(spark, sf_dir).select("id", "x0", "y0", "w", "h").withColumn("d", F.lit(3.0) + F.col("id") % 5)
    w, h, d, zero = F.col("w"), F.col("h"), F.col("d"), F.lit(0.0)

    def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        return _turned([(x1, y1), (x2, y1), (x2, y2), (x1, y2)])

    houses = [box(zero, zero, w, h), box(w, F.lit(0.5), w + d, h + 1), box(-d, F.lit(-1.0), zero, h / 2)]
    back = [(zero, zero), (w, zero), (w, h), (w / 4, h), (w / 4, zero), (w / 8, zero), (w / 8, -d), (zero, -d)]
    rings = [F.concat(F.lit("POLYGON "), r, F.lit(")")) for r in (*houses, _turned(back))]
    texts = df.select("id", F.posexplode(F.array(*rings)).alias("pos", "wkt"))
    read = cleaning.parse_geometry(texts, "wkt", degrees=False)
    whole = read.groupBy("id").agg(F.collect_list(F.when(F.col("pos") < 3, F.col("wkb"))).alias("houses"), F.max_by("was_valid", "pos").alias("was_valid"), F.max_by("area", "pos").alias("repaired_area"))
    whole = whole.withColumn("union", kernels.st_union(F.col("houses")))
    whole = checkpoint(whole.select("*", kernels.st_is_valid(F.col("union")).alias("valid"), kernels.wkb_to_geometry(F.col("union")).alias("g")))
    return whole.select("id", "valid", F.size("g").alias("parts"), F.size(F.flatten("g")).alias("rings"), F.round(geo.area("g"), 3).alias("union_area"), "was_valid", F.round("repaired_area", 3).alias("repaired_area"))


PARTY_WALLS = oracle(
    "SELECT id, true AS valid, 1 AS parts, 1 AS rings, round(w * h + d * (h + 0.5) + d * (h / 2 + 1), 3) AS union_area, false AS was_valid, round(w * h * 3 / 4 + w / 8 * d, 3) AS repaired_area "
    "FROM (SELECT id, w, h, 3.0::DOUBLE + id % 5 AS d FROM fa)"
)

def box_filter(spark, sf_dir: str) -> DataFrame:
    """Polygons written as GeoParquet along the Hilbert curve, and those whose box meets another read back."""
    rows = notched(footprints_a(spark, sf_dir))
    text = F.when(F.col("id") % 53 != 0, F.concat(F.lit("POLYGON "), "ring", F.lit(")")))
    path = staging_path(spark, "box-filter")
    geoparquet.write_geoparquet(rows.select("id", kernels.wkt_to_wkb(text).alias("wkb")), path)
    met = geoparquet.read_box(spark, path, _ASKED)
    return met.select("id", *(F.round(f"bbox.{k}", 6).alias(k) for k in ("xmin", "ymin", "xmax", "ymax")), F.octet_length("geometry").cast("long").alias("n_bytes"))


_ASKED = (700.0, 900.0, 1700.0, 2100.0)
BOX_FILTER = oracle(
    "SELECT id, round(minx, 6) AS xmin, round(miny, 6) AS ymin, round(maxx, 6) AS xmax, round(maxy, 6) AS ymax, CAST(CASE WHEN id % 3 <> 0 THEN 125 ELSE 93 END AS BIGINT) AS n_bytes "
    "FROM fa WHERE id % 53 <> 0 AND minx <= {2} AND maxx >= {0} AND miny <= {3} AND maxy >= {1}".format(*_ASKED)
)

QUERIES = {
    "source_box_filter": (box_filter, BOX_FILTER),
    "geo_party_walls": (party_walls, PARTY_WALLS),
    "flagship_match_types": (match_types, MATCH_TYPES),
    "clean_geometry_audit": (geometry_audit, GEOMETRY_AUDIT),
    "clean_geometry_summary": (geometry_summary, GEOMETRY_SUMMARY),
    "join_polygon_metrics": (polygon_metrics, POLYGON_METRICS),
    "join_neighbor_counts_self": (meeting_shapes, MEETING_SHAPES),
    "join_near_duplicates": (near_duplicates, NEAR_DUPLICATES),
    "match_union_area": (union_area, UNION_AREA),
    "match_summary": (merge_summary, MERGE_SUMMARY),
    "match_matched": (matched, MATCHED),
    "match_final_table": (final_table, FINAL_TABLE),
    "chain_raw_to_validated": (whole_chain, WHOLE_CHAIN),
}
