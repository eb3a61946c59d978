"""Queries over the footprint fixtures, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.operators import cleaning, matching, neighbors
from plinth.plans.fixtures import IRRELEVANT, footprints_a, footprints_b, oracle
from plinth.storage import checkpoint, row_count

BOX_KEY = ["minx", "miny", "maxx", "maxy"]
R6 = "round({0}, 6) AS {0}"


def r6(*cols: str):
    return [F.round(c, 6).alias(c) for c in cols]


# ---- cleaning

def small_area(spark, sf_dir: str) -> DataFrame:
    out = None
    for name, rows in (("A", footprints_a(spark, sf_dir)), ("B", footprints_b(spark, sf_dir))):
        kept, audit = cleaning.drop_small(cleaning.begin(rows))
        part = kept.select(F.lit(name).alias("source"), "row_idx", F.lit("").alias("drop_reason")).unionByName(audit.select(F.lit(name).alias("source"), "row_idx", "drop_reason"))
        out = part if out is None else out.unionByName(part)
    return out


SMALL_AREA = oracle(
    "SELECT 'A' AS source, id AS row_idx, CASE WHEN area < 15 THEN 'small_utility_object' ELSE '' END AS drop_reason FROM fa "
    "UNION ALL SELECT 'B', id, CASE WHEN area < 15 THEN 'small_utility_object' ELSE '' END FROM fb"
)


def swap_floors(spark, sf_dir: str) -> DataFrame:
    return cleaning.swap_floors(cleaning.begin(footprints_a(spark, sf_dir))).select("id", "gkh_floor_count_min", "gkh_floor_count_max", "status", "quality_flags")


SWAP_FLOORS = oracle(
    "SELECT id, CASE WHEN bad THEN gkh_floor_count_max ELSE gkh_floor_count_min END AS gkh_floor_count_min, CASE WHEN bad THEN gkh_floor_count_min ELSE gkh_floor_count_max END AS gkh_floor_count_max, "
    "CASE WHEN bad THEN 'repaired' ELSE 'clean' END AS status, CASE WHEN bad THEN 'swapped_min_max;' ELSE '' END AS quality_flags "
    "FROM (SELECT *, coalesce(gkh_floor_count_min > gkh_floor_count_max, false) AS bad FROM fa)"
)


def floor_height(spark, sf_dir: str) -> DataFrame:
    rows, _ = cleaning.drop_small(cleaning.begin(footprints_b(spark, sf_dir)))
    return cleaning.fill_floor_height(rows).select("id", "avg_floor_height", "status", "quality_flags")


B_BIG = "b1 AS (SELECT * FROM fb WHERE area >= 15)"
B_FILLED = (
    "b2 AS (SELECT b1.* REPLACE (CASE WHEN avg_floor_height = 0 THEN coalesce(m, (SELECT median(avg_floor_height) FROM b1)) ELSE avg_floor_height END AS avg_floor_height), "
    "CASE WHEN avg_floor_height = 0 THEN 'filled_avg_floor_height;' ELSE '' END AS flags FROM b1 LEFT JOIN (SELECT purpose_of_building AS g, median(avg_floor_height) AS m FROM b1 "
    "WHERE purpose_of_building IS NOT NULL GROUP BY 1) ON purpose_of_building = g)"
)
FLOOR_HEIGHT = oracle("SELECT id, avg_floor_height, CASE WHEN flags = '' THEN 'clean' ELSE 'repaired' END AS status, flags AS quality_flags FROM b2", B_BIG, B_FILLED)


def outlier_reasons(spark, sf_dir: str) -> DataFrame:
    rows, _ = cleaning.drop_small(cleaning.begin(footprints_b(spark, sf_dir)))
    return cleaning.drop_outliers(cleaning.fill_floor_height(rows))[1]


REASON = (
    "concat_ws(';', CASE WHEN stairs <= 0 THEN 'stairs_invalid' END, CASE WHEN avg_floor_height > 10 THEN 'avg_floor_height_too_high' END, CASE WHEN height IS NULL THEN 'missing_height' END)"
)
OUTLIER_REASONS = oracle(f"SELECT id AS row_idx, {REASON} AS drop_reason FROM b2 WHERE {REASON} <> ''", B_BIG, B_FILLED)


def purpose_and_stairs(spark, sf_dir: str) -> DataFrame:
    rows, _ = cleaning.drop_small(cleaning.begin(footprints_b(spark, sf_dir)))
    rows, _ = cleaning.drop_outliers(cleaning.fill_floor_height(rows))
    return cleaning.fill_stairs(cleaning.fill_purpose(rows)).select("id", "purpose_of_building", "stairs", "status", "quality_flags")


B_KEPT = f"b3 AS (SELECT * REPLACE (coalesce(purpose_of_building, 'unknown') AS purpose_of_building) FROM b2 WHERE {REASON} = '')"
B_STAIRS = (
    "b4 AS (SELECT b3.* REPLACE (CASE WHEN stairs IS NULL THEN m ELSE stairs END AS stairs, flags || CASE WHEN stairs IS NULL THEN 'filled_stairs;' ELSE '' END AS flags) "
    "FROM b3 LEFT JOIN (SELECT purpose_of_building AS g, median(stairs) AS m FROM b3 GROUP BY 1) ON purpose_of_building = g)"
)
PURPOSE_AND_STAIRS = oracle(
    "SELECT id, purpose_of_building, stairs, CASE WHEN flags = '' THEN 'clean' ELSE 'repaired' END AS status, flags AS quality_flags FROM b4", B_BIG, B_FILLED, B_KEPT, B_STAIRS
)


def relevance_flag(spark, sf_dir: str) -> DataFrame:
    return cleaning.relevance(cleaning.begin(footprints_b(spark, sf_dir)), IRRELEVANT).select("id", "is_relevant_building")


RELEVANCE_FLAG = oracle(f"SELECT id, coalesce(purpose_of_building <> '{IRRELEVANT}', true) AS is_relevant_building FROM fb")


def dedupe_keep_first(spark, sf_dir: str) -> DataFrame:
    rows = footprints_a(spark, sf_dir).select("id", *BOX_KEY)
    rows = rows.unionByName(rows.where("id % 3 = 0").withColumn("id", F.col("id") + 1_000_000)).withColumnRenamed("id", "row_idx")
    kept, audit = cleaning.drop_duplicates(rows, BOX_KEY)
    return kept.select("row_idx", F.lit("").alias("drop_reason")).unionByName(audit)


DEDUPE = oracle(
    "SELECT row_idx, CASE WHEN row_number() OVER (PARTITION BY minx, miny, maxx, maxy ORDER BY row_idx) > 1 THEN 'duplicate' ELSE '' END AS drop_reason "
    "FROM (SELECT id AS row_idx, minx, miny, maxx, maxy FROM fa UNION ALL SELECT id + 1000000, minx, miny, maxx, maxy FROM fa WHERE id % 3 = 0)"
)


def clean_summary(spark, sf_dir: str) -> DataFrame:
    a, b = footprints_a(spark, sf_dir), footprints_b(spark, sf_dir)
    return cleaning.summary("A", a, *cleaning.clean_a(a, IRRELEVANT, BOX_KEY)).unionByName(cleaning.summary("B", b, *cleaning.clean_b(b, IRRELEVANT, BOX_KEY)))


def _summary_sql(source: str, raw: str, final: str, audit: str) -> str:
    return (
        f"SELECT '{source}' AS source, 'original' AS metric, count(*) AS value FROM {raw} UNION ALL SELECT '{source}', 'kept', count(*) FROM {final} "
        f"UNION ALL SELECT '{source}', 'repaired', count(*) FILTER (flags <> '') FROM {final} UNION ALL SELECT '{source}', 'relevant', count(*) FILTER (ok) FROM {final} "
        f"UNION ALL SELECT '{source}', 'dropped:' || r, count(*) FROM ({audit}) GROUP BY r"
    )


_NTH = "row_number() OVER (PARTITION BY minx, miny, maxx, maxy ORDER BY id)"
CLEAN_SUMMARY = oracle(
    _summary_sql("A", "fa", "a5", "SELECT 'small_utility_object' AS r FROM fa WHERE area < 15 UNION ALL SELECT 'duplicate' FROM a4 WHERE nth > 1")
    + " UNION ALL "
    + _summary_sql("B", "fb", "b8", f"SELECT 'small_utility_object' AS r FROM fb WHERE area < 15 UNION ALL SELECT {REASON} FROM b2 WHERE {REASON} <> '' UNION ALL SELECT 'duplicate' FROM b6 WHERE nth > 1"),
    B_BIG, B_FILLED,
    f"a4 AS (SELECT *, CASE WHEN gkh_floor_count_min > gkh_floor_count_max THEN 's' ELSE '' END AS flags, true AS ok, {_NTH} AS nth FROM fa WHERE area >= 15)",
    "a5 AS (SELECT * FROM a4 WHERE nth = 1)",
    f"b6 AS (SELECT *, {_NTH} AS nth FROM b2 WHERE {REASON} = '')",
    f"b8 AS (SELECT flags || CASE WHEN stairs IS NULL THEN 's' ELSE '' END AS flags, coalesce(purpose_of_building, 'unknown') <> '{IRRELEVANT}' AS ok FROM b6 WHERE nth = 1)",
)


def consistency(spark, sf_dir: str) -> DataFrame:
    return cleaning.consistency(footprints_b(spark, sf_dir))


CONSISTENCY = oracle(
    "SELECT count(*) AS n, count(*) FILTER (height / nullif(stairs, 0) < 2) AS low_floor, count(*) FILTER (height / nullif(stairs, 0) > 6) AS high_floor, "
    "count(*) FILTER (abs(height - stairs * avg_floor_height) > 10) AS large_error FROM fb"
)


# ---- matching of boxes: relevance and imputation are left to the queries over polygons

def match_inputs(spark, sf_dir: str, *cols: str) -> tuple[DataFrame, DataFrame]:
    """A and B as they are matched: all columns, or ``cols`` and what numbers the rows."""
    a, _ = cleaning.drop_small(cleaning.begin(footprints_a(spark, sf_dir)))
    b, _ = cleaning.drop_small(cleaning.begin(footprints_b(spark, sf_dir)))
    b, _ = cleaning.drop_outliers(b)
    if cols:
        a, b = a.select("id", *cols), b.select("id", *cols)
    return matching.with_uids(a, "A"), matching.with_uids(b, "B")


MATCH = [
    "a AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS node, 'A_' || (row_number() OVER (ORDER BY id) - 1) AS uid FROM fa WHERE area >= 15)",
    f"b AS (SELECT *, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY id) - 1 AS node, 'B_' || (row_number() OVER (ORDER BY id) - 1) AS uid FROM fb WHERE area >= 15 AND {REASON} = '')",
    "gaps AS (SELECT a.uid AS uid_a, b.uid AS uid_b, a.node AS node_a, b.node AS node_b, a.area AS area_a, b.area AS area_b, a.perimeter AS perimeter_a, b.perimeter AS perimeter_b, "
    "greatest(0.0, b.minx - a.maxx, a.minx - b.maxx) AS dx, greatest(0.0, b.miny - a.maxy, a.miny - b.maxy) AS dy, "
    "greatest(0.0, least(a.maxx, b.maxx) - greatest(a.minx, b.minx)) * greatest(0.0, least(a.maxy, b.maxy) - greatest(a.miny, b.miny)) AS intersection_area, "
    "sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) AS centroid_dist_m "
    "FROM a JOIN b ON a.minx <= b.maxx + 0.5 AND b.minx <= a.maxx + 0.5 AND a.miny <= b.maxy + 0.5 AND b.miny <= a.maxy + 0.5)",
    "pairs AS (SELECT *, sqrt(dx * dx + dy * dy) AS dist_m, area_a + area_b - intersection_area AS union_area, least(area_a, area_b) AS min_area FROM gaps WHERE sqrt(dx * dx + dy * dy) <= 0.5)",
    "metrics AS (SELECT *, intersection_area / union_area AS iou, intersection_area / area_a AS overlap_a, intersection_area / area_b AS overlap_b, intersection_area / min_area AS rel_intersection_min FROM pairs)",
    "edges AS (SELECT * FROM metrics WHERE iou >= 0.15 OR overlap_a >= 0.6 OR overlap_b >= 0.6 OR (dist_m <= 1 AND rel_intersection_min >= 0.05))",
]
GRAPH = [
    *MATCH,
    "nodes AS (SELECT uid, 'A' AS src, node FROM a UNION ALL SELECT uid, 'B', node FROM b)",
    "links AS (SELECT node_a AS u, node_b AS v FROM edges UNION ALL SELECT node_b, node_a FROM edges)",
    "reach AS (SELECT node AS u, node AS c FROM nodes UNION SELECT links.v, reach.c FROM reach JOIN links ON reach.u = links.u)",
    "label AS (SELECT u AS node, min(c) AS label FROM reach GROUP BY u)",
    "members AS (SELECT nodes.*, dense_rank() OVER (ORDER BY label) AS component_id FROM nodes JOIN label USING (node))",
    "sized AS (SELECT component_id, count(*) FILTER (src = 'A') AS n_a, count(*) FILTER (src = 'B') AS n_b, "
    "array_to_string(list_sort(list(uid) FILTER (src = 'A')), ',') AS uids_a, array_to_string(list_sort(list(uid) FILTER (src = 'B')), ',') AS uids_b FROM members GROUP BY component_id)",
    "typed AS (SELECT *, CASE WHEN n_b = 0 THEN 'A_only' WHEN n_a = 0 THEN 'B_only' WHEN n_a = 1 AND n_b = 1 THEN '1:1' WHEN n_a = 1 THEN '1:n' WHEN n_b = 1 THEN 'n:1' ELSE 'n:n' END AS match_type FROM sized)",
    "edged AS (SELECT component_id, count(*) AS n_edges_ab, max(iou) AS max_iou, avg(iou) AS mean_iou, max(overlap_a) AS max_overlap_a, max(overlap_b) AS max_overlap_b, min(dist_m) AS min_dist_m "
    "FROM edges JOIN members ON edges.uid_a = members.uid GROUP BY component_id)",
    "comps AS (SELECT typed.*, coalesce(n_edges_ab, 0) AS n_edges_ab, max_iou, mean_iou, max_overlap_a, max_overlap_b, min_dist_m FROM typed LEFT JOIN edged USING (component_id))",
    "purposes AS (SELECT component_id, purpose_of_building, row_number() OVER (PARTITION BY component_id ORDER BY count(*) DESC, purpose_of_building) AS nth "
    "FROM members JOIN b USING (uid) WHERE purpose_of_building IS NOT NULL GROUP BY 1, 2)",
    "battr AS (SELECT component_id, count(height) AS n_b_with_height, median(height) AS median_height_b, median(stairs) AS median_stairs_b, median(avg_floor_height) AS median_avg_floor_height_b "
    "FROM members JOIN b USING (uid) GROUP BY component_id)",
    "sure AS (SELECT comps.*, n_b_with_height, median_height_b, median_stairs_b, median_avg_floor_height_b, purposes.purpose_of_building AS mode_purpose_b, "
    "CASE WHEN match_type IN ('A_only', 'B_only') THEN 'none' WHEN coalesce(max_iou >= 0.5 OR max_overlap_a >= 0.8 OR max_overlap_b >= 0.8, false) THEN 'high' "
    "WHEN coalesce(max_iou >= 0.15 OR max_overlap_a >= 0.6 OR max_overlap_b >= 0.6, false) THEN 'medium' ELSE 'low' END AS match_confidence "
    "FROM comps LEFT JOIN battr USING (component_id) LEFT JOIN purposes ON comps.component_id = purposes.component_id AND nth = 1)",
    "areas AS (SELECT component_id, coalesce(sum(area) FILTER (src = 'A'), 0.0) AS sum_area_a, coalesce(sum(area) FILTER (src = 'B'), 0.0) AS sum_area_b "
    "FROM members JOIN (SELECT uid, area FROM a UNION ALL SELECT uid, area FROM b) USING (uid) GROUP BY component_id)",
]


def _pairs(spark, sf_dir: str) -> DataFrame:
    """Metrics of the pairs of lists of equal boxes (``matching.unlisted`` makes a row a pair of them)."""
    return matching.pair_metrics(matching.listed_pairs(*match_inputs(spark, sf_dir, *matching.MEASURES)))


def _graph(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(A, B, edges between kinds of footprints, members)."""
    a, b = match_inputs(spark, sf_dir)
    a, kinds_a = matching.kinds(a)
    b, kinds_b = matching.kinds(b, row_count(a))
    edges = matching.linked(kinds_a, kinds_b, shapes=False)
    nodes = a.select("uid", "src", "node", "rep").unionByName(b.select("uid", "src", "node", "rep"))
    return a, b, edges, checkpoint(matching.components(nodes, edges))


def component_features(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(components with attributes, targets, areas and their representative's centroid; A; B; members)."""
    a, b, edges, members = _graph(spark, sf_dir)
    table = matching.component_table(members, edges).join(matching.b_attributes(members, b), "component_id", "left").join(matching.sum_areas(members, a, b), "component_id")
    return checkpoint(matching.targets(table)), a, b, members


def candidate_pairs(spark, sf_dir: str) -> DataFrame:
    return matching.unlisted(_pairs(spark, sf_dir).select("uid_a", "uid_b"))


CANDIDATE_PAIRS = oracle("SELECT uid_a, uid_b FROM pairs", *MATCH)
METRICS = ["intersection_area", "union_area", "iou", "overlap_a", "overlap_b", "dist_m", "centroid_dist_m", "min_area", "rel_intersection_min"]


def pair_metrics(spark, sf_dir: str) -> DataFrame:
    return matching.unlisted(_pairs(spark, sf_dir).select("uid_a", "uid_b", "area_a", "area_b", "perimeter_a", "perimeter_b", *r6(*METRICS)))


PAIR_METRICS = oracle("SELECT uid_a, uid_b, area_a, area_b, perimeter_a, perimeter_b, " + ", ".join(R6.format(m) for m in METRICS) + " FROM metrics", *MATCH)


def edges(spark, sf_dir: str) -> DataFrame:
    return matching.unlisted(_pairs(spark, sf_dir).select("uid_a", "uid_b", *r6("iou"), matching.edge_rule().alias("edge")), "edge")


EDGES = oracle("SELECT uid_a, uid_b, round(iou, 6) AS iou FROM edges", *MATCH)


def graph_components(spark, sf_dir: str) -> DataFrame:
    return _graph(spark, sf_dir)[3].select("uid", "src", "node", "component_id")


GRAPH_COMPONENTS = oracle("SELECT uid, src, node, component_id FROM members", *GRAPH, recursive=True)
EDGE_STATS = ["max_iou", "mean_iou", "max_overlap_a", "max_overlap_b", "min_dist_m"]


def component_table(spark, sf_dir: str) -> DataFrame:
    _, _, edges_, members = _graph(spark, sf_dir)
    table = matching.component_table(members, edges_)
    lists = [F.when(F.size(c) > 0, F.array_join(c, ",")).alias(c) for c in ("uids_a", "uids_b")]
    return table.select("component_id", *lists, "n_a", "n_b", "match_type", "n_edges_ab", *r6(*EDGE_STATS))


COMPONENT_TABLE = oracle("SELECT component_id, uids_a, uids_b, n_a, n_b, match_type, n_edges_ab, " + ", ".join(R6.format(m) for m in EDGE_STATS) + " FROM comps", *GRAPH, recursive=True)


def component_sizes(spark, sf_dir: str) -> DataFrame:
    members = _graph(spark, sf_dir)[3]
    sizes = members.groupBy("component_id").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy("size").limit(20)


COMPONENT_SIZES = oracle("SELECT size, count(*) AS n FROM (SELECT label, count(*) AS size FROM label GROUP BY 1) GROUP BY size QUALIFY row_number() OVER (ORDER BY size) <= 20", *GRAPH[: len(MATCH) + 4], recursive=True)


def confidence_reliability(spark, sf_dir: str) -> DataFrame:
    table = component_features(spark, sf_dir)[0]
    return table.select(
        "component_id", F.coalesce("n_b_with_height", F.lit(0)).alias("n_b_with_height"), "median_height_b", "median_stairs_b", "median_avg_floor_height_b", "mode_purpose_b",
        "match_confidence", F.col("target_height_is_observed").cast("int").alias("target_height_is_observed"), "target_height_source", "target_height_source_detail", "target_height_reliability",
    )


_RELIABILITY = "CASE WHEN median_height_b IS NULL THEN 'none' WHEN match_type = 'B_only' THEN 'high' WHEN match_type = '1:1' AND match_confidence = 'high' THEN 'high' WHEN match_confidence IN ('high', 'medium') THEN 'medium' ELSE 'low' END AS target_height_reliability"
_DETAIL = "CASE WHEN median_height_b IS NULL THEN 'missing' " + " ".join(f"WHEN match_type = '{k}' THEN '{v}'" for k, v in matching.HEIGHT_DETAIL.items()) + " ELSE 'B_observed_other' END AS target_height_source_detail"
CONFIDENCE_RELIABILITY = oracle(
    "SELECT component_id, coalesce(n_b_with_height, 0) AS n_b_with_height, median_height_b, median_stairs_b, median_avg_floor_height_b, mode_purpose_b, match_confidence, "
    "CASE WHEN median_height_b IS NULL THEN 0 ELSE 1 END AS target_height_is_observed, CASE WHEN median_height_b IS NULL THEN 'missing' ELSE 'B_observed' END AS target_height_source, "
    f"{_DETAIL}, {_RELIABILITY} FROM sure",
    *GRAPH, recursive=True,
)


# ---- neighbourhoods: the points are B's footprints with their heights

FEATURES = [f"{n}_{r}m" for r in neighbors.RADII for n in ("n_neighbors", "n_neighbors_obs_height", *(f"neighbor_height_{s}" for s in neighbors.STATS))]
_ROUNDED = [f for f in FEATURES if f.startswith("neighbor_height_")]


def _points(spark, sf_dir: str) -> DataFrame:
    return footprints_b(spark, sf_dir).select(F.col("id").alias("component_id"), F.col("height").alias("target_height"), "cx", "cy")


def neighbor_features(spark, sf_dir: str) -> DataFrame:
    found = neighbors.neighbor_features(_points(spark, sf_dir))
    return found.select("component_id", *(F.round(f, 6).alias(f) if f in _ROUNDED else f for f in FEATURES))


def _stats_sql(r: int) -> str:
    f = f"FILTER (d <= {r})"
    v = {"mean": "avg(nh)", "median": "median(nh)", "min": "min(nh)", "max": "max(nh)", "std": "stddev_samp(nh)", "q25": "quantile_cont(nh, 0.25)", "q75": "quantile_cont(nh, 0.75)"}
    return f"count(d) {f} AS n_neighbors_{r}m, count(nh) {f} AS n_neighbors_obs_height_{r}m, " + ", ".join(f"round({e} {f}, 6) AS neighbor_height_{s}_{r}m" for s, e in v.items())


_NEAR = "near AS (SELECT l.id, r.height AS nh, sqrt((l.cx - r.cx) * (l.cx - r.cx) + (l.cy - r.cy) * (l.cy - r.cy)) AS d FROM fb l JOIN fb r ON l.id <> r.id AND abs(l.cx - r.cx) <= 100 AND abs(l.cy - r.cy) <= 100)"
_FEATURES_CTE = f"feats AS (SELECT fb.id AS component_id, {', '.join(_stats_sql(r) for r in neighbors.RADII)} FROM fb LEFT JOIN near USING (id) GROUP BY fb.id)"
NEIGHBOR_FEATURES = oracle("SELECT * FROM feats", _NEAR, _FEATURES_CTE)


def neighbor_indicators(spark, sf_dir: str) -> DataFrame:
    return neighbors.missing_indicators(neighbor_features(spark, sf_dir))


NEIGHBOR_INDICATORS = oracle(
    "SELECT component_id, " + ", ".join(f if f not in _ROUNDED else f"coalesce({f}, 0.0) AS {f}, CASE WHEN {f} IS NULL THEN 0 ELSE 1 END AS has_{f}" for f in FEATURES) + " FROM feats", _NEAR, _FEATURES_CTE
)

QUERIES = {
    "clean_small_area": (small_area, SMALL_AREA),
    "clean_swap_floors": (swap_floors, SWAP_FLOORS),
    "clean_impute_floor_height": (floor_height, FLOOR_HEIGHT),
    "clean_outlier_reasons": (outlier_reasons, OUTLIER_REASONS),
    "clean_purpose_and_stairs": (purpose_and_stairs, PURPOSE_AND_STAIRS),
    "clean_relevance_flag": (relevance_flag, RELEVANCE_FLAG),
    "clean_dedupe_keep_first": (dedupe_keep_first, DEDUPE),
    "clean_summary": (clean_summary, CLEAN_SUMMARY),
    "clean_consistency": (consistency, CONSISTENCY),
    "join_candidate_pairs": (candidate_pairs, CANDIDATE_PAIRS),
    "join_pair_metrics": (pair_metrics, PAIR_METRICS),
    "join_edges": (edges, EDGES),
    "graph_components": (graph_components, GRAPH_COMPONENTS),
    "graph_component_table": (component_table, COMPONENT_TABLE),
    "graph_component_sizes": (component_sizes, COMPONENT_SIZES),
    "match_confidence_reliability": (confidence_reliability, CONFIDENCE_RELIABILITY),
    "neighbor_features_50_100": (neighbor_features, NEIGHBOR_FEATURES),
    "neighbor_missing_indicators": (neighbor_indicators, NEIGHBOR_INDICATORS),
}
