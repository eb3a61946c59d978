"""Matching two footprint sources: pairs, metrics, edges, components and what they carry."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.functions import geometry as geo
from plinth.functions import kernels, pairs
from plinth.functions.numeric import ratio
from plinth.functions.ragged import measures
from plinth.operators.graph import _stars, connected_components, stars
from plinth.operators.neighbors import neighbor_features
from plinth.operators.ranking import running_total
from plinth.operators.spatial_join import BOX, MOST_CELLS, box_groups, box_join, cell_size, own_level
from plinth.storage import checkpoint, row_count, spread

BUFFER_M = 0.5
CELL_M = 64.0
#: Polygons that are dissolved together at first, and unions that are afterwards.
FIRST_UNION, NEXT_UNION = 256, 16
#: Rows of one kind that a list holds, about, at most.
LISTED = 64
MEASURES = [*BOX, "area", "perimeter", "cx", "cy"]
IOU, OVERLAP, DISTANCE_M, REL_INTERSECTION = 0.15, 0.60, 1.0, 0.05


def with_uids(df: DataFrame, source: str, order: str = "id") -> DataFrame:
    """Add ``ordinal`` (position in order, from 0), ``src`` and ``uid``."""
    return running_total(df, [F.col(order)], {"ordinal": F.lit(1)}).withColumns({"src": F.lit(source), "uid": F.concat(F.lit(f"{source}_"), F.col("ordinal").cast("string"))})


def box_distance(a: str = "l", b: str = "r") -> Column:
    """Distance between the boxes of two struct columns."""
    gap = [F.greatest(F.lit(0.0), F.col(f"{b}.min{x}") - F.col(f"{a}.max{x}"), F.col(f"{a}.min{x}") - F.col(f"{b}.max{x}")) for x in "xy"]
    return F.sqrt(gap[0] * gap[0] + gap[1] * gap[1])


def box_intersection(a: str = "l", b: str = "r") -> Column:
    """Area that the boxes of two struct columns share."""
    side = [F.greatest(F.lit(0.0), F.least(f"{a}.max{x}", f"{b}.max{x}") - F.greatest(f"{a}.min{x}", f"{b}.min{x}")) for x in "xy"]
    return side[0] * side[1]


def candidate_pairs(a: DataFrame, b: DataFrame, reach: float = BUFFER_M) -> DataFrame:
    """Pairs (l, r) of footprints at most ``reach`` apart: those a buffer of that width would touch."""
    return box_join(a, b, CELL_M, reach).where(box_distance() <= reach)


def _same(cols: list[str]) -> Column:
    """Whether a row agrees in ``cols`` with the kind whose columns are named with __ before them."""
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cols])


def listed(df: DataFrame) -> DataFrame:
    """Rows of one kind as lists: MEASURES, and ``uid`` the array of their uids, LISTED of them or so at most.

    Rows of one kind agree in all that ``pair_metrics`` reads of boxes, so a pair of lists is measured once.
    """
    rows = df.select("uid", *MEASURES)
    large = rows.groupBy(*MEASURES).agg(F.ceil(F.count(F.lit(1)) / LISTED).alias("__parts")).where("__parts > 1")  # far fewer than rows
    part = F.coalesce(F.pmod(F.xxhash64("uid"), F.col("__parts")), F.lit(0)).alias("__part")
    rows = rows.join(large.withColumnsRenamed({c: f"__{c}" for c in MEASURES}), _same(MEASURES), "left").select("uid", *MEASURES, part)
    return checkpoint(rows.groupBy(*MEASURES, "__part").agg(F.collect_list("uid").alias("uid")).drop("__part"))


def listed_pairs(a: DataFrame, b: DataFrame, reach: float = BUFFER_M) -> DataFrame:
    """``candidate_pairs`` of lists (``listed``): l.uid and r.uid are arrays, each of the one making a pair with each of the other."""
    return box_join(listed(a), listed(b), CELL_M, reach, lists="uid").where(box_distance() <= reach)


def unlisted(found: DataFrame, where: str | None = None) -> DataFrame:
    """A row a pair, of what was measured of pairs of lists (``uid_a`` and ``uid_b``) and, with ``where``, has that column true.

    Pairs don't leave the task that found them. An array that is null gives no row; were it a filter, Spark would move its
    whole expression into the condition of the join, in a method of over 8,000 bytes, which the JVM doesn't compile.
    """
    uids = F.col("uid_a") if where is None else F.when(F.col(where), F.col("uid_a"))
    rest = [c for c in found.columns if c not in ("uid_a", "uid_b", where)]
    return found.select(F.explode(uids).alias("uid_a"), "uid_b", *rest).select("uid_a", F.explode("uid_b").alias("uid_b"), *rest)


def shapes(df: DataFrame, degrees: bool = True, zone: int = 35) -> DataFrame:
    """Add the measures that matching needs of ``wkb``, in UTM metres where it is in degrees: wkb itself, box, area, perimeter, cx, cy."""
    out = df
    if degrees:
        out = out.withColumn("__g", kernels.wkb_to_geometry(F.col("wkb"))).withColumn("__g", geo.to_mercator("__g"))
        out = out.withColumn("__g", geo.mercator_to_utm("__g", zone)).withColumn("wkb", kernels.geometry_to_wkb(F.col("__g"))).drop("__g")
    out = out.withColumn("__m", measures(F.col("wkb")))
    return out.withColumns({c: F.col(f"__m.{c}") for c in MEASURES}).drop("__m")


def polygon_pairs(a: DataFrame, b: DataFrame, reach: float = BUFFER_M) -> DataFrame:
    """Pairs (l, r) of polygons at most ``reach`` apart, with their ``dist`` and the area ``inter`` that they share.

    A buffer of A of that width meets B exactly then. Boxes are tested before the kernel.
    """
    cols = ["uid", "area", "perimeter", "cx", "cy"]
    kind = "struct<uid:string,area:double,perimeter:double,cx:double,cy:double>"

    def found(left: pa.Table, right: pa.Table):
        l, r = (pa.StructArray.from_arrays([t[c].combine_chunks() for c in cols], cols) for t in (left, right))
        measure = _measures(left, right, True)

        def take(ij):
            if ij is None:
                return None
            i, j, dist, inter = _within(*ij, *measure(*ij), reach)
            return pa.Table.from_arrays([l.take(pa.array(i)), r.take(pa.array(j)), pa.array(dist), pa.array(inter)], ["l", "r", "dist", "inter"])

        return take

    return box_groups(a.select(*cols, "wkb", *BOX), b.select(*cols, "wkb", *BOX), CELL_M, found, f"l {kind}, r {kind}, dist double, inter double", reach)


def _within(i: np.ndarray, j: np.ndarray, dist: np.ndarray, inter: np.ndarray, reach: float):
    near = dist <= reach
    return i[near], j[near], dist[near], inter[near]


def _measures(left: pa.Table, right: pa.Table, shapes: bool):
    """A function of pairs (i, j) that gives their distances and shared areas: of polygons, or of boxes."""
    if shapes:
        a, b = (pairs.Side(t["wkb"].to_pylist()) for t in (left, right))
        boxes = [np.stack([t[c].to_numpy() for c in BOX], axis=1) for t in (left, right)]
    else:
        x, y = ([t[c].to_numpy() for c in BOX] for t in (left, right))

    def of_boxes(i: np.ndarray, j: np.ndarray):
        p, q = [c[i] for c in x], [c[j] for c in y]
        gap = [np.maximum(0.0, np.maximum(q[d] - p[d + 2], p[d] - q[d + 2])) for d in (0, 1)]
        side = [np.maximum(0.0, np.minimum(p[d + 2], q[d + 2]) - np.maximum(p[d], q[d])) for d in (0, 1)]
        return np.sqrt(gap[0] * gap[0] + gap[1] * gap[1]), side[0] * side[1]

    def of_shapes(i: np.ndarray, j: np.ndarray):
        p, q = boxes[0][i], boxes[1][j]
        gap = np.maximum(0.0, np.maximum(q[:, :2] - p[:, 2:], p[:, :2] - q[:, 2:]))
        dist, inter = np.sqrt((gap * gap).sum(axis=1)), np.zeros(len(i))
        near = dist <= BUFFER_M  # boxes before shapes
        dist[near], inter[near] = pairs.measures(a, b, i[near], j[near])
        return dist, inter

    return of_shapes if shapes else of_boxes


_EDGE = [("node_a", "long"), ("node_b", "long"), ("n", "long"), ("iou_sum", "double"), ("iou_n", "long"), ("iou", "double"), ("overlap_a", "double"), ("overlap_b", "double"), ("dist_m", "double")]


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(len(a)), where=b > 0)


def linked(a: DataFrame, b: DataFrame, shapes: bool, reach: float = BUFFER_M) -> DataFrame:
    """The edges between kinds (node, n, MEASURES and, for ``shapes``, wkb), summed up in the tasks that find them.

    A row joins two nodes of a component; those with n > 0 tell how many edges node_a (of A) has in that group of boxes,
    and their ious' sum and number, largest iou and overlaps and least distance. Rows are as many as kinds, not as pairs.
    """

    def found(left: pa.Table, right: pa.Table):
        measure = _measures(left, right, shapes)
        (na, wa, aa), (nb, wb, ab) = ([t[c].to_numpy() for c in ("node", "n", "area")] for t in (left, right))
        count, sums, known = np.zeros(len(na), np.int64), np.zeros(len(na)), np.zeros(len(na), np.int64)
        best = [np.full(len(na), np.nan) for _ in range(3)]
        least, ends = np.full(len(na), np.nan), []

        def take(ij):
            if ij is None:
                if not ends:
                    return None
                node, label = _stars(*(np.concatenate([e[k] for e in ends]) for k in (0, 1)))
                some = np.flatnonzero(count)
                at = np.searchsorted(node, na[some])
                nodes = np.concatenate([na[some], np.delete(node, at)])
                labels, empty = np.concatenate([label[at], np.delete(label, at)]), np.full(len(node) - len(some), np.nan)
                values = [np.concatenate([v[some], empty.astype(v.dtype) if v.dtype != np.int64 else np.zeros(len(empty), np.int64)]) for v in (count, sums, known, *best, least)]
                return pa.Table.from_arrays([pa.array(nodes), pa.array(labels), *(pa.array(v, mask=np.isnan(v)) if v.dtype == np.float64 else pa.array(v) for v in values)], [c for c, _ in _EDGE])
            i, j, dist, inter = _within(*ij, *measure(*ij), reach)
            iou, oa, ob = _ratio(inter, aa[i] + ab[j] - inter), _ratio(inter, aa[i]), _ratio(inter, ab[j])
            edge = (iou >= IOU) | (oa >= OVERLAP) | (ob >= OVERLAP) | ((dist <= DISTANCE_M) & (_ratio(inter, np.minimum(aa[i], ab[j])) >= REL_INTERSECTION))
            i, j, dist, iou, oa, ob = (v[edge] for v in (i, j, dist, iou, oa, ob))
            if len(i):
                n, has = wa[i] * wb[j], ~np.isnan(iou)
                np.add.at(count, i, n)
                np.add.at(sums, i[has], iou[has] * n[has])
                np.add.at(known, i[has], n[has])
                for v, to in zip((iou, oa, ob), best, strict=True):
                    np.fmax.at(to, i, v)
                np.fmin.at(least, i, dist)
                ends.append(_stars(na[i], nb[j]))
            return None

        return take

    cols = ["node", "n", "area", *BOX, *(["wkb"] if shapes else [])]
    return checkpoint(box_groups(a.select(*cols), b.select(*cols), CELL_M, found, ", ".join(f"{c} {kind}" for c, kind in _EDGE), reach))


def kinds(df: DataFrame, first: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rows with ``node``, their ordinal after ``first``, and ``rep``, the first node of their kind; a row a kind: MEASURES, node and number n).

    Rows of one kind agree in box, area, perimeter and centroid, so where boxes stand for shapes they make the same pairs.
    """
    rows = df.withColumn("node", F.col("ordinal") + first)
    found = checkpoint(rows.groupBy(*MEASURES).agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n")))
    named = found.select(*(F.col(c).alias(f"__{c}") for c in MEASURES), F.col("node").alias("rep"))
    return checkpoint(rows.join(named, _same(MEASURES)).drop(*(f"__{c}" for c in MEASURES))), found


def pair_metrics(pairs: DataFrame, inter: Column | None = None, dist: Column | None = None) -> DataFrame:
    """Overlap metrics of candidate pairs.

    ``inter`` and ``dist`` give the intersection area and the distance; by default
    those of boxes. Polygons pass the kernels' results. The union's area is the
    areas' sum less the intersection.
    """
    inter = box_intersection() if inter is None else inter
    dist = box_distance() if dist is None else dist
    out = pairs.select(
        F.col("l.uid").alias("uid_a"), F.col("r.uid").alias("uid_b"), F.col("l.area").alias("area_a"), F.col("r.area").alias("area_b"),
        F.col("l.perimeter").alias("perimeter_a"), F.col("r.perimeter").alias("perimeter_b"),
        inter.alias("intersection_area"), dist.alias("dist_m"),
        F.sqrt(F.pow(F.col("l.cx") - F.col("r.cx"), 2) + F.pow(F.col("l.cy") - F.col("r.cy"), 2)).alias("centroid_dist_m"),
    )
    out = out.withColumns({"union_area": F.col("area_a") + F.col("area_b") - F.col("intersection_area"), "min_area": F.least("area_a", "area_b")})
    return out.withColumns({
        "iou": ratio("intersection_area", "union_area"), "overlap_a": ratio("intersection_area", "area_a"),
        "overlap_b": ratio("intersection_area", "area_b"), "rel_intersection_min": ratio("intersection_area", "min_area"),
    })


def edge_rule() -> Column:
    """Whether a pair is an edge; any of the four tests suffices."""
    near = (F.col("dist_m") <= DISTANCE_M) & (F.col("rel_intersection_min") >= REL_INTERSECTION)
    return (F.col("iou") >= IOU) | (F.col("overlap_a") >= OVERLAP) | (F.col("overlap_b") >= OVERLAP) | near


def vertices(a: DataFrame, b: DataFrame) -> DataFrame:
    """uid, src and node: A's ordinals first, then B's."""
    n = row_count(a)
    return a.select("uid", "src", F.col("ordinal").alias("node")).unionByName(b.select("uid", "src", (F.col("ordinal") + n).alias("node")))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """uid, src, node and component_id (1, 2, ... by a component's first node); isolated nodes have their own.

    Edges name uids, or (``linked``) nodes of kinds: then nodes have a ``rep``, and rows of a kind without an edge stay apart.
    """
    nodes = checkpoint(nodes)
    if "node_a" in edges.columns:
        ends, at = edges.select("node_a", "node_b"), "rep"
    else:
        ends, at = edges.select("uid_a", "uid_b"), "node"
        for side in "ab":
            ends = ends.join(nodes.select(F.col("uid").alias(f"uid_{side}"), F.col("node").alias(f"node_{side}")), f"uid_{side}")
    linked = connected_components(stars(ends, "node_a", "node_b"))
    label = F.coalesce("component", "node")
    named = checkpoint(nodes.join(linked, nodes[at] == linked["vertex"], "left").select("uid", "src", "node", label.alias("label")))
    ranked = running_total(named.select("label").distinct(), [F.col("label")], {"rank": F.lit(1)})
    return named.join(ranked, "label").select("uid", "src", "node", (F.col("rank") + 1).alias("component_id"))


def match_type(n_a: str = "n_a", n_b: str = "n_b") -> Column:
    a, b = F.col(n_a), F.col(n_b)
    return (
        F.when((a > 0) & (b == 0), "A_only").when((b > 0) & (a == 0), "B_only").when((a == 1) & (b == 1), "1:1")
        .when((a == 1) & (b > 1), "1:n").when((a > 1) & (b == 1), "n:1").when((a > 1) & (b > 1), "n:n").otherwise("unknown")
    )


def component_table(members: DataFrame, edges: DataFrame) -> DataFrame:
    """A row a component: members, match type and edge metrics."""
    table = members.groupBy("component_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("src") == "A", F.col("uid")))).alias("uids_a"),
        F.array_sort(F.collect_list(F.when(F.col("src") == "B", F.col("uid")))).alias("uids_b"),
        F.count_if(F.col("src") == "A").alias("n_a"), F.count_if(F.col("src") == "B").alias("n_b"),
    ).withColumn("match_type", match_type())
    by, own = ("node_a", "node") if "node_a" in edges.columns else ("uid_a", "uid")
    if by == "uid_a":
        edges = edges.withColumns({"n": F.lit(1), "iou_sum": F.col("iou"), "iou_n": F.col("iou").isNotNull().cast("long")})
    largest = ("iou", "overlap_a", "overlap_b")
    # By A's rows first, so that the join has a row each and not one an edge.
    found = edges.where("n > 0").groupBy(by).agg(F.sum("n").alias("n_edges_ab"), F.sum("iou_sum").alias("__sum"), F.sum("iou_n").alias("__n"), *(F.max(c).alias(f"max_{c}") for c in largest), F.min("dist_m").alias("min_dist_m"))
    of_a = members.where("src = 'A'").select(F.col(own).alias(by), "component_id")
    metrics = found.join(of_a, by).groupBy("component_id").agg(
        F.sum("n_edges_ab").alias("n_edges_ab"), ratio(F.sum("__sum"), F.sum("__n")).alias("mean_iou"), *(F.max(f"max_{c}").alias(f"max_{c}") for c in largest), F.min("min_dist_m").alias("min_dist_m"),
    ).select("component_id", "n_edges_ab", "max_iou", "mean_iou", "max_overlap_a", "max_overlap_b", "min_dist_m")
    return table.join(metrics, "component_id", "left").withColumn("n_edges_ab", F.coalesce("n_edges_ab", F.lit(0)))


def b_attributes(members: DataFrame, b: DataFrame) -> DataFrame:
    """By component: observed heights, medians of B's attributes and its most frequent purpose (ties: the smallest)."""
    of_b = members.where("src = 'B'").select("uid", "component_id").join(b.select("uid", "height", "stairs", "avg_floor_height", "purpose_of_building"), "uid")
    return of_b.groupBy("component_id").agg(
        F.count("height").alias("n_b_with_height"), F.median("height").alias("median_height_b"), F.median("stairs").alias("median_stairs_b"),
        F.median("avg_floor_height").alias("median_avg_floor_height_b"), F.mode("purpose_of_building", True).alias("mode_purpose_b"),
    )


def match_confidence() -> Column:
    def any_at_least(iou: float, overlap: float) -> Column:
        return F.coalesce(F.col("max_iou") >= iou, F.lit(False)) | F.coalesce(F.col("max_overlap_a") >= overlap, F.lit(False)) | F.coalesce(F.col("max_overlap_b") >= overlap, F.lit(False))

    return F.when(F.col("match_type").isin("A_only", "B_only"), "none").when(any_at_least(0.50, 0.80), "high").when(any_at_least(0.15, 0.60), "medium").otherwise("low")


#: Detail of where a height comes from, by match type.
HEIGHT_DETAIL = {"B_only": "B_only_direct", "1:1": "B_from_1to1_match", "1:n": "B_from_1ton_match", "n:1": "B_from_nto1_match", "n:n": "B_from_nton_match"}


def targets(table: DataFrame) -> DataFrame:
    """Add confidence, target height, its source, detail and reliability."""
    observed = F.col("median_height_b").isNotNull()
    detail = F.when(~observed, "missing")
    for kind, said in HEIGHT_DETAIL.items():
        detail = detail.when(F.col("match_type") == kind, said)
    sure = F.col("match_confidence")
    reliability = (
        F.when(~observed, "none").when(F.col("match_type") == "B_only", "high").when((F.col("match_type") == "1:1") & (sure == "high"), "high")
        .when(sure.isin("high", "medium"), "medium").otherwise("low")
    )
    return table.withColumn("match_confidence", match_confidence()).withColumns({
        "target_height": F.col("median_height_b"), "target_height_is_observed": observed.cast("byte"),
        "target_height_source": F.when(observed, "B_observed").otherwise("missing"),
        "target_height_source_detail": detail.otherwise("B_observed_other"), "target_height_reliability": reliability,
    })


def sum_areas(members: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """By component: the areas of its members summed, 0 where a side is empty."""
    areas = a.select("uid", "area").unionByName(b.select("uid", "area"))
    rows = members.join(areas, "uid")
    return rows.groupBy("component_id").agg(*(F.coalesce(F.sum(F.when(F.col("src") == s, F.col("area"))), F.lit(0.0)).alias(f"sum_area_{s.lower()}") for s in "AB"))


def geometry_source(area_a: str = "union_area_a", area_b: str = "union_area_b") -> Column:
    """Which side represents a component: its only side; B if 1:1 or areas are comparable; else A."""
    a, b = F.col(area_a), F.col(area_b)
    alike = F.when(F.greatest(a, b) > 0, F.least(a, b) / F.greatest(a, b)).otherwise(0.0)
    return F.when(a.isNull() & b.isNull(), "none").when(b.isNull(), "A").when(a.isNull(), "B").when((F.col("match_type") == "1:1") | (alike >= 0.70), "B").otherwise("A")


def union_areas(members: DataFrame, polygons: DataFrame) -> DataFrame:
    """By component: the area that its members of A, of B, and all of them cover; null where there are none.

    ``polygons`` has uid, area, wkb and box. Components of one member take its
    area. The others' polygons are cut by grid cells of a size at which none of
    them covers more than MOST_CELLS, and a component's area is the sum of its
    cells' areas: so a component of any size is measured cell by cell, in which
    equal parts count once.
    """
    rows = checkpoint(members.select("component_id", "src", "uid").join(polygons.select("uid", "area", "wkb", *BOX), "uid"))
    shapes_ = rows.groupBy("component_id", "src", "wkb").agg(*(F.first(c).alias(c) for c in BOX))
    sizes = rows.groupBy("component_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("src") == "A").alias("n_a"), F.count_if(F.col("src") == "B").alias("n_b"), F.max(own_level(CELL_M, MOST_CELLS)).alias("level"), F.first("area").alias("own"))
    sizes = checkpoint(sizes)
    listed = shapes_.join(sizes.where("n > 1").select("component_id", "level"), "component_id").withColumn("__size", cell_size(CELL_M, F.col("level")))
    for axis in "xy":
        listed = listed.withColumn(f"c{axis}", F.explode(F.sequence(F.floor(F.col(f"min{axis}") / F.col("__size")), F.floor(F.col(f"max{axis}") / F.col("__size")))))
    parts = spread(listed, "component_id", "cx", "cy").withColumn("part", kernels.st_clip(F.col("wkb"), F.col("cx"), F.col("cy"), F.col("__size")))
    # A set, so that copies of a polygon don't crowd a cell.
    cells = spread(parts, "component_id", "cx", "cy").groupBy("component_id", "cx", "cy").agg(*(F.collect_set(F.when(F.col("src") == s, F.col("part"))).alias(s) for s in "AB"))
    cells = cells.select("component_id", *(kernels.st_union_area(c).alias(n) for n, c in (("a", F.col("A")), ("b", F.col("B")), ("all", F.concat("A", "B")))))
    sums = cells.groupBy("component_id").agg(*(F.sum(c).alias(f"__{c}") for c in ("a", "b", "all")))
    out = sizes.join(sums, "component_id", "left")
    one = F.col("n") == 1
    return out.select(
        "component_id",
        *(F.when(F.col(f"n_{s}") > 0, F.when(one, F.col("own")).otherwise(F.coalesce(f"__{s}", F.lit(0.0)))).alias(f"union_area_{s}") for s in "ab"),
        F.when(one, F.col("own")).otherwise(F.coalesce("__all", F.lit(0.0))).alias("union_area_all"),
    )


def dissolved(polygons: DataFrame, key: str = "component_id", first: int = FIRST_UNION, onward: int = NEXT_UNION) -> DataFrame:
    """(key, rep_geometry): the union of each key's distinct polygons (columns wkb and BOX).

    Polygons are put in Z-order within their key by one running total, and
    neighbours are dissolved ``first`` at a time, then what comes of them
    ``onward`` at a time, until one is left: no group has more of them than that,
    and inner walls are gone before the larger unions are made.
    """
    rows = checkpoint(polygons.groupBy(key, "wkb").agg(*(F.first(c).alias(c) for c in BOX)).withColumn("__z", geo.z_order("minx", "miny", CELL_M / 8)))
    largest = rows.groupBy(key).count().agg(F.max("count")).first()[0] or 0
    if largest <= first:
        return spread(rows, key).groupBy(key).agg(F.collect_list("wkb").alias("parts")).select(key, kernels.st_union(F.col("parts")).alias("rep_geometry"))
    placed = running_total(rows, [F.col(key), F.col("__z")], {"__at": F.lit(1)})
    starts = placed.groupBy(key).agg(F.min("__at").alias("__start"))
    held = placed.join(starts, key).select(key, F.floor((F.col("__at") - F.col("__start")) / first).alias("__group"), "wkb")
    groups = -(-largest // first)
    while True:
        held = spread(held, key, "__group").groupBy(key, "__group").agg(F.collect_list("wkb").alias("parts")).select(key, "__group", kernels.st_union(F.col("parts")).alias("wkb"))
        if groups <= 1:
            return held.select(key, F.col("wkb").alias("rep_geometry"))
        held = checkpoint(held).withColumn("__group", F.floor(F.col("__group") / onward))
        groups = -(-groups // onward)


def representatives(members: DataFrame, polygons: DataFrame, sources: DataFrame) -> DataFrame:
    """component_id, rep_geometry (WKB), cx and cy: the union of the members on the side that ``sources`` (component_id, geometry_source) names."""
    rows = members.select("component_id", "src", "uid").join(sources, "component_id").where("src = geometry_source").join(polygons.select("uid", "wkb", *BOX), "uid")
    merged = checkpoint(dissolved(rows))
    out = merged.withColumn("__g", kernels.wkb_to_geometry(F.col("rep_geometry"))).withColumn("__c", geo.centroid("__g"))
    return out.select("component_id", "rep_geometry", F.col("__c.x").alias("cx"), F.col("__c.y").alias("cy"))


_NEAR = [f"{n}_{r}m" for r in (50, 100) for n in ("n_neighbors", "n_neighbors_obs_height", *(f"neighbor_height_{s}" for s in ("mean", "median", "min", "max", "std", "q25", "q75")))]
# The final table's columns in order.
FINAL_COLUMNS = [
    "component_id", "match_type", "match_confidence", "geometry_source",
    "target_height", "target_height_is_observed", "target_height_source", "target_height_source_detail", "target_height_reliability",
    "n_a", "n_b", "uids_a", "uids_b",
    "n_edges_ab", "max_iou", "mean_iou", "max_overlap_a", "max_overlap_b", "min_dist_m",
    "sum_area_a", "sum_area_b", "union_area_a", "union_area_b", "union_area_all",
    "n_b_with_height", "median_height_b", "median_stairs_b", "median_avg_floor_height_b", "mode_purpose_b",
    *_NEAR, "rep_geometry",
]


def ordered(df: DataFrame, main: list[str]) -> DataFrame:
    """The main columns in their order, then the others as they come."""
    return df.select(*main, *(c for c in df.columns if c not in main))


def final_table(a: DataFrame, b: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """A row a building: FINAL_COLUMNS, then the representative's centroid (cx, cy).

    ``a`` and ``b`` are the sources with uid, shapes and attributes, ``edges`` the pairs that hold.
    """
    polygons = checkpoint(a.select("uid", "area", "wkb", *BOX).unionByName(b.select("uid", "area", "wkb", *BOX)))
    table = component_table(members, edges).join(b_attributes(members, b), "component_id", "left").join(sum_areas(members, a, b), "component_id")
    table = targets(table.join(union_areas(members, polygons), "component_id")).withColumn("geometry_source", geometry_source())
    table = checkpoint(table.withColumn("n_b_with_height", F.coalesce("n_b_with_height", F.lit(0))))
    table = checkpoint(table.join(representatives(members, polygons, table.select("component_id", "geometry_source")), "component_id", "left"))
    near = neighbor_features(table.select("component_id", "target_height", "cx", "cy"))
    return ordered(table.join(near, "component_id"), FINAL_COLUMNS)


def matched(table: DataFrame) -> DataFrame:
    """The components that have members of both sources."""
    return table.where(~F.col("match_type").isin("A_only", "B_only"))


def summary(table: DataFrame) -> DataFrame:
    """One row: components, those of both sources, of A and of B only, and with an observed height."""
    kind = F.col("match_type")
    return table.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(~kind.isin("A_only", "B_only")).alias("matched"), F.count_if(kind == "A_only").alias("a_only"),
        F.count_if(kind == "B_only").alias("b_only"), F.count("median_height_b").alias("with_height"),
    )
