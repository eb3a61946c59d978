"""Queries over the plain tables: geometry measures, profiles, models, validation, maps, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.functions import geometry as geo
from plinth.functions import kernels
from plinth.functions.numeric import QUALITY_LABELS, QUALITY_WORST, VALIDATION_LABELS, VALIDATION_WORST, grid_key, quality_label, quality_score, validation_label, validation_score
from plinth.operators import maplayers, matching, modelling, neighbors, regressions, validation
from plinth.operators import profiling as p
from plinth.plans import footprints as fp
from plinth.plans.fixtures import footprints_a, footprints_b, oracle
from plinth.plans.polygons import CELLS
from plinth.storage import checkpoint


def _read(spark, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _r(*cols: str, digits: int = 6):
    return [F.round(c, digits).alias(c) for c in cols]


def _rs(*cols: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


_CORNERS = [("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny")]


def _wkt_column(scale: float = 1.0, east: float = 0.0, north: float = 0.0):
    points = [F.concat_ws(" ", (F.lit(east) + F.col(x) * scale).cast("string"), (F.lit(north) + F.col(y) * scale).cast("string")) for x, y in _CORNERS]
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *points), F.lit("))"))


def _ring(scale: float = 1.0, east: float = 0.0, north: float = 0.0):
    return F.array(F.array(F.array(*(F.struct((F.lit(east) + F.col(x) * scale).alias("x"), (F.lit(north) + F.col(y) * scale).alias("y")) for x, y in _CORNERS))))


# ---- geometry

def rect_measures(spark, sf_dir: str) -> DataFrame:
    df = footprints_a(spark, sf_dir).withColumn("g", _ring()).drop("area", "perimeter", "cx", "cy")
    df = df.withColumns({"area": geo.area("g"), "perimeter": geo.perimeter("g"), "c": geo.centroid("g"), "b": geo.bounds("g")})
    return df.select("id", "area", "perimeter", F.round("c.x", 6).alias("cx"), F.round("c.y", 6).alias("cy"), "b.minx", "b.miny", "b.maxx", "b.maxy", geo.geom_type("g").alias("geom_type"), geo.is_empty("g").alias("is_empty"))


RECT_MEASURES = oracle("SELECT id, area, perimeter, round(cx, 6) AS cx, round(cy, 6) AS cy, minx, miny, maxx, maxy, 'Polygon' AS geom_type, false AS is_empty FROM fa")


def shape_features(spark, sf_dir: str) -> DataFrame:
    df = footprints_b(spark, sf_dir).withColumn("box_area", F.col("w") * F.col("h"))
    return df.select("id", F.round(geo.compactness("area", "perimeter"), 6).alias("compactness"), F.round(geo.rectangularity("area", "box_area"), 6).alias("rectangularity"), F.round(geo.elongation("w", "h"), 6).alias("elongation"))


SHAPE_FEATURES = oracle("SELECT id, round(4 * pi() * area / (perimeter * perimeter), 6) AS compactness, round(area / (w * h), 6) AS rectangularity, round(greatest(w, h) / least(w, h), 6) AS elongation FROM fb")


def wkt_roundtrip(spark, sf_dir: str) -> DataFrame:
    """WKT to WKB to nested points to area; every tenth text is broken and gives null."""
    text = F.when(F.col("id") % 10 == 0, F.lit("POLYGON ((0 0, 1 1")).otherwise(_wkt_column())
    df = footprints_a(spark, sf_dir).select("id", kernels.wkt_to_wkb(text).alias("wkb"))
    df = df.select("id", kernels.wkb_to_geometry(F.col("wkb")).alias("g"), kernels.st_is_valid(F.col("wkb")).alias("is_valid"))
    return df.select("id", geo.area("g").alias("area"), "is_valid")


WKT_ROUNDTRIP = oracle("SELECT id, CASE WHEN id % 10 <> 0 THEN area END AS area, id % 10 <> 0 AS is_valid FROM fa")
_SCALE, _EAST, _NORTH = 1e-4, 30.0, 59.8


def project_mercator(spark, sf_dir: str) -> DataFrame:
    df = footprints_a(spark, sf_dir).withColumn("g0", _ring(_SCALE, _EAST, _NORTH)).withColumn("g", geo.to_mercator("g0"))
    return df.select("id", F.round(F.expr("g[0][0][0].x"), 3).alias("x"), F.round(F.expr("g[0][0][0].y"), 3).alias("y"))


PROJECT_MERCATOR = oracle(f"SELECT id, round(radians({_EAST} + x0 * {_SCALE}) * {geo.RADIUS}, 3) AS x, round(ln(tan(pi() / 4 + radians({_NORTH} + y0 * {_SCALE}) / 2)) * {geo.RADIUS}, 3) AS y FROM fa")


def project_utm(spark, sf_dir: str) -> DataFrame:
    """Degrees to UTM and back: easting, northing and the residue in degrees."""
    df = footprints_a(spark, sf_dir).select("id", (F.lit(_EAST) + F.col("x0") * _SCALE).alias("lon"), (F.lit(_NORTH) + F.col("y0") * _SCALE).alias("lat"))
    x, y = geo.degrees_to_utm(F.col("lon"), F.col("lat"))
    df = df.withColumns({"easting": x, "northing": y})
    lon, lat = geo.utm_to_degrees(F.col("easting"), F.col("northing"))
    return df.select("id", *_r("easting", "northing", digits=3), F.round(F.abs(lon - F.col("lon")) + F.abs(lat - F.col("lat")), 8).alias("residue"))


def _utm_sql() -> str:
    """Transverse Mercator by its series, over lam and phi (radians from the central meridian)."""
    series = {
        "x": " + ".join(["eta", *(f"{a!r} * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, a in enumerate(geo._FORWARD, start=1))]),
        "y": " + ".join(["xi", *(f"{a!r} * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, a in enumerate(geo._FORWARD, start=1))]),
    }
    return (
        f"SELECT id, round({geo.EASTING!r} + {geo.SCALE * geo._A!r} * ({series['x']}), 3) AS easting, round({geo.SCALE * geo._A!r} * ({series['y']}), 3) AS northing, CAST(0 AS DOUBLE) AS residue FROM ("
        f"SELECT id, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM (SELECT id, lam, sinh(atanh(sin(phi)) - {geo._ECC!r} * atanh({geo._ECC!r} * sin(phi))) AS t FROM ("
        f"SELECT id, radians({_EAST} + x0 * {_SCALE} - 27.0) AS lam, radians({_NORTH} + y0 * {_SCALE}) AS phi FROM fa)))"
    )


PROJECT_UTM = oracle(_utm_sql())


def geometry_source(spark, sf_dir: str) -> DataFrame:
    """The areas that each component's boxes cover by side, and the side that represents it."""
    table, a, b, members = fp.component_features(spark, sf_dir)
    boxes = a.select("uid", "area", *fp.BOX_KEY).unionByName(b.select("uid", "area", *fp.BOX_KEY)).withColumn("wkb", kernels.wkt_to_wkb(_wkt_column()))
    out = table.select("component_id", "match_type", "sum_area_a", "sum_area_b").join(matching.union_areas(members, boxes), "component_id")
    return out.select("component_id", "sum_area_a", "sum_area_b", *_r("union_area_a", "union_area_b"), matching.geometry_source().alias("geometry_source"))


GEOMETRY_SOURCE = oracle(
    "SELECT component_id, sum_area_a, sum_area_b, round(union_area_a, 6) AS union_area_a, round(union_area_b, 6) AS union_area_b, side AS geometry_source FROM reps JOIN areas USING (component_id)",
    *fp.GRAPH,
    "rects AS (SELECT component_id, src, minx AS x1, miny AS y1, maxx AS x2, maxy AS y2 FROM members JOIN (SELECT uid, minx, miny, maxx, maxy FROM a UNION ALL SELECT uid, minx, miny, maxx, maxy FROM b) USING (uid))",
    *CELLS, recursive=True,
)


# ---- profiles

def null_share(spark, sf_dir: str) -> DataFrame:
    orders = _read(spark, sf_dir, "orders").withColumn("o_totalprice", F.expr("CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END"))
    return p.null_share(orders, ["o_orderkey", "o_totalprice", "o_orderstatus"])


NULL_SHARE = (
    "WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice, o_orderstatus FROM orders), "
    + "u AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS na_count, count(*) AS n FROM o" for c in ("o_orderkey", "o_totalprice", "o_orderstatus"))
    + ") SELECT \"column\", na_count, round(na_count * 100.0 / n, 2) AS na_share_pct FROM u"
)


def value_counts(spark, sf_dir: str) -> DataFrame:
    return p.value_counts(_read(spark, sf_dir, "events"), "event_type")


VALUE_COUNTS = "SELECT event_type, count(*) AS count FROM events GROUP BY event_type"


def describe(spark, sf_dir: str) -> DataFrame:
    out = p.describe(_read(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"], [0.01, 0.95])
    return out.select("column", "count", *_r("mean", "std", "min", "p1", "p50", "p95", "max", digits=4))


DESCRIBE = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min(CAST({c} AS DOUBLE)), 4) AS min, "
    + ", ".join(f"round(quantile_cont(CAST({c} AS DOUBLE), {q}), 4) AS {n}" for q, n in ((0.01, "p1"), (0.5, "p50"), (0.95, "p95")))
    + f", round(max(CAST({c} AS DOUBLE)), 4) AS max FROM orders"
    for c in ("o_totalprice", "o_custkey")
)


def top_k(spark, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    return p.top_k(rows, "l_extendedprice", 10, "key", ["key", "l_extendedprice"])


TOP_K = "SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS key, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, key LIMIT 10"


def sample_fixed(spark, sf_dir: str) -> DataFrame:
    return p.fixed_sample(_read(spark, sf_dir, "orders"), 100, "o_orderkey").select("o_orderkey", "o_totalprice")


SAMPLE_FIXED = "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 100"
_COPIES = "c AS (SELECT id, minx, miny, maxx, maxy, area FROM fa UNION ALL SELECT id + 1000000, minx, miny, maxx, maxy, area FROM fa WHERE id % 3 = 0)"


def _copies(spark, sf_dir: str) -> DataFrame:
    rows = footprints_a(spark, sf_dir).select("id", *fp.BOX_KEY, "area")
    return rows.unionByName(rows.where("id % 3 = 0").withColumn("id", F.col("id") + 1_000_000))


def signature_dups(spark, sf_dir: str) -> DataFrame:
    rows = _copies(spark, sf_dir).withColumn("kind", F.lit("Polygon")).withColumn("sig", geo.signature("kind", "area", *fp.BOX_KEY))
    return p.mark_duplicates(rows, "sig").select("id", "is_duplicate")


SIGNATURE_DUPS = oracle("SELECT id, count(*) OVER (PARTITION BY round(area, 2), round(minx, 2), round(miny, 2), round(maxx, 2), round(maxy, 2)) > 1 AS is_duplicate FROM c", _COPIES)


def hash_dups(spark, sf_dir: str) -> DataFrame:
    rows = _copies(spark, sf_dir).withColumn("hash", F.md5(kernels.wkt_to_wkb(_wkt_column())))
    return p.duplicate_summary(rows, "hash").select("total", "duplicates", "groups", *_r("share"))


HASH_DUPS = oracle(
    "SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) FILTER (n > 1) AS BIGINT) AS duplicates, count(*) FILTER (n > 1) AS groups, round(sum(n) FILTER (n > 1) / sum(n), 6) AS share FROM (SELECT count(*) AS n FROM c GROUP BY minx, miny, maxx, maxy)",
    _COPIES,
)


def duplicate_examples(spark, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_size").alias("kind"))
    return p.duplicate_examples(rows, "kind", ["p_partkey"], 3)


DUPLICATE_EXAMPLES = (
    "WITH r AS (SELECT p_partkey, concat_ws('/', p_brand, p_size) AS kind FROM part), g AS (SELECT kind, row_number() OVER (ORDER BY count(*) DESC, kind) AS duplicate_group FROM r GROUP BY kind HAVING count(*) > 1) "
    "SELECT duplicate_group, kind, p_partkey FROM r JOIN g USING (kind) WHERE duplicate_group <= 3"
)


def unique_audit(spark, sf_dir: str) -> DataFrame:
    return p.duplicates_audit(_read(spark, sf_dir, "orders"), "o_custkey")


UNIQUE_AUDIT = "SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_unique, count(o_custkey) - count(DISTINCT o_custkey) AS n_duplicated FROM orders"


def any_null(spark, sf_dir: str) -> DataFrame:
    return p.any_null(footprints_b(spark, sf_dir), ["purpose_of_building", "stairs", "height"])


ANY_NULL = oracle("SELECT count(*) AS n_rows, count(*) FILTER (purpose_of_building IS NULL OR stairs IS NULL OR height IS NULL) AS rows_with_missing FROM fb")


def histogram_right(spark, sf_dir: str) -> DataFrame:
    return p.histogram(_read(spark, sf_dir, "orders"), "o_totalprice", 28)


def histogram_left(spark, sf_dir: str) -> DataFrame:
    return p.histogram(_read(spark, sf_dir, "orders"), "o_totalprice", 50, left_closed=True)


_ENDS = "WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT CAST(least(greatest({place}, 1), {n}) AS INT) AS bin, count(*) AS count FROM orders, e GROUP BY 1"
HISTOGRAM_RIGHT = _ENDS.format(place="ceil((o_totalprice - lo) / ((hi - lo) / 28))", n=28)
HISTOGRAM_LEFT = _ENDS.format(place="floor((o_totalprice - lo) / ((hi - lo) / 50)) + 1", n=50)


def clipped(spark, sf_dir: str) -> DataFrame:
    return p.clipped(_read(spark, sf_dir, "orders"), "o_totalprice", 0.99).agg(F.count(F.lit(1)).alias("n"), F.round(F.max("o_totalprice"), 4).alias("most"))


CLIPPED = "SELECT count(*) AS n, round(max(o_totalprice), 4) AS most FROM orders WHERE o_totalprice <= (SELECT quantile_cont(o_totalprice, 0.99) FROM orders)"


# ---- models: a row a footprint of B, with its own attributes

def _model_rows(spark, sf_dir: str) -> DataFrame:
    df = footprints_b(spark, sf_dir).select(
        F.col("id").alias("component_id"), "cx", "cy", F.col("stairs").alias("median_stairs_b"), F.col("avg_floor_height").alias("median_avg_floor_height_b"),
        F.col("purpose_of_building").alias("mode_purpose_b"), F.lit("B_only").alias("match_type"), F.col("area").alias("sum_area_b"),
        F.expr("CASE WHEN id % 5 <> 0 THEN height END").alias("target_height"),
    )
    return modelling.spatial_groups(df.withColumn("target_height_is_observed", F.col("target_height").isNotNull().cast("int")))


_MODEL = "m AS (SELECT id AS component_id, CASE WHEN id % 5 <> 0 THEN height END AS target_height, CAST(floor(cx / 1000) AS BIGINT) || '_' || CAST(floor(cy / 1000) AS BIGINT) AS spatial_group, * FROM fb)"


def spatial_groups(spark, sf_dir: str) -> DataFrame:
    return modelling.group_sizes(_model_rows(spark, sf_dir)).select("n_groups", *_r("mean_size"), "min_size", "max_size")


SPATIAL_GROUPS = oracle("SELECT count(*) AS n_groups, round(avg(n), 6) AS mean_size, min(n) AS min_size, max(n) AS max_size FROM (SELECT count(*) AS n FROM m GROUP BY spatial_group)", _MODEL)


def spatial_folds(spark, sf_dir: str) -> DataFrame:
    rows = modelling.split_observed(_model_rows(spark, sf_dir))[0]
    folds = modelling.group_folds(rows)
    return rows.join(folds, "spatial_group").groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("spatial_group").alias("n_groups"))


_DEAL = [
    _MODEL,
    "gs AS (SELECT spatial_group, n, row_number() OVER (ORDER BY n DESC, spatial_group) AS i FROM (SELECT spatial_group, count(*) AS n FROM m WHERE target_height IS NOT NULL GROUP BY spatial_group))",
    "deal AS (SELECT CAST(0 AS BIGINT) AS i, [CAST(0 AS BIGINT), 0, 0, 0, 0] AS loads, -1 AS fold, CAST(0 AS BIGINT) AS n UNION ALL SELECT gs.i, "
    "list_transform(loads, lambda x, k: CASE WHEN k = list_position(loads, list_min(loads)) THEN x + gs.n ELSE x END), list_position(loads, list_min(loads)) - 1, gs.n FROM deal JOIN gs ON gs.i = deal.i + 1)",
]
SPATIAL_FOLDS = oracle("SELECT fold, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_groups FROM deal WHERE i > 0 GROUP BY fold", *_DEAL, recursive=True)


def regression_metrics(spark, sf_dir: str) -> DataFrame:
    rows = footprints_b(spark, sf_dir).where("height IS NOT NULL AND stairs IS NOT NULL").select((F.col("id") % 5).alias("fold"), F.col("height").alias("target_height"), (F.col("stairs") * 3).alias("prediction"))
    return modelling.fold_metrics(rows).select("fold", *_r("mse", "rmse", "mae", "r2"))


_FOLD_SQL = "f AS (SELECT id % 5 AS fold, avg((height - stairs * 3) ** 2) AS mse, sqrt(avg((height - stairs * 3) ** 2)) AS rmse, avg(abs(height - stairs * 3)) AS mae, 1 - sum((height - stairs * 3) ** 2) / (var_pop(height) * count(*)) AS r2 FROM fb WHERE height IS NOT NULL AND stairs IS NOT NULL GROUP BY 1)"
REGRESSION_METRICS = oracle(f"SELECT fold, {_rs('mse', 'rmse', 'mae', 'r2')} FROM f", _FOLD_SQL)


def fold_summary(spark, sf_dir: str) -> DataFrame:
    out = modelling.fold_summary(regression_metrics(spark, sf_dir))
    return out.select(*_r(*out.columns, digits=5))


FOLD_SUMMARY = oracle("SELECT " + ", ".join(f"round({f}(round({m}, 6)), 5) AS {m}_{n}" for m in ("mse", "rmse", "mae", "r2") for n, f in (("mean", "avg"), ("std", "stddev_samp"))) + " FROM f", _FOLD_SQL)
_SMALL = ["median_stairs_b", "median_avg_floor_height_b", "sum_area_b", "mode_purpose_b"]


def _model(kind: str, params: dict):
    def run(spark, sf_dir: str) -> DataFrame:
        rows = modelling.split_observed(_model_rows(spark, sf_dir))[0]
        found = modelling.cross_validate(rows, kind, _SMALL, params)
        return modelling.fold_metrics(found)

    return run


_SETS = {"1_stairs": ["median_stairs_b"], "2_stairs_and_floor_height": ["median_stairs_b", "median_avg_floor_height_b"]}


def linear_sets(spark, sf_dir: str) -> DataFrame:
    rows = modelling.split_observed(_model_rows(spark, sf_dir))[0]
    return regressions.linear_metrics(rows, _SETS).select("feature_set", "fold", *_r("mse", "rmse", "mae", "r2"))


_LINEAR = [
    *_DEAL,
    "x AS (SELECT deal.fold, m.target_height AS y, m.stairs AS a, m.avg_floor_height AS b FROM m JOIN gs USING (spatial_group) JOIN deal ON deal.i = gs.i WHERE m.target_height IS NOT NULL)",
    "mu AS (SELECT k.fold, avg(y) AS y, avg(a) AS a, avg(b) AS b FROM x JOIN (SELECT DISTINCT fold FROM x) k ON x.fold <> k.fold GROUP BY k.fold)",
    "z AS (SELECT mu.fold, x.fold AS own, x.y, mu.y AS base, x.y - mu.y AS zy, coalesce(x.a - mu.a, 0) AS za, coalesce(x.b - mu.b, 0) AS zb FROM x CROSS JOIN mu)",
    "s AS (SELECT fold, sum(za * za) AS aa, sum(za * zb) AS ab, sum(zb * zb) AS bb, sum(za * zy) AS ay, sum(zb * zy) AS yb FROM z WHERE own <> fold GROUP BY fold)",
    "w AS (SELECT '1_stairs' AS feature_set, fold, ay / aa AS wa, CAST(0 AS DOUBLE) AS wb FROM s UNION ALL SELECT '2_stairs_and_floor_height', fold, (ay * bb - yb * ab) / (aa * bb - ab * ab), (yb * aa - ay * ab) / (aa * bb - ab * ab) FROM s)",
    "e AS (SELECT feature_set, fold, z.y, z.y - (base + wa * za + wb * zb) AS e FROM z JOIN w USING (fold) WHERE own = fold)",
    "q AS (SELECT feature_set, fold, avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2 FROM e GROUP BY 1, 2)",
]
LINEAR_SETS = oracle(f"SELECT feature_set, fold, {_rs('mse', 'rmse', 'mae', 'r2')} FROM q", *_LINEAR, recursive=True)


def fill_provenance(spark, sf_dir: str) -> DataFrame:
    rows = _model_rows(spark, sf_dir)
    constant = rows.select("component_id", F.lit(3.5).alias("target_height_predicted"))
    return validation.fill_heights(rows, constant).select("component_id", "target_height_filled", "target_height_fill_source", "target_height_was_predicted")


FILL_PROVENANCE = oracle("SELECT component_id, coalesce(target_height, 3.5) AS target_height_filled, CASE WHEN target_height IS NULL THEN 'catboost' ELSE 'observed' END AS target_height_fill_source, CASE WHEN target_height IS NULL THEN 1 ELSE 0 END AS target_height_was_predicted FROM m", _MODEL)


# ---- validation and maps: the filled rows, some of them damaged

def _filled(spark, sf_dir: str) -> DataFrame:
    rows = _model_rows(spark, sf_dir)
    filled = validation.fill_heights(rows, rows.select("component_id", F.lit(3.5).alias("target_height_predicted")))
    return filled.withColumns({
        "target_height_filled": F.expr("CASE WHEN component_id % 101 = 0 THEN NULL WHEN component_id % 103 = 0 THEN 600D WHEN component_id % 107 = 0 THEN target_height_filled + 1 ELSE target_height_filled END"),
        "target_height_fill_source": F.expr("CASE WHEN component_id % 109 = 0 THEN 'observed' ELSE target_height_fill_source END"),
    })


_FILLED = (
    "fl AS (SELECT *, CASE WHEN component_id % 101 = 0 THEN NULL WHEN component_id % 103 = 0 THEN 600.0 WHEN component_id % 107 = 0 THEN coalesce(target_height, 3.5) + 1 ELSE coalesce(target_height, 3.5) END AS filled, "
    "CASE WHEN target_height IS NULL THEN 1 ELSE 0 END AS was, CASE WHEN component_id % 109 = 0 OR target_height IS NOT NULL THEN 'observed' ELSE 'catboost' END AS src FROM m)"
)
_INTEGRITY = (
    "count(*) AS total, count(*) FILTER (filled IS NULL) AS filled_missing, count(*) FILTER (was = 0 AND target_height <> filled) AS observed_changed, "
    "count(*) FILTER (was = 1 AND target_height IS NOT NULL) AS predicted_with_original, count(*) FILTER (NOT ((was = 0 AND src = 'observed') OR (was = 1 AND src = 'catboost'))) AS flag_mismatch"
)


def integrity(spark, sf_dir: str) -> DataFrame:
    return validation.check(_filled(spark, sf_dir), validation.integrity())


INTEGRITY = oracle(f"SELECT {_INTEGRITY} FROM fl", _MODEL, _FILLED)


def ranges(spark, sf_dir: str) -> DataFrame:
    return validation.check(_filled(spark, sf_dir), validation.ranges())


RANGES = oracle(
    "SELECT count(*) AS total, min(filled) AS height_min, max(filled) AS height_max, count(*) FILTER (filled < 0) AS height_negative, count(*) FILTER (filled > 50) AS above_50, count(*) FILTER (filled > 300) AS above_300, "
    "count(*) FILTER (filled > 500) AS above_500, min(stairs) AS stairs_min, max(stairs) AS stairs_max, count(*) FILTER (stairs < 0) AS stairs_negative FROM fl",
    _MODEL, _FILLED,
)


def describe_filled(spark, sf_dir: str) -> DataFrame:
    out = p.describe5(_filled(spark, sf_dir).where("target_height_was_predicted = 0"), "target_height_filled")
    return out.select(*_r(*out.columns))


DESCRIBE_FILLED = oracle("SELECT round(avg(filled), 6) AS mean, round(median(filled), 6) AS median, min(filled) AS min, max(filled) AS max, round(stddev_pop(filled), 6) AS std FROM fl WHERE was = 0", _MODEL, _FILLED)


def spatial_gap(spark, sf_dir: str) -> DataFrame:
    rows = _filled(spark, sf_dir)
    near = neighbors.neighbor_features(rows.select("component_id", "target_height", "cx", "cy"), radii=(100,))
    return validation.spatial_gap(rows.join(near, "component_id")).select("n", *_r("mean", "p50", "p75", "p90", "p95", "p99"), "above_20")


_GAP = (
    "nb AS (SELECT l.component_id, avg(r.target_height) AS nm FROM fl l JOIN fl r ON l.component_id <> r.component_id AND sqrt((l.cx - r.cx) ** 2 + (l.cy - r.cy) ** 2) <= 100 GROUP BY 1)",
    "gp AS (SELECT abs(filled - nm) AS gap FROM fl JOIN nb USING (component_id) WHERE was = 0 AND nm IS NOT NULL)",
)
SPATIAL_GAP = oracle("SELECT count(gap) AS n, round(avg(gap), 6) AS mean, " + ", ".join(f"round(quantile_cont(gap, {q}), 6) AS p{round(q * 100)}" for q in (0.5, 0.75, 0.9, 0.95, 0.99)) + ", count(*) FILTER (gap > 20) AS above_20 FROM gp", _MODEL, _FILLED, *_GAP)


def valid_score(spark, sf_dir: str) -> DataFrame:
    return validation.score(_filled(spark, sf_dir)).select("total", "filled_missing", "flag_mismatch", "observed_changed", "predicted_with_original", "above_500", "score", "label")


def _label_sql(steps: dict[int, str], worst: str) -> str:
    return "CASE " + " ".join(f"WHEN score >= {k} THEN '{v}'" for k, v in sorted(steps.items(), reverse=True)) + f" ELSE '{worst}' END"


VALID_SCORE = oracle(
    f"SELECT *, {_label_sql(VALIDATION_LABELS, VALIDATION_WORST)} AS label FROM (SELECT *, CAST(round(100 - (filled_missing * 20 + flag_mismatch * 10 + observed_changed * 6 + predicted_with_original * 6 + above_500 * 6) * 1.0 / total) AS INT) AS score "
    f"FROM (SELECT {_INTEGRITY}, count(*) FILTER (filled > 500) AS above_500 FROM fl))",
    _MODEL, _FILLED,
)


def eda_score(spark, sf_dir: str) -> DataFrame:
    rows = footprints_b(spark, sf_dir)
    counts = rows.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.expr("purpose_of_building IS NULL OR stairs IS NULL OR height IS NULL")).alias("rows_with_missing"), F.count_if(F.expr("area < 15")).alias("invalid_geom"),
        F.count_if(F.expr("id % 50 = 0")).alias("null_geom"), F.lit(0).alias("empty_geom"), F.count_if(F.expr("id % 9 = 0")).alias("signature_dups"), F.lit(1).alias("invalid_holes"),
    ).withColumn("score", quality_score())
    return counts.select("total", "rows_with_missing", "score", quality_label("score").alias("label"))


EDA_SCORE = oracle(
    f"SELECT *, {_label_sql(QUALITY_LABELS, QUALITY_WORST)} AS label FROM (SELECT total, rows_with_missing, CAST(round(100 - (rows_with_missing * 32 + bad * 32 + nul * 14 + dup * 8 + 4) * 1.0 / total) AS INT) AS score FROM "
    "(SELECT count(*) AS total, count(*) FILTER (purpose_of_building IS NULL OR stairs IS NULL OR height IS NULL) AS rows_with_missing, count(*) FILTER (area < 15) AS bad, count(*) FILTER (id % 50 = 0) AS nul, count(*) FILTER (id % 9 = 0) AS dup FROM fb))"
)


def _mapped(spark, sf_dir: str) -> DataFrame:
    rows = _filled(spark, sf_dir).withColumns({"lon": F.lit(_EAST) + F.col("cx") * _SCALE, "lat": F.lit(_NORTH) + F.col("cy") * _SCALE})
    return rows.withColumn("target_height_reliability", F.expr("CASE component_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'none' END"))


def height_points(spark, sf_dir: str) -> DataFrame:
    return maplayers.height_points(_mapped(spark, sf_dir)).select(*_r("lat", "lon"), "weight")


HEIGHT_POINTS = oracle(f"SELECT round({_NORTH} + cy * {_SCALE}, 6) AS lat, round({_EAST} + cx * {_SCALE}, 6) AS lon, filled AS weight FROM fl WHERE filled <= 200", _MODEL, _FILLED)


def confidence_points(spark, sf_dir: str) -> DataFrame:
    return maplayers.confidence_points(_mapped(spark, sf_dir)).select("component_id", "confidence_score", "colour")


CONFIDENCE_POINTS = oracle(
    "SELECT component_id, s AS confidence_score, CASE s WHEN 3 THEN '#2c7bb6' WHEN 2 THEN '#abd9e9' WHEN 1 THEN '#fdae61' WHEN 0.5 THEN '#ffffbf' ELSE '#d7191c' END AS colour "
    "FROM (SELECT component_id, CAST(CASE WHEN was = 1 THEN 0.5 ELSE 3 - component_id % 4 END AS DOUBLE) AS s FROM fl)",
    _MODEL, _FILLED,
)


def grid_keys(spark, sf_dir: str) -> DataFrame:
    return footprints_a(spark, sf_dir).select("id", grid_key("cx", "cy", 1000).alias("down"), grid_key("cx", "cy", 1000, nearest=True).alias("nearest"))


GRID_KEYS = oracle("SELECT id, CAST(floor(cx / 1000) AS BIGINT) || '_' || CAST(floor(cy / 1000) AS BIGINT) AS down, CAST(round_even(cx / 1000, 0) AS BIGINT) || '_' || CAST(round_even(cy / 1000, 0) AS BIGINT) AS nearest FROM fa")

QUERIES = {
    "geo_rect_measures": (rect_measures, RECT_MEASURES),
    "geo_shape_features": (shape_features, SHAPE_FEATURES),
    "geo_wkt_roundtrip_area": (wkt_roundtrip, WKT_ROUNDTRIP),
    "geo_project_mercator": (project_mercator, PROJECT_MERCATOR),
    "geo_project_utm": (project_utm, PROJECT_UTM),
    "geo_grid_keys": (grid_keys, GRID_KEYS),
    "match_geometry_source": (geometry_source, GEOMETRY_SOURCE),
    "profile_null_share": (null_share, NULL_SHARE),
    "profile_value_counts": (value_counts, VALUE_COUNTS),
    "profile_describe": (describe, DESCRIBE),
    "profile_top_k": (top_k, TOP_K),
    "profile_sample_fixed": (sample_fixed, SAMPLE_FIXED),
    "profile_signature_dups": (signature_dups, SIGNATURE_DUPS),
    "profile_hash_dups": (hash_dups, HASH_DUPS),
    "profile_duplicate_examples": (duplicate_examples, DUPLICATE_EXAMPLES),
    "profile_unique_audit": (unique_audit, UNIQUE_AUDIT),
    "profile_any_null": (any_null, ANY_NULL),
    "profile_histogram_right_closed": (histogram_right, HISTOGRAM_RIGHT),
    "profile_histogram_left_closed": (histogram_left, HISTOGRAM_LEFT),
    "profile_clipped": (clipped, CLIPPED),
    "model_spatial_groups": (spatial_groups, SPATIAL_GROUPS),
    "model_spatial_folds": (spatial_folds, SPATIAL_FOLDS),
    "model_regression_metrics": (regression_metrics, REGRESSION_METRICS),
    "model_fold_summary": (fold_summary, FOLD_SUMMARY),
    "model_linear_sets": (linear_sets, LINEAR_SETS),
    "model_linear": (_model("linear", {}), None),
    "model_forest": (_model("forest", modelling.BEST["forest"]), None),
    "model_gbt": (_model("ordered_categories", modelling.BEST["ordered_categories"]), None),
    "model_fill_provenance": (fill_provenance, FILL_PROVENANCE),
    "valid_integrity": (integrity, INTEGRITY),
    "valid_ranges": (ranges, RANGES),
    "valid_describe": (describe_filled, DESCRIBE_FILLED),
    "valid_spatial_gap": (spatial_gap, SPATIAL_GAP),
    "valid_score": (valid_score, VALID_SCORE),
    "report_eda_score": (eda_score, EDA_SCORE),
    "map_height_points": (height_points, HEIGHT_POINTS),
    "map_confidence_points": (confidence_points, CONFIDENCE_POINTS),
}
