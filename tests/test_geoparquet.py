"""GeoParquet files: the footer, the curve, and row groups that a box passes over."""

import glob
import json
import struct

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from plinth.sources import geoparquet


def _square(x, y):
    ring = [(x, y), (x + 1, y), (x + 1, y + 1), (x, y + 1), (x, y)]
    return struct.pack("<BIII", 1, 3, 1, 5) + b"".join(struct.pack("<dd", *p) for p in ring)


def test_hilbert_is_a_curve(spark):
    cells = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    path = [(r["x"], r["y"]) for r in cells.orderBy(geoparquet.hilbert("x", "y")).collect()]
    assert len(set(path)) == 256 and all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(path, path[1:]))


def test_files_and_boxes(spark, tmp_path):
    rows = [(i, bytearray(_square(3.0 * (i % 40), 3.0 * (i // 40)))) for i in range(1600)] + [(1600, None)]
    df = spark.createDataFrame(rows, "id long, wkb binary").repartition(7)
    path = str(tmp_path / "g")
    assert geoparquet.write_geoparquet(df, path, files=4, group_rows=50) == 4
    files = glob.glob(f"{path}/*.parquet")
    assert len(files) == 4 and len(glob.glob(f"{tmp_path}/g*")) == 1
    met = groups = 0
    for f in files:
        meta = pq.ParquetFile(f).metadata
        geo = json.loads(meta.metadata[b"geo"])
        assert geo["primary_column"] == "geometry" and geo["columns"]["geometry"]["encoding"] == "WKB" and geo["columns"]["geometry"]["geometry_types"] == ["Polygon"]
        at = {meta.row_group(0).column(c).path_in_schema: c for c in range(meta.num_columns)}
        low, high = geo["columns"]["geometry"]["bbox"][0], geo["columns"]["geometry"]["bbox"][2]
        for g in range(meta.num_row_groups):
            of = {k: meta.row_group(g).column(at[f"bbox.{k}"]).statistics for k in ("xmin", "ymin", "xmax", "ymax")}
            assert low <= of["xmin"].min and of["xmax"].max <= high
            groups += 1
            met += of["xmin"].min <= 10 and of["ymin"].min <= 10
    assert groups >= 32 and met <= groups // 4  # a corner's box meets few row groups
    everything = geoparquet.read_box(spark, path)
    assert sorted((r["id"], r["geometry"]) for r in everything.collect()) == sorted(rows)
    found = geoparquet.read_box(spark, path, (0, 0, 10, 10))
    assert {r["id"] for r in found.collect()} == {40 * j + i for i in range(4) for j in range(4)}
    plan = found._jdf.queryExecution().executedPlan()
    assert "PushedFilters: [" in plan.toString() and "bbox" in plan.toString().split("PushedFilters: [")[1]
    assert 16 <= plan.collectLeaves().head().metrics().apply("numOutputRows").value() <= 400  # rows that the scan let through, of 1,601


def test_empty_and_replaced(spark, tmp_path):
    path = str(tmp_path / "e")
    one = spark.createDataFrame([(1, bytearray(_square(0, 0)))], "id long, wkb binary")
    assert geoparquet.write_geoparquet(one, path) == 1 and geoparquet.write_geoparquet(one.limit(0), path) == 1
    assert geoparquet.read_box(spark, path, (0, 0, 1, 1)).count() == 0
