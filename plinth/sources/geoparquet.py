"""GeoParquet: rows along a Hilbert curve, a box column with statistics by row group, and the ``geo`` footer.

Spark's own writer can't set a file's metadata, so each task writes its range of the curve as one file under a folder of
its own name, and tells its name. Only files that a finished task told of are moved to their place; what lost or repeated
attempts left is deleted with the folder.
"""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions.geometry import bounds
from plinth.functions.kernels import wkb_to_geometry
from plinth.storage import checkpoint, remove_path

_SIDE = 16  # bits a side of the curve's grid
_BOX = ("xmin", "ymin", "xmax", "ymax")
# Geometry types by their code in WKB.
_TYPES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}


def hilbert(x: str, y: str) -> Column:
    """Place along the Hilbert curve of a cell (x, y) of a grid of 2^16 a side."""
    last = (1 << _SIDE) - 1
    rx, ry = "(shiftright(s.x, k) & 1)", "(shiftright(s.y, k) & 1)"
    turned = f"CASE WHEN {ry} = 1 THEN s.{{0}} WHEN {rx} = 1 THEN {last} - s.{{1}} ELSE s.{{1}} END"
    step = f"shiftleft(cast((3 * {rx}) ^ {ry} AS bigint), 2 * k)"
    start = f"struct(cast({x} AS int) AS x, cast({y} AS int) AS y, 0L AS d)"
    moved = f"struct({turned.format('x', 'y')} AS x, {turned.format('y', 'x')} AS y, s.d + {step} AS d)"
    return F.expr(f"aggregate(sequence({_SIDE - 1}, 0, -1), {start}, (s, k) -> {moved}, s -> s.d)")


def write_geoparquet(df: DataFrame, path: str, wkb: str = "wkb", crs: dict | None = None, files: int | None = None, group_rows: int = 50_000, geometry: str = "geometry") -> int:
    """Write ``df`` with its WKB column as ``geometry`` and a struct ``bbox``; returns the number of files.

    ``crs``: PROJJSON; none is written as null, an unknown one. ``files``: by default the session's shuffle partitions. Rows
    without geometry come last, with a null box. An empty table is one file without rows or footer. What was at ``path`` is replaced.
    """
    spark = df.sparkSession
    boxed = df.withColumnRenamed(wkb, geometry).withColumn("__g", wkb_to_geometry(F.col(geometry))).withColumn("__b", bounds("__g"))
    box = F.struct(*(F.col(f"__b.{k[1:]}{k[0]}").alias(k) for k in _BOX))
    boxed = boxed.withColumn("bbox", F.when(F.col("__b.minx").isNotNull(), box)).drop("__b", "__g")
    held = checkpoint(boxed, **{k: (F.min if "min" in k else F.max)(f"bbox.{k}") for k in _BOX})
    seen = held.__dict__["measured"]
    cell = {d: F.floor((F.col(f"bbox.{d}min") + F.col(f"bbox.{d}max") - 2 * F.lit(seen[f"{d}min"])) / 2 / F.lit(max((seen[f"{d}max"] or 0.0) - (seen[f"{d}min"] or 0.0), 1e-9)) * ((1 << _SIDE) - 1)) for d in "xy"}
    placed = held.withColumns({"__x": cell["x"], "__y": cell["y"]}).withColumn("__h", F.when(F.col("bbox").isNotNull(), hilbert("__x", "__y"))).drop("__x", "__y")
    dealt = placed.repartitionByRange(files or int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("__h").asc_nulls_last()).sortWithinPartitions(F.col("__h").asc_nulls_last()).drop("__h")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(conf)
    staged = f"{system.makeQualified(target).toString().rstrip('/')}.{uuid.uuid4().hex}"
    uri = staged if "://" in staged else staged.replace(":", "://", 1)  # file:/folder

    def write(batches):
        out, name, rows, kinds, box = None, f"part-{uuid.uuid4().hex}.parquet", 0, set(), [float("inf"), float("inf"), float("-inf"), float("-inf")]
        store, folder = fs.FileSystem.from_uri(uri)
        held_back, waiting = [], 0  # up to a row group
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                store.create_dir(folder, recursive=True)
                out = pq.ParquetWriter(f"{folder}/{name}", batch.schema, filesystem=store, compression="zstd", write_page_index=True)
            for i, k in enumerate(_BOX):
                found = (pc.min if "min" in k else pc.max)(pc.struct_field(batch.column("bbox"), k)).as_py()
                box[i] = box[i] if found is None else (min if "min" in k else max)(box[i], found)
            kinds |= {int.from_bytes(g[1:5], "little" if g[0] else "big") for g in batch.column(geometry).to_pylist() if g}
            held_back.append(batch)
            rows, waiting = rows + batch.num_rows, waiting + batch.num_rows
            if waiting >= group_rows:
                out.write_table(pa.Table.from_batches(held_back), row_group_size=group_rows)
                held_back, waiting = [], 0
        if out is not None:
            if held_back:
                out.write_table(pa.Table.from_batches(held_back), row_group_size=group_rows)
            out.add_key_value_metadata({"geo": json.dumps(footer(geometry, kinds, box if rows and box[0] <= box[2] else None, crs))})
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "rows": [rows]}, schema=pa.schema([("name", pa.string()), ("rows", pa.int64())]))

    told = dealt.mapInArrow(write, "name string, rows long").collect()  # a row a file
    remove_path(spark, path)
    system.mkdirs(target)
    for r in told:
        system.rename(jvm.org.apache.hadoop.fs.Path(f"{staged}/{r['name']}"), jvm.org.apache.hadoop.fs.Path(f"{path}/{r['name']}"))
    remove_path(spark, staged)
    if not told:
        held.coalesce(1).write.mode("overwrite").parquet(path)
    return max(1, len(told))


def footer(geometry: str, kinds: set[int], box: list[float] | None, crs: dict | None) -> dict:
    """A file's ``geo`` metadata, of version 1.1."""
    column = {"encoding": "WKB", "geometry_types": sorted(_TYPES[k] for k in kinds), "crs": crs, "covering": {"bbox": {k: ["bbox", k] for k in _BOX}}}
    if box:
        column["bbox"] = box
    return {"version": "1.1.0", "primary_column": geometry, "columns": {geometry: column}}


def read_box(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The rows whose box meets ``box``; row groups whose boxes don't are passed over."""
    rows = spark.read.parquet(path)
    if box is None:
        return rows
    x0, y0, x1, y1 = box
    return rows.where((F.col("bbox.xmin") <= x1) & (F.col("bbox.xmax") >= x0) & (F.col("bbox.ymin") <= y1) & (F.col("bbox.ymax") >= y0))
