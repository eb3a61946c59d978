"""Writing tables, map layers and report books."""

from __future__ import annotations

import html
import json
import re
import sqlite3
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plinth.functions.kernels import wkb_to_wkt

SHEET_CHARS = re.compile(r"[\[\]:*?/\\]")
SHEET_LENGTH = 31


def write_parquet(df: DataFrame, path: str) -> None:
    """Parquet; a ``wkb`` column stays as it is, to be read by any reader."""
    df.write.mode("overwrite").parquet(path)


def flat(df: DataFrame, drop: tuple[str, ...] = ("wkb",), as_wkt: bool = False) -> DataFrame:
    """What CSV can hold: geometry dropped or as WKT, nested columns as JSON."""
    df = df.withColumn("wkb", wkb_to_wkt(F.col("wkb"))) if as_wkt and "wkb" in df.columns else df.drop(*drop)
    nested = [f.name for f in df.schema if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    return df.withColumns({c: F.to_json(c) for c in nested})


def write_csv(df: DataFrame, path: str, as_wkt: bool = False) -> None:
    flat(df, as_wkt=as_wkt).write.mode("overwrite").options(header=True, escape='"').csv(path)


def write_geojson_lines(df: DataFrame, path: str, lon: str = "lon", lat: str = "lat") -> None:
    """One GeoJSON point feature a line, all other columns as properties."""
    props = F.struct(*(c for c in df.columns if c not in (lon, lat)))
    shape = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), props.alias("properties"))).alias("value")).write.mode("overwrite").text(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One text file, such as a page, on whatever file system the path names."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


#: Type of a column in a GeoPackage, by Spark's type.
_SQLITE = {"tinyint": "TINYINT", "smallint": "SMALLINT", "int": "MEDIUMINT", "bigint": "INTEGER", "float": "FLOAT", "double": "DOUBLE", "boolean": "BOOLEAN", "binary": "BLOB"}


def write_geopackage(df: DataFrame, path: str, layer: str, wkb: str = "wkb", srs: int = 32635) -> int:
    """A GeoPackage of one layer; returns the rows written.

    The format is one SQLite file, so one process writes it: rows come to the
    driver a partition at a time. ``path`` is local and must not exist.
    """
    rows = flat(df.withColumnRenamed(wkb, "geom"), drop=())
    others = [f for f in rows.schema if f.name not in ("geom", "fid")]
    # The tables, columns and identifiers of the GeoPackage standard.
    con = sqlite3.connect(f"file:{path}?mode=rwc", uri=True)
    with con:
        con.execute("PRAGMA application_id = 1196444487")
        con.execute("PRAGMA user_version = 10300")
        con.execute("CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT)")
        con.executemany("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, ?, ?)", [("Undefined cartesian", -1, "NONE", -1, "undefined", None), ("Undefined geographic", 0, "NONE", 0, "undefined", None), ("WGS 84", 4326, "EPSG", 4326, "EPSG:4326", None)])
        if srs not in (-1, 0, 4326):
            con.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, ?, NULL)", (f"EPSG {srs}", srs, srs, f"EPSG:{srs}"))
        con.execute("CREATE TABLE gpkg_contents (table_name TEXT NOT NULL PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER)")
        con.execute("CREATE TABLE gpkg_geometry_columns (table_name TEXT NOT NULL, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL, PRIMARY KEY (table_name, column_name))")
        con.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, srs_id) VALUES (?, 'features', ?, ?)", (layer, layer, srs))
        con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'GEOMETRY', ?, 0, 0)", (layer, srs))

        def quoted(name: str) -> str:
            return '"' + name.replace('"', '""') + '"'

        columns = "".join(f", {quoted(f.name)} {_SQLITE.get(f.dataType.simpleString(), 'TEXT')}" for f in others)
        con.execute(f"CREATE TABLE {quoted(layer)} (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom BLOB{columns})")
        insert = f"INSERT INTO {quoted(layer)} (geom{''.join(', ' + quoted(f.name) for f in others)}) VALUES ({', '.join('?' * (len(others) + 1))})"
        head = struct.pack("<2sBBi", b"GP", 0, 1, srs)  # little-endian, without an envelope
        plain = rows.select("geom", *(F.col(f"`{f.name}`") if f.dataType.simpleString() in _SQLITE else F.col(f"`{f.name}`").cast("string") for f in others))
        n = 0
        for row in plain.toLocalIterator():
            con.execute(insert, [None if row[0] is None else head + bytes(row[0]), *row[1:]])
            n += 1
    con.close()
    return n


MAP_POINTS = 200_000
_MAP = """<!doctype html><html><head><meta charset="utf-8"><title>{title}</title></head><body><h1>{title}</h1><p>{said}</p><canvas id="c" width="1200" height="900"></canvas><script>
const points = {points};
const xs = points.map(p => p[0]), ys = points.map(p => p[1]), least = a => a.reduce((x, y) => Math.min(x, y)), most = a => a.reduce((x, y) => Math.max(x, y));
const c = document.getElementById("c"), g = c.getContext("2d");
if (points.length) {{
  const x0 = least(xs), y0 = least(ys), f = Math.cos(y0 * Math.PI / 180), s = Math.min(c.width / ((most(xs) - x0) * f || 1), c.height / (most(ys) - y0 || 1));
  for (const [x, y, colour] of points) {{ g.fillStyle = colour; g.fillRect((x - x0) * f * s, c.height - (y - y0) * s, 2, 2); }}
}}
</script></body></html>"""


def write_map(points: DataFrame, path: str, title: str, colour: str | None = None, most: int = MAP_POINTS) -> int:
    """A page that draws points (lon, lat) in their colour; returns how many.

    A page holds up to ``most`` points: of more, those of the smallest hashes are drawn, and the page says so.
    """
    rows = points.select(F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), (F.col(colour) if colour else F.lit("#2c7bb6")).alias("colour")).dropna()
    total = rows.count()
    held = rows.orderBy(F.xxhash64("lon", "lat", "colour")).limit(most) if total > most else rows
    drawn = [[r["lon"], r["lat"], r["colour"]] for r in held.collect()]
    said = f"{len(drawn)} of {total} points"
    write_text(points.sparkSession, _MAP.format(title=html.escape(title), said=said, points=json.dumps(drawn).replace("<", "\\u003c")), path)
    return len(drawn)


def sheet_name(name: str, used: set[str]) -> str:
    """A name that a workbook takes, not among ``used``, to which it is added."""
    base = SHEET_CHARS.sub("_", name).strip()[:SHEET_LENGTH] or "sheet"
    out, k = base, 1
    while out in used:
        tail = f"_{k}"
        out, k = base[: SHEET_LENGTH - len(tail)] + tail, k + 1
    used.add(out)
    return out


def write_book(spark: SparkSession, sheets: list[tuple[str, str, str, DataFrame]], path: str) -> DataFrame:
    """Write (section, name, description, table) sheets as folders of Parquet, and their index; returns the index.

    An empty table gets a row that says so.
    """
    used: set[str] = set()
    index = []
    for section, name, description, df in sheets:
        name = sheet_name(name, used)
        if df.isEmpty():
            df = spark.createDataFrame([("no rows",)], "message string")
        write_parquet(df, f"{path}/{name}")
        index.append((section, name, description, spark.read.parquet(f"{path}/{name}").count(), len(df.columns)))
    table = spark.createDataFrame(index, "section string, sheet_name string, description string, n_rows long, n_cols int")
    write_parquet(table, f"{path}/sheet_index")
    return table


def read_book(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All sheets of a book by name."""
    names = [r["sheet_name"] for r in spark.read.parquet(f"{path}/sheet_index").select("sheet_name").collect()]  # a row a sheet
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def metric_values(sheet: DataFrame) -> dict[str, str]:
    """A (metric, value) sheet as a dictionary."""
    return {r["metric"]: r["value"] for r in sheet.select("metric", "value").collect()}  # a row a metric
