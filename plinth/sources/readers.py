"""Reading the two sources and intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plinth.functions.kernels import wkt_to_wkb

# The sources' columns.
SCHEMA_A = "`Unnamed: 0` long, id string, geometry string, area_sq_m double, title string, tags string, gkh_address string, gkh_floor_count_min double, gkh_floor_count_max double"
SCHEMA_B = (
    "id string, wkt string, purpose_of_building string, stairs double, avg_floor_height double, height double, subject string, district string, type string, locality string, "
    "type_street string, name_street string, number string, letter string, fraction string, housing string, building string"
)


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", quote: str = '"') -> DataFrame:
    """CSV with header; doubled quotes, line breaks in fields and a byte order mark are understood.

    Columns go by the header's names, in any order; ``NA`` and empty fields are
    null. With a schema, its columns are taken (null where the file lacks one).
    """
    options = {"header": True, "sep": sep, "quote": quote, "escape": quote, "multiLine": True, "encoding": "UTF-8"}
    raw = spark.read.options(**options).csv(path)
    raw = raw.toDF(*(c.lstrip("﻿") for c in raw.columns))
    raw = raw.withColumns({c: F.when(~F.col(f"`{c}`").isin("", "NA", "NaN", "nan"), F.col(f"`{c}`")) for c in raw.columns})
    if schema is None:
        return raw
    wanted = spark.createDataFrame([], schema).schema
    return raw.select(*((F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in wanted))


def read_footprints(spark: SparkSession, path: str, schema: str, wkt: str) -> DataFrame:
    """A source's CSV with its WKT parsed to ``wkb`` (null where it can't be)."""
    return read_csv(spark, path, schema).drop("Unnamed: 0").withColumn("wkb", wkt_to_wkb(F.col(wkt)))


def read_geoparquet(spark: SparkSession, path: str, geometry: str = "geometry") -> DataFrame:
    """Parquet whose geometry column holds WKB, as ``wkb``."""
    return spark.read.parquet(path).withColumnRenamed(geometry, "wkb")


def file_order() -> Column:
    """The rows' order in the files they are read from."""
    return F.monotonically_increasing_id()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, on whatever file system it names."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
