"""Footprint fixtures over the ``part`` table, as SQL that Spark and DuckDB evaluate alike.

Rectangles on a half-metre grid: every overlap measure has a closed form and
every area is an exact double.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plinth.storage import spread

FIXTURE_A = """
SELECT p_partkey AS id,
  cast((p_partkey * 7919) % 3000 AS double) AS x0, cast((p_partkey * 104729) % 3000 AS double) AS y0,
  cast(2 + p_size % 20 AS double) AS w, cast(2 + p_partkey % 13 AS double) AS h,
  p_type AS tags, p_name AS title,
  CASE WHEN p_partkey % 10 = 0 THEN cast(1 + p_size % 9 AS double) END AS gkh_floor_count_min,
  CASE WHEN p_partkey % 10 = 0 THEN cast(1 + p_partkey % 70 / 10 AS double) END AS gkh_floor_count_max
FROM {part} WHERE p_partkey % 6 <> 5
"""

FIXTURE_B = """
SELECT p_partkey * 10 + k AS id,
  cast((p_partkey * 7919) % 3000 AS double) + cast(p_partkey % 4 AS double) * 0.5
    + CASE WHEN k = 1 THEN cast(2 + p_size % 20 AS double) / 2 ELSE cast(0 AS double) END AS x0,
  cast((p_partkey * 104729) % 3000 AS double) + cast(p_partkey % 3 AS double) * 0.5 AS y0,
  CASE WHEN p_partkey % 11 = 0 THEN cast(2 + p_size % 20 AS double) / 2
       WHEN p_partkey % 13 = 0 THEN cast(40 + p_size % 20 AS double)
       ELSE cast(2 + p_size % 20 AS double) END AS w,
  CASE WHEN p_partkey % 13 = 0 THEN cast(40 AS double) ELSE cast(2 + p_partkey % 13 AS double) END AS h,
  CASE WHEN p_partkey % 43 = 0 THEN NULL WHEN p_partkey % 89 = 0 THEN 'GREENHOUSE' ELSE p_type END AS purpose_of_building,
  CASE WHEN p_partkey % 41 = 0 THEN NULL WHEN p_partkey % 97 = 0 THEN cast(0 AS double) ELSE cast(1 + p_size % 25 AS double) END AS stairs,
  CASE WHEN p_partkey % 37 = 0 THEN cast(0 AS double) WHEN p_partkey % 499 = 0 THEN cast(12 AS double)
       ELSE cast(3 AS double) + cast(p_partkey % 3 AS double) * 0.5 END AS avg_floor_height,
  CASE WHEN p_partkey % 211 = 0 THEN NULL
       ELSE cast(1 + p_size % 25 AS double) * 3 + cast(p_partkey % 8 AS double) * 0.5 END AS height
FROM {part} CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) t
WHERE p_partkey % 5 <> 4 AND (k = 0 OR p_partkey % 11 = 0)
"""

#: The value of ``purpose_of_building`` in the fixtures that is no building.
IRRELEVANT = "GREENHOUSE"


def footprints_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxed(spark.sql(FIXTURE_A, part=spread(spark.read.parquet(f"{sf_dir}/part.parquet"))))


def footprints_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxed(spark.sql(FIXTURE_B, part=spread(spark.read.parquet(f"{sf_dir}/part.parquet"))))


def _boxed(df: DataFrame) -> DataFrame:
    """The rectangle as a box, with the measures that polygons get from kernels."""
    return df.selectExpr(
        "*", "x0 AS minx", "y0 AS miny", "x0 + w AS maxx", "y0 + h AS maxy", "w * h AS area", "2 * (w + h) AS perimeter", "x0 + w / 2 AS cx", "y0 + h / 2 AS cy"
    )


def oracle(body: str, *ctes: str, recursive: bool = False) -> str:
    """DuckDB SQL: the fixtures as fa and fb, more CTEs, then the body."""
    boxed = "SELECT *, x0 AS minx, y0 AS miny, x0 + w AS maxx, y0 + h AS maxy, w * h AS area, 2 * (w + h) AS perimeter, x0 + w / 2 AS cx, y0 + h / 2 AS cy FROM"
    base = [f"fa AS ({boxed} ({FIXTURE_A.format(part='part')}))", f"fb AS ({boxed} ({FIXTURE_B.format(part='part')}))"]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([*base, *ctes]) + "\n" + body
