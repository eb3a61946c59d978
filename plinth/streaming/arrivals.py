"""Cleaning footprints as they arrive.

The batch operators that look at one row at a time work on a stream as they are:
marking, parsing, validity, repair and holes of geometry, the area filter, the
floor swap and outlier reasons. Steps that need other rows (medians, duplicates)
belong to the batch that reads what is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from plinth.operators import cleaning


def read_arrivals(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Parquet files as they come into a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def clean_arrivals(rows: DataFrame, source: str, wkt: str | None = None, degrees: bool = True) -> tuple[DataFrame, DataFrame]:
    """(kept rows, audit) of a stream of source ``A`` or ``B``; ``wkt`` names the column of WKT, without which rows come with their area."""
    kept, audit = cleaning.begin(rows), None
    if wkt:
        kept, audit = cleaning.clean_geometry(cleaning.parse_geometry(kept, wkt, degrees))
    kept, small = cleaning.drop_small(kept)
    audit = small if audit is None else audit.unionByName(small)
    if source == "A":
        return cleaning.swap_floors(kept), audit
    kept, bad = cleaning.drop_outliers(kept)
    return kept, audit.unionByName(bad)


def write_arrivals(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to Parquet, exactly once, until what is there now is read."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
