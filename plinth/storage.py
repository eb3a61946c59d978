"""Staging of intermediate results in the folder that a cluster shares.

Lineage is cut only through reliable storage: ``spark.checkpoint.dir`` as the
session names it. Where it names none, a folder of our own is set in local mode;
on a cluster, whose executors couldn't share that, RuntimeError is raised.

What is checkpointed or staged inside ``scratch`` is deleted at its end.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_SETTING = "spark.checkpoint.dir"
_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables."""
    named = spark.conf.get(_SETTING, None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    own = sc.getCheckpointDir()
    if not own:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError(f"{_SETTING} must name a folder that the cluster shares")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="plinth-checkpoints-"))
        own = sc.getCheckpointDir()
    return own.rstrip("/")


def checkpoint(df: DataFrame, **measures: Column) -> DataFrame:
    """Compute ``df`` once and cut its lineage, in the shared folder.

    The result's ``measured`` holds its number of ``rows`` and the aggregates of
    ``measures``, which come from the same pass.
    """
    shared_dir(df.sparkSession)
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows"), *(m.alias(k) for k, m in measures.items())).checkpoint(eager=True)
    file = out._jdf.queryExecution().logical().rdd().getCheckpointFile()
    out.__dict__.update(measured=seen.get, files=[file.get()] if file.isDefined() else [])
    held = _scratch.get()
    if held is not None:
        held.extend(out.__dict__["files"])
    return out


def row_count(df: DataFrame) -> int:
    """Rows of a frame, without a pass if ``checkpoint`` returned it."""
    measured = df.__dict__.get("measured")  # not a column of that name
    return measured["rows"] if measured else df.count()


def compact(df: DataFrame, rows: int = 100_000, least: int = 8) -> DataFrame:
    """A frame that ``checkpoint`` returned, read in partitions of about so many rows if it has more of them than that (and than ``least``)."""
    few = max(least, -(-row_count(df) // rows))
    if df._jdf.queryExecution().logical().rdd().getNumPartitions() <= few:
        return df
    out = df.coalesce(few)
    out.__dict__.update(measured=df.__dict__["measured"], files=df.__dict__["files"])
    return out


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Rows dealt over the cluster's cores before work that costs far more than reading: a small file, or one that can't be split, is few tasks.

    With ``by`` they are dealt by those columns, for grouping: left to Spark, groups of few bytes go to few tasks, however long each takes.
    """
    parts = 4 * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(parts, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if by else parts, *by)


def release(*frames: DataFrame) -> None:
    """Delete frames that ``checkpoint`` returned; what is made of them must have been checkpointed or written by then."""
    for df in frames:
        for path in df.__dict__["files"]:
            remove_path(df.sparkSession, path)


def staging_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder."""
    path = f"{shared_dir(spark)}/plinth-staged/{label}-{uuid.uuid4().hex}"
    held = _scratch.get()
    if held is not None:
        held.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete at its end what is checkpointed or staged inside; what is made of it must have been written by then."""
    held: list[str] = []
    token = _scratch.set(held)
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in held:
            remove_path(spark, path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete ``path`` through the file system that owns it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def broadcast_within(df: DataFrame, rows: int, most_rows: int) -> DataFrame:
    """Mark ``df`` for broadcast only if its counted ``rows`` are within the bound."""
    return F.broadcast(df) if rows <= most_rows else df
