"""Profiling operators: each gives a small table about a frame of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.functions.numeric import number
from plinth.operators.ranking import quantiles
from plinth.storage import checkpoint


def existing(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the list that the frame has."""
    return df.select(*(c for c in columns if c in df.columns))


def metrics(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(metric, value as text) from one aggregation pass, in the order given."""
    one = df.agg(*(v.cast("string").alias(k) for k, v in values.items()))
    return one.unpivot([], list(values), "metric", "value")


def value_counts(df: DataFrame, column: str, n: int | None = None, nulls: bool = True, name: str | None = None) -> DataFrame:
    """Values and their counts, most frequent first, ties by value; the first ``n`` if given."""
    rows = df if nulls else df.where(F.col(column).isNotNull())
    out = rows.groupBy(F.col(column).alias(name or column)).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc_nulls_last(name or column))
    return out if n is None else out.limit(n)


def null_share(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, na_count, na_share_pct to two decimals)."""
    columns = columns or df.columns
    one = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns), F.count(F.lit(1)).alias("__n"))
    out = one.unpivot(["__n"], columns, "column", "na_count")
    return out.select("column", "na_count", F.when(F.col("__n") > 0, F.rint(F.col("na_count") / F.col("__n") * 10000) / 100).alias("na_share_pct"))


def describe(df: DataFrame, columns: list[str], percentiles: list[float] | None = None) -> DataFrame:
    """A row a column: count, mean, std (ddof 1), min, the exact percentiles asked for and p50, max."""
    ps = sorted({*(percentiles or [0.25, 0.5, 0.75]), 0.5})
    df = checkpoint(df.select(*(number(c).alias(f"v{k}") for k, c in enumerate(columns))))  # what is behind it is computed once
    parts, measures = [], []
    for k, c in enumerate(columns):
        v = F.col(f"v{k}")
        measures += [F.count(v).alias(f"n{k}"), F.avg(v).alias(f"m{k}"), F.stddev_samp(v).alias(f"s{k}"), F.min(v).alias(f"lo{k}"), F.max(v).alias(f"hi{k}")]
        q = [F.col(f"q{k}")[i].alias(percent(p)) for i, p in enumerate(ps)]
        parts.append(F.struct(F.lit(c).alias("column"), F.col(f"n{k}").alias("count"), F.col(f"m{k}").alias("mean"), F.col(f"s{k}").alias("std"), F.col(f"lo{k}").alias("min"), *q, F.col(f"hi{k}").alias("max")))
    one = df.agg(*measures).crossJoin(quantiles(df, {f"q{k}": (F.col(f"v{k}"), ps) for k in range(len(columns))}))  # a row each
    return one.select(F.array(*parts).alias("rows")).select(F.inline("rows"))


def percent(p: float) -> str:
    """Name of a percentile's column: p50, p1, p99."""
    return f"p{p * 100:g}".replace(".", "_")


def describe5(df: DataFrame, column: str) -> DataFrame:
    """mean, median, min, max and std (ddof 0) of what is a number."""
    df, v = checkpoint(df.select(number(column).alias("v"))), F.col("v")
    one = df.agg(F.avg(v).alias("mean"), F.min(v).alias("min"), F.max(v).alias("max"), F.stddev_pop(v).alias("std"))
    one = one.crossJoin(quantiles(df, {"q": (v, [0.5])})).withColumn("median", F.col("q")[0])  # a row each
    return one.select(*(F.coalesce(n, F.lit(0.0)).alias(n) for n in ("mean", "median", "min", "max", "std")))


def duplicates_audit(df: DataFrame, key: str) -> DataFrame:
    """rows, distinct values, and rows beyond the first of each value, of a key column."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_unique"), (F.count(key) - F.countDistinct(key)).alias("n_duplicated"))


def mark_duplicates(df: DataFrame, key: str, name: str = "is_duplicate") -> DataFrame:
    """Mark all rows whose key stands on more than one; null keys equal each other.

    Counts combine before the shuffle and are joined back, so a key that most
    rows share doesn't gather its rows in one task.
    """
    counts = df.groupBy(F.col(key).alias("__k")).agg((F.count(F.lit(1)) > 1).alias(name))
    return df.join(counts, F.col(key).eqNullSafe(F.col("__k")), "left").drop("__k")


def duplicate_groups(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The largest groups of rows with the same key: group (1, 2, ...), key, count."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("count")).where("count > 1").orderBy(F.desc("count"), key).limit(n)
    return counts.withColumn("duplicate_group", F.row_number().over(Window.orderBy(F.desc("count"), key))).select("duplicate_group", key, "count")


def duplicate_examples(df: DataFrame, key: str, columns: list[str], n_groups: int = 5) -> DataFrame:
    """The rows of the largest groups, with the group's number."""
    groups = duplicate_groups(df, key, n_groups).drop("count")
    return df.join(F.broadcast(groups), key).select("duplicate_group", key, *(c for c in columns if c in df.columns))  # n_groups rows


def duplicate_summary(df: DataFrame, key: str) -> DataFrame:
    """One row: total, rows in groups of more than one, their share, and the number of such groups."""
    groups = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicates"),
        F.count_if((F.col("n") > 1) & F.col(key).isNotNull()).alias("groups"),
    ).withColumn("share", F.when(F.col("total") > 0, F.col("duplicates") / F.col("total")))


def top_k(df: DataFrame, by: str, n: int, tie: str, columns: list[str] | None = None) -> DataFrame:
    """The n rows of the largest ``by``, nulls last, ties by ``tie``."""
    out = df.orderBy(F.desc_nulls_last(by), tie).limit(n)
    return existing(out, columns) if columns else out


def head(df: DataFrame, n: int, order: str) -> DataFrame:
    return df.orderBy(order).limit(n)


def fixed_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same on every run: those of the smallest hash of seed and key."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def histogram(df: DataFrame, column: str, bins: int, left_closed: bool = False) -> DataFrame:
    """(bin from 1, count) over equal widths between least and largest value; empty bins aren't listed.

    Right-closed bins hold their upper edge (the first also its lower);
    left-closed bins hold their lower edge (the last also its upper).
    """
    v = number(column)
    ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
    rows = df.select(v.alias("v")).where("v IS NOT NULL").crossJoin(F.broadcast(ends))
    width = (F.col("hi") - F.col("lo")) / bins
    place = F.floor((F.col("v") - F.col("lo")) / width) + 1 if left_closed else F.ceil((F.col("v") - F.col("lo")) / width)
    held = F.when(width > 0, F.least(F.greatest(place, F.lit(1)), F.lit(bins))).otherwise(F.lit(1)).cast("int")
    return rows.groupBy(held.alias("bin")).agg(F.count(F.lit(1)).alias("count"))


def clipped(df: DataFrame, column: str, q: float = 0.99) -> DataFrame:
    """The rows up to the column's exact quantile q."""
    edge = quantiles(df, {"__q": (number(column), [q])}).select(F.col("__q")[0].alias("__edge"))
    return df.crossJoin(F.broadcast(edge)).where(F.col(column) <= F.col("__edge")).drop("__edge")


def any_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows, and how many of them have a null in any column."""
    test = F.lit(False)
    for c in columns or df.columns:
        test = test | F.col(c).isNull()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(test).alias("rows_with_missing"))


def sum_number(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.coalesce(F.sum(number(column)), F.lit(0.0)).alias("total"))
