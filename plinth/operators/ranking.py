"""Global order without a global task: running totals and ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.storage import checkpoint


def running_total(df: DataFrame, order: list[Column], totals: dict[str, str | Column]) -> DataFrame:
    """Add, for each (name, value) of ``totals``, the sum of the value over all rows before this one.

    Rows are dealt by range of ``order``; each range is summed in its own task
    and then shifted by the total of the ranges before it. Only one row a
    range ever meets in one task. Rows that tie in ``order`` are dealt over
    ranges like any other and get totals in some order. Null values count as 0.
    ``df`` is computed twice (once to choose the ranges): checkpoint it first
    where that is dear.
    """
    values = {name: F.coalesce(F.col(v) if isinstance(v, str) else v, F.lit(0)).cast("long") for name, v in totals.items()}
    pid, parts = "__range", int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.withColumns({f"__v_{n}": v for n, v in values.items()} | {"__tie": F.monotonically_increasing_id()})
    dealt = dealt.repartitionByRange(parts, *order, F.col("__tie")).drop("__tie")
    dealt = checkpoint(dealt.withColumn(pid, F.spark_partition_id()))
    upto = Window.partitionBy(pid).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy(pid).agg(*(F.sum(f"__v_{n}").alias(f"__s_{n}") for n in values))
    starts = sums.select(pid, *(F.coalesce(F.sum(f"__s_{n}").over(before), F.lit(0)).alias(f"__o_{n}") for n in values))
    local = dealt.withColumns({n: F.coalesce(F.sum(f"__v_{n}").over(upto), F.lit(0)) for n in values})
    out = local.join(F.broadcast(starts), pid)
    return out.withColumns({n: F.col(n) + F.col(f"__o_{n}") for n in values}).drop(pid, *(f"__{k}_{n}" for k in "vo" for n in values))


#: Distinct values up to which an aggregate may hold a column's counts in one task.
MOST_DISTINCT = 500_000


def quantiles(df: DataFrame, wanted: dict[str, tuple[Column, list[float]]], most: int = MOST_DISTINCT) -> DataFrame:
    """One row: for each name, the array of exact interpolated quantiles of its column; nulls where it has no value.

    Spark's exact percentile keeps a count a distinct value in one task. It is
    used for columns of few distinct values; of the others the values are
    counted, dealt by range and ranked by a running total, and only the rows
    that hold the wanted ranks leave their tasks. ``df`` is read once a column.
    """
    found = df.agg(*(F.approx_count_distinct(v).alias(n) for n, (v, _) in wanted.items())).first().asDict() if wanted else {}
    few = {n: w for n, w in wanted.items() if found[n] <= most}
    out = df.agg(F.lit(1).alias("__one"), *(F.percentile(v, F.array(*(F.lit(float(q)) for q in qs))).alias(n) for n, (v, qs) in few.items()))
    for n, (v, qs) in wanted.items():
        if n not in few:
            out = out.crossJoin(_ranked(df.select(v.cast("double").alias("v")).where("v IS NOT NULL"), qs).withColumnRenamed("q", n))  # a row each
    return out.select(*wanted)


def _ranked(values: DataFrame, qs: list[float]) -> DataFrame:
    """One row, q: the exact quantiles of the column v."""
    counts = checkpoint(values.groupBy("v").agg(F.count(F.lit(1)).alias("n")))
    n = counts.agg(F.sum("n")).first()[0] or 0
    places = [q * (n - 1) for q in qs]
    ranks = sorted({int(f) for p in places for f in (p // 1, -(-p // 1))})
    held = running_total(counts, [F.col("v")], {"before": "n"})
    at = F.filter(F.array(*(F.lit(r).cast("long") for r in ranks)), lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))
    by_rank = held.select("v", F.explode(at).alias("r")).agg(F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("m"))  # two rows a quantile

    def value(p: float) -> Column:
        low, high = int(p // 1), int(-(-p // 1))
        a, b = (F.col("m")[F.lit(k).cast("long")] for k in (low, high))
        return a + (b - a) * F.lit(p - low) if high > low else a

    return by_rank.select(F.array(*(value(p) for p in places)).alias("q"))


def group_quantiles(df: DataFrame, group: str, value: str, qs: list[float], most: int = MOST_DISTINCT) -> DataFrame:
    """(group, q): the array of exact interpolated quantiles of each group's values; no row for the null group, nulls for a group without values.

    Where no group has more than ``most`` distinct values, Spark's exact percentile
    keeps their counts in one task. Else the counts of (group, value) are dealt by
    range over all groups at once and ranked by one running total, less what stands
    before the group, so that a group of any size is dealt over many tasks; only the
    rows that hold a wanted rank leave them. ``df`` is read twice: checkpoint it first
    where that is dear.
    """
    rows = df.where(F.col(group).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    largest = rows.groupBy("g").agg(F.approx_count_distinct("v").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= most:
        return rows.groupBy(F.col("g").alias(group)).agg(F.percentile("v", F.array(*(F.lit(float(q)) for q in qs))).alias("q"))
    counts = checkpoint(rows.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n")))
    held = checkpoint(running_total(counts.where("v IS NOT NULL"), [F.col("g"), F.col("v")], {"before": "n"}))
    groups = held.groupBy("g").agg(F.min("before").alias("start"), F.sum("n").alias("total"))
    placed = held.join(groups, "g").withColumn("before", F.col("before") - F.col("start"))
    place = [F.lit(float(q)) * (F.col("total") - 1) for q in qs]
    ranks = F.array_distinct(F.array(*(f(p).cast("long") for p in place for f in (F.floor, F.ceil))))
    at = F.filter(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))
    by_rank = placed.select("g", "total", "v", F.explode(at).alias("r")).groupBy("g").agg(F.first("total").alias("total"), F.map_from_entries(F.collect_list(F.struct("r", "v"))).alias("m"))  # two rows a quantile

    def value_at(p: Column) -> Column:
        low, high = (F.col("m")[f(p).cast("long")] for f in (F.floor, F.ceil))
        return low + (high - low) * (p - F.floor(p))

    told = by_rank.select("g", F.array(*(value_at(p) for p in place)).alias("q"))
    return counts.select("g").distinct().join(told, "g", "left").select(F.col("g").alias(group), "q")
