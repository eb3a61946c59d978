"""Grouped quantiles by ranks against Spark's own, report bins against pandas, and inputs that are read once."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plinth.operators import cleaning, profiling, validation
from plinth.operators.ranking import group_quantiles


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(12)
    data = [(["hot", "a", "b", None][k % 7 if k % 7 < 4 else 0], None if k % 13 == 0 else float(rng.integers(0, 60)) / 4) for k in range(1500)]
    return spark.createDataFrame([*data, ("one", 3.5), ("empty", None), ("two", 1.0), ("two", 2.0)], "g string, v double").repartition(5)


@pytest.mark.parametrize("most", [0, 10**6])
def test_group_quantiles_equal_sparks(rows, most):
    qs = [0.0, 0.1, 0.5, 0.77, 1.0]
    got = {r["g"]: r["q"] for r in group_quantiles(rows, "g", "v", qs, most).collect()}
    want = {r["g"]: r["q"] for r in rows.where("g IS NOT NULL").groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, qs))).alias("q")).collect()}
    assert set(got) == set(want) == {"hot", "a", "b", "one", "two", "empty"}
    assert not any(got["empty"] or []) and not any(want["empty"] or [])
    for g in set(want) - {"empty"}:
        assert got[g] == pytest.approx(want[g], abs=1e-12)
    assert group_quantiles(rows.limit(0), "g", "v", qs, most).count() == 0


def test_medians_of_large_groups_fill_alike(rows, monkeypatch):
    df = cleaning.begin(rows.withColumns({"id": F.monotonically_increasing_id()}))
    few = sorted(map(tuple, cleaning.fill_by_group_median(df, "v", "g", F.col("v").isNull(), "f").select("g", "v").collect()), key=str)
    from plinth.operators import ranking

    monkeypatch.setattr(ranking.group_quantiles, "__defaults__", (0,))
    assert sorted(map(tuple, cleaning.fill_by_group_median(df, "v", "g", F.col("v").isNull(), "f").select("g", "v").collect()), key=str) == few


def test_report_bins_are_closed_on_the_right(spark):
    rng = np.random.default_rng(1)
    values = [0.0, 10.0, *np.arange(0, 10.5, 0.5), *rng.uniform(0, 10, 300)]
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = {r["bin"]: r["count"] for r in profiling.histogram(df, "v", 20).collect()}
    want = pd.cut(pd.Series(values), bins=20, include_lowest=True).value_counts(sort=False).tolist()
    assert [got.get(k + 1, 0) for k in range(20)] == want


def test_inputs_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def watched(x):
        seen.add(1)
        return float(x)

    df = spark.range(50, numPartitions=2).select(watched("id").alias("v"), F.lit(0).alias("target_height_was_predicted"), F.lit(1).alias("n_neighbors_100m"), F.lit(2.0).alias("neighbor_height_mean_100m")).withColumn("target_height_filled", F.col("v"))
    for f in (lambda: profiling.describe(df, ["v"]), lambda: profiling.describe5(df, "v"), lambda: validation.spatial_gap(df.select("target_height_filled", "target_height_was_predicted", "n_neighbors_100m", "neighbor_height_mean_100m"))):
        before = seen.value
        f().collect()
        assert seen.value - before == 50
