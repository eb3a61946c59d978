"""Many footprints with equal boxes: pairs are found and measured of lists of them, and come out a row each."""

import duckdb
import pytest

from plinth.operators import matching, spatial_join
from plinth.plans.catalogue import ORACLES, QUERIES
from plinth.plans.footprints import match_inputs

NAMES = ("join_edges", "join_pair_metrics", "join_candidate_pairs")


@pytest.fixture(scope="module")
def crowded(spark, tmp_path_factory):
    """40 places, each with 20 rows of equal boxes in source A."""
    path = str(tmp_path_factory.mktemp("crowded"))
    keys = spark.range(800).selectExpr("id % 40 * 7 + id div 40 * 39000 AS p_partkey", "cast(id % 40 AS int) AS p_size")
    keys.selectExpr("*", "'t' AS p_type", "concat('n', p_partkey) AS p_name").write.parquet(f"{path}/part.parquet")
    return path


def joined(plan) -> int:
    """Rows that left the joins of a plan's last stage."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return joined(plan.executedPlan())
    if plan.nodeName() == "ResultQueryStage":
        return joined(plan.plan())
    own = plan.metrics().get("numOutputRows").get().value() if plan.nodeName().endswith("Join") else 0
    return own + sum(joined(plan.children().apply(k)) for k in range(plan.children().size()))


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(f"{r[k]:.6f}" if isinstance(r[k], float) else str(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
@pytest.mark.parametrize(("listed", "crowd"), [(64, 1 << 26), (4, 64)])
def test_equal_boxes_are_measured_once(spark, crowded, monkeypatch, name, listed, crowd):
    monkeypatch.setattr(matching, "LISTED", listed, raising=False)
    monkeypatch.setattr(spatial_join, "CROWD", crowd, raising=False)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{crowded}/part.parquet/*.parquet'")
    want = con.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    df = QUERIES[name](spark, crowded)
    got = df.collect()
    assert plain(got, df.columns) == plain(want.fetchall(), columns)
    assert len(got) > 5_000
    if listed == 64:
        assert 0 < joined(df._jdf.queryExecution().executedPlan()) < len(got) / 5


def test_lists_hold_each_row_once_and_stay_small(spark, crowded, monkeypatch):
    monkeypatch.setattr(matching, "LISTED", 4)
    a, _ = match_inputs(spark, crowded, *matching.MEASURES)
    lists = [r["uid"] for r in matching.listed(a).collect()]
    assert sorted(u for x in lists for u in x) == sorted(r["uid"] for r in a.collect())
    assert max(map(len, lists)) < 20
