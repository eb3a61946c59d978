"""Every query of the catalogue against its SQL in DuckDB."""

import os

import duckdb
import pytest

from plinth.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def plain(v):
        if v is None or v != v:
            return ""
        return f"{v:.6f}" if isinstance(v, float) else str(v)

    return sorted(columns), sorted(tuple(plain(r[k]) for k in order) for r in data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    found = con.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert got == rows(columns, found.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
