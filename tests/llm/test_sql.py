"""Every query of the subpackage that has SQL, against it in DuckDB."""

import os

import duckdb
import pytest

from plinth.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return c


def plain(v):
    return "" if v is None else repr(v) if not isinstance(v, float) else f"{v:.9f}"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, con, sf, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = con.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want
