"""Every query against its SQL in DuckDB, over the smallest tables."""

import os

import duckdb
import pytest
from conftest import SF

from quillmesh.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    return c


def same(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(same(r[c]) for c in cols) for r in df.collect()), key=repr)
    assert got
    if name in ORACLES:
        r = duck.execute(ORACLES[name])
        names = [x[0] for x in r.description]
        assert sorted(names) == cols
        assert got == sorted((tuple(same(dict(zip(names, x))[c]) for c in cols) for x in r.fetchall()), key=repr)


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
