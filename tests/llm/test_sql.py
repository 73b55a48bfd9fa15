"""Queries that SQL can express against their SQL in DuckDB."""

import os

import duckdb
import pytest
from conftest import SF

from quillmesh import llm

AT = SF.replace("sf0.001", "sf0.01")


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query(spark, name):
    duck = duckdb.connect()
    for t in os.listdir(AT):
        duck.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{AT}/{t}'")
    df = llm.queries()[name](spark, AT)
    cols = sorted(df.columns)
    want = duck.execute(llm.oracle_sql()[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr) == sorted((tuple(x[i] for i in order) for x in want.fetchall()), key=repr)
