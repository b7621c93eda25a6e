"""Every registered query of the library against its SQL, where it has one, over the smallest tables."""

import os

import duckdb
import pytest

from __spark_entry__ import CORE

from .conftest import SF

ALL = {name: f for m in CORE for name, f in m.Q.items()}
SQL = {name: text for m in CORE for name, text in m.SQL.items()}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, duck, name):
    df = ALL[name](spark, SF)
    got = sorted(tuple(repr(r[c]) for c in sorted(df.columns)) for r in df.collect())
    if name not in SQL:
        assert got
        return
    rel = duck.sql(SQL[name])
    want = sorted(tuple(repr(dict(zip(rel.columns, r))[c]) for c in sorted(rel.columns)) for r in rel.fetchall())
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == want
