"""Every registered query against its DuckDB text on the smallest tables."""

import math
import os

import duckdb
import pytest

from tramline import catalog


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in sorted(os.listdir(sf)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, list) else v


QUERIES = catalog.queries()
ORACLES = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    if name not in ORACLES:
        assert rows
        return
    got = duck.execute(ORACLES[name])
    names = [c[0] for c in got.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    expected = sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)
    assert rows == expected


def test_the_flagship_is_registered():
    assert catalog.FLAGSHIP in QUERIES
