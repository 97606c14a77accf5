"""Every registered query of the core library against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tablewarden.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = registry.oracle_sql()


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    result = duck.execute(SQL[name])
    names = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    want = sorted((tuple(plain(row[names.index(c)]) for c in order) for row in result.fetchall()), key=key)
    got = sorted((tuple(plain(row[c]) for c in order) for row in df.collect()), key=key)
    assert got == want


def test_every_query_has_sql():
    assert set(registry.queries()) == set(SQL)
