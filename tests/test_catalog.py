"""Every registered query of the engine against its SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from siltstone.plans.catalog import QUERIES, flagship
from siltstone.plans.sql import SQL

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{SF_DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def rows(names: list[str], found: list) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda x: None if x is None or x != x else repr(x) if isinstance(x, float) else str(x)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF_DIR)
    want = duck.execute(SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, got.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_flagship(spark):
    assert 0 < flagship(spark, SF_DIR).count() <= 10
