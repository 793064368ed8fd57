"""Every query against its SQL in DuckDB over the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from lodestar.plans.catalogue import ORACLE_SQL, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, DIR)
    got = df.collect()
    want = db.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    a = sorted(repr(tuple(plain(r[c]) for c in order)) for r in got)
    b = sorted(repr(tuple(plain(r[names.index(c)]) for c in order)) for r in want.fetchall())
    assert a == b
