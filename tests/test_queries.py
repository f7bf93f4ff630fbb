"""Every query with SQL gives DuckDB's rows on the smallest tables."""

from __future__ import annotations

import decimal
import os

import pytest

from spindrift.plans import registry

DIR = "/root/testdata/sf0.001"


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 4)
    return v.isoformat()[:23] if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(DIR):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{DIR}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_matches_duckdb(spark, duck, name):
    df = registry.QUERIES[name](spark, DIR)
    cur = duck.execute(registry.ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted(repr([plain(dict(zip(columns, r, strict=True))[c]) for c in order]) for r in cur.fetchall())
    got = sorted(repr([plain(r[c]) for c in order]) for r in df.collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_runs_without_sql(spark, name):
    assert registry.QUERIES[name](spark, DIR).count() > 0
