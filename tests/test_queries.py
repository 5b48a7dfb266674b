"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

from remitweave.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, Decimal)):
        return None if math.isnan(v) else float(f"{float(v):.9g}")
    return float(v) if isinstance(v, int) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, con, name):
    found = catalog.QUERIES[name](spark, DATA)
    want = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(found.columns) == sorted(columns)
    rows = sorted(repr([plain(v) for v in r]) for r in want.fetchall())
    assert sorted(repr([plain(r[c]) for c in columns]) for r in found.collect()) == rows


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    catalog.QUERIES[name](spark, DATA).collect()
