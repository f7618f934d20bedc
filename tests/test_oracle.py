"""Each query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import decimal
import os

import duckdb
import pytest

from claimlens.plans import catalogue, reports  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def norm(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(norm, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_same_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    rel = duck.sql(catalogue.SQL[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert mine == sorted((tuple(norm(r[i]) for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["cache_ttl", "gov_evidence", "report_pages", "claim_flow"])
def test_there_are_rows(spark, name):
    """Rows to compare: an empty result equals any other."""
    assert catalogue.QUERIES[name](spark, DATA).count() > 0
