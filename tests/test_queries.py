"""Every query with SQL, side by side with DuckDB on the smallest tables; the others by their own rules."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tapeloom.plans.catalog import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v)[:10] if hasattr(v, "year") and not hasattr(v, "hour") else str(v)
    return round(float(v), 6) + 0.0


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_against_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    rel = duck.sql(ORACLE_SQL[name])
    names = sorted(got.columns)
    assert names == sorted(rel.columns)
    want = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    rows = lambda x: sorted(str([plain(r[c]) for c in names]) for r in x)
    assert rows([r.asDict() for r in got.collect()]) == rows(want)


def test_entry_has_rows_and_sql_names_are_queries(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
