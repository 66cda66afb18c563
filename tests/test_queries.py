"""Every registered query with SQL gives DuckDB's rows, on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from evidence_engine.plans import bank_queries, file_queries, ledger_queries, stream_queries, text_queries, trend_queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
MODULES = (trend_queries, bank_queries, ledger_queries, text_queries, stream_queries, file_queries)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the tables aren't here")


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == names
    at = [columns.index(c) for c in names]
    want = Counter(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
    assert {tuple(map(str, k)): n for k, n in got.items()} == {tuple(map(str, k)): n for k, n in want.items()}


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and len(QUERIES) > 140
