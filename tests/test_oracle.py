"""Every query with SQL gives the rows that DuckDB gives."""

import datetime
import glob
import math
import os

import duckdb
import pytest

from ledgerlume.plans.catalog import ORACLE_SQL, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def clean(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, db, name):
    got = QUERIES[name](spark, SMALL)
    want = db.sql(ORACLE_SQL[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    a = sorted([clean(r[n]) for n in names] for r in got.collect())
    order = [want.columns.index(n) for n in names]
    b = sorted([clean(r[i]) for i in order] for r in want.fetchall())
    assert len(a) == len(b) and a == b


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0
