"""Every named core query runs, and equals its SQL where it has one."""

import datetime
import math
from collections import Counter

import pytest

from weftline.plans.oracle import oracle_sql
from weftline.plans.queries import queries

TABLES = "documents events repositories files file_sources chunks commits file_commits relations".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, data, duck, name):
    df = queries()[name](spark, data)
    cols = sorted(df.columns)
    rows = Counter(tuple(norm(r[c]) for c in cols) for r in df.select(*cols).collect())
    sql = oracle_sql().get(name)
    if sql is None:
        return
    cur = duck.execute(sql)
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == Counter(tuple(norm(r[i]) for i in at) for r in cur.fetchall())


def test_oracle_names_are_queries():
    assert set(oracle_sql()) <= set(queries())
