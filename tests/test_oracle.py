"""Every core query with SQL gives what DuckDB gives on the smallest tables."""

import decimal
import math
import os

import duckdb
import numpy as np
import pytest

from cairn import queries

DATA = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return float(v) if isinstance(v, decimal.Decimal) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, con, name):
    df = queries.QUERIES[name](spark, DATA)
    got = df.collect()
    cur = con.execute(queries.SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    at = [cols.index(c) for c in df.columns]
    want = [tuple(plain(r[i]) for i in at) for r in cur.fetchall()]
    assert sorted((tuple(map(plain, r)) for r in got), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() >= 0
