"""Every named query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from zbior.plans import QUERIES, SQL


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    ours = sorted(repr(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect())
    cur = duck.execute(SQL[name])
    columns = [d[0] for d in cur.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    theirs = sorted(repr(tuple(plain(r[i]) for i in order)) for r in cur.fetchall())
    assert sorted(columns) == sorted(df.columns)
    assert ours == theirs


def test_every_query_without_sql_runs(spark, data):
    for name in set(QUERIES) - set(SQL):
        assert QUERIES[name](spark, data).count() >= 0


def test_entry_point():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
