"""Every registered query with SQL of its own gives the rows that DuckDB gives for that SQL."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from millrace.operators.queries import ORACLE, QUERIES
from millrace.streaming.queries import ORACLE as STREAM_ORACLE
from millrace.streaming.queries import QUERIES as STREAM_QUERIES

ALL, SQL = {**QUERIES, **STREAM_QUERIES}, {**ORACLE, **STREAM_ORACLE}


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in os.listdir(small):
        path = f"{small}/{f}"
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if type(v).__name__ == "Decimal":
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, int) and not isinstance(v, bool):
        return f"{float(v):.9g}" if abs(v) < 1e8 else str(v)
    return str(v)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, small, duck, name):
    df = ALL[name](spark, small)
    rows, columns = df.collect(), df.columns
    if name not in SQL:
        assert rows
        return
    found = duck.execute(SQL[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(columns)
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == want


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
