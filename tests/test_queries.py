"""Every registered query with SQL gives what DuckDB gives on the same small tables."""

import math
import os

import duckdb
import pytest

from millrace import catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    rows = df.collect()
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    other = duck.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(other.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in rows)
    theirs = sorted(tuple(plain(dict(zip(other.columns, r, strict=True))[c]) for c in columns) for r in other.fetchall())
    assert mine == theirs
