"""Every query against its SQL counterpart on the smallest data."""

import math

import duckdb
import pytest
from conftest import DATA

import __spark_entry__ as entry

QUERIES, SQL = entry.queries(), entry.oracle_sql()
# The text queries have tests of their own.
NAMES = sorted(n for n in SQL if not n.startswith("op") and n != "pipeline")


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return f"{float(v):.9g}"
    return str(v)


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, str(DATA))
    assert sorted(got.columns) == sorted(columns)
    assert normal(got.collect(), got.columns) == normal(want.fetchall(), columns)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
