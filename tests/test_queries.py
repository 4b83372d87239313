"""Every registered query that has SQL gives the same rows as DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(repr(list(r[i]) if isinstance(r[i], (list, tuple)) else r[i]) for i in order) for r in rows])


def core(names):
    return [n for n in names if not (n[0] == "p" and n[1].isdigit())]


@pytest.mark.parametrize("name", core(entry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    got = df.collect()
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    want = result.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert plain([tuple(r) for r in got], df.columns) == plain(want, columns)


@pytest.mark.parametrize("name", [n for n in core(entry.queries()) if n not in entry.oracle_sql()])
def test_others_run(spark, name):
    assert entry.queries()[name](spark, FOLDER).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0
