"""The numbered queries run on the smallest tables, and equal DuckDB where SQL can state them."""

import glob
import os

import duckdb
import pytest

from lectern.llm import queries as q

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", q.queries())
def test_query(spark, duck, name):
    df = q.queries()[name](spark, FOLDER)
    rows = [tuple(r) for r in df.collect()]
    sql = q.oracle_sql().get(name)
    if sql:
        result = duck.execute(sql)
        columns = [c[0] for c in result.description]
        at = [df.columns.index(c) for c in columns]
        assert sorted(repr([r[i] for i in at]) for r in rows) == sorted(repr(list(r)) for r in result.fetchall())
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)


def test_found_columns(spark):
    want = {
        "p1_found": ["chunk_id", "forced"], "p2_found": ["doc_id", "line_no"], "p3_found": ["doc_id", "line_no"], "p4_found": ["doc_id"],
        "p5_found": ["question_id_a", "question_id_b"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"],
    }
    assert {n: q.queries()[n](spark, FOLDER).columns for n in want} == want
