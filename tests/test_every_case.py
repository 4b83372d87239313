"""Searches of all cases: each case that has an id and a question is in the results, not only those of some numbers."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lectern.functions import hashing
from lectern.functions import text as tx
from lectern.operators import indexing, retrieval
from lectern.sources import readers, writers

FOLDER = "/root/testdata/sf0.001"
CASES = f"SELECT count(DISTINCT question_id) FROM read_parquet('{FOLDER}/eval_cases.parquet') WHERE question IS NOT NULL"
ANSWERABLE = f"SELECT count(*) FROM (SELECT question_id FROM read_parquet('{FOLDER}/eval_cases.parquet') WHERE question IS NOT NULL GROUP BY 1 HAVING bool_and(coalesce(answerable, true)))"


def distinct(rows):
    return len({r["query_id"] for r in rows})


#: What a query's rows say how many cases they are of, and the number there are.
SAID = {
    "b12_a15_json_summary": (lambda rows: sum(r["n"] for r in rows), CASES),
    "c23_citations": (distinct, CASES),
    "c24_source_cards": (distinct, CASES),
    "i34_trace_ids": (lambda rows: min(rows[0]["answers"], rows[0]["traces"]), CASES),
    "j12_i23_f04_blend": (distinct, CASES),
    "j14_j13_hybrid_modes": (lambda rows: min(distinct([r for r in rows if r["mode"] == m]) for m in ("bm25", "dense", "hybrid", "hybrid_rerank")), CASES),
    "j19_i30_e14_e15_d14_gate": (distinct, CASES),
    "k04_k06_e09_d09_f05_f06_retrieval_metrics": (lambda rows: min(r["answerable"] for r in rows), ANSWERABLE),
    "k07_e11_g10_weight_ablation": (lambda rows: min(r["answerable"] for r in rows), ANSWERABLE),
    "k09_generation_modes": (lambda rows: min(r["cases"] for r in rows), CASES),
}


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", SAID)
def test_every_case_is_asked(spark, name):
    said, there = SAID[name]
    n = duckdb.connect().execute(there).fetchone()[0]
    assert n > 1 and said(entry.queries()[name](spark, FOLDER).collect()) == n


def test_json_summary_of_several_rows(spark, tmp_path):
    rows = [("supported", 3), ("insufficient_evidence", 597), (None, 1)]
    writers.json_summary(spark.createDataFrame(rows, "status string, n long"), str(tmp_path / "summary"))
    got = readers.json_summary(spark, str(tmp_path / "summary")).select("status", "n").collect()
    assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)


def test_lists_of_many_tiles_in_single_precision(spark):
    """Once lists are full, scores are made roughly at first: the lists are those of a search of postings and of all vectors."""
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(60)]
    chunks = spark.createDataFrame([(f"c{i:04d}", " ".join(rng.choice(words, 12))) for i in rng.permutation(6000)], "chunk_id string, embedding_text string").coalesce(1)
    queries = spark.createDataFrame([(f"q{i}", " ".join(rng.choice(words, 5))) for i in range(40)] + [("q", "unheard")], "query_id string, question string")
    tokens = indexing.tokens_of(chunks)
    lists = retrieval.both_searches(queries, indexing.built(tokens), top_k=5)
    index = indexing.postings(tokens)
    totals = indexing.corpus(tokens)
    norm = F.col("tf") + indexing.K1 * (1 - indexing.B + indexing.B * F.col("dl") / F.col("avg_dl"))
    met = index.join(indexing.term_stats(index, totals), "term").join(retrieval.query_terms(queries), "term").crossJoin(totals.drop("df"))
    scored = met.groupBy("query_id", "chunk_id").agg(F.round(F.sum(F.col("qtf") * F.col("idf") * F.col("tf") * (indexing.K1 + 1) / norm), 6).alias("score"))
    want = retrieval.ranked(scored, F.desc("score"), F.asc("chunk_id"), top=5)
    plain = lambda df: sorted(map(tuple, df.select("query_id", "rank", "chunk_id").collect()))
    assert [r for r in plain(lists["bm25"]) if r[0] != "q"] == plain(want)
    embed = hashing.embedder(by="md5", normed=False)
    vectors = tokens.select("chunk_id", embed(F.col("tokens")).alias("embedding"))
    asked = queries.select("query_id", embed(tx.sparse_tokens(F.col("question"))).alias("embedding"))
    assert plain(lists["dense"]) == plain(retrieval.dense_search(asked, vectors, top_k=5))
