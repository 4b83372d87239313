"""What searches shuffle: no pairs of queries and chunks, no texts of hits that are ranked."""

import os
import pathlib
import random
import string
import subprocess
import sys
import time
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lectern.functions import hashing
from lectern.functions import text as tx
from lectern.operators import evaluation, indexing, ingest, retrieval
from lectern.plans import search
from lectern.session import shared_folder, table
from lectern.sources import writers

FOLDER = "/root/testdata/sf0.001"
SEARCHES = (
    "j12_i23_f04_blend",
    "j15_i33_answers",
    "k07_e11_g10_weight_ablation",
    "i38_parsed_context",
    "j09_d07_e03_e04_g03_rrf",
    "k04_k06_e09_d09_f05_f06_retrieval_metrics",
    "b12_a15_json_summary",
    "c24_source_cards",
    "i34_trace_ids",
    "j19_i30_e14_e15_d14_gate",
    "k09_generation_modes",
)


def shuffled(spark, run):
    """Bytes that run() writes to shuffles."""

    def total():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()

    before = total()
    run()
    return total() - before


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
@pytest.mark.parametrize("name", SEARCHES)
def test_a_search_moves_little(spark, tmp_path, name):
    """With postings and pairs shuffled it was over five times the tables; its index is made anew here."""
    folder = tmp_path / "in"
    folder.symlink_to(FOLDER)
    tables = sum(os.path.getsize(f"{FOLDER}/{t}.parquet") for t in ("chunks", "eval_cases"))
    assert shuffled(spark, lambda: entry.queries()[name](spark, str(folder)).collect()) < 2.5 * tables


@pytest.fixture(scope="module")
def hits(spark):
    """60 hits of two queries with texts of 20,000 letters: 1.2 MB."""
    rng = random.Random(3)
    rows = [(f"q{i % 2}", f"c{i:02d}", f"d{i:02d}", "".join(rng.choices(string.ascii_letters, k=20_000)), "t", "u", "library", 2020, 1, "aa bb", 1.0 / (i + 1), i // 2 + 1, "bm25") for i in range(60)]
    return spark.createDataFrame(
        rows, "query_id string, chunk_id string, doc_id string, text string, title string, url string, category string, effective_year int, page_start int, question string, score double, rank int, source string"
    )


MOST = 300_000


def test_weights_rank_hits_without_their_texts(spark, hits):
    cases = spark.createDataFrame([("q0", ["d00"], []), ("q1", [], ["c59"])], "query_id string, relevant_doc_ids array<string>, relevant_chunk_ids array<string>").selectExpr("*", "true as answerable")
    got = []
    assert shuffled(spark, lambda: got.extend(evaluation.weight_ablation(hits.selectExpr("*", "1 - rank / 100.0 as model"), cases, "model").collect())) < MOST
    assert {(r["weight"], r["answerable"], r["doc_hit_at_5"], r["chunk_hit_at_10"]) for r in got} == {(w, 2, 0.5, 0.0) for w in evaluation.WEIGHTS}


def test_a_blend_ranks_hits_without_their_texts(spark, hits, monkeypatch):
    monkeypatch.setattr(search, "_fused_payload", lambda *a: hits)
    got = []
    assert shuffled(spark, lambda: got.extend(search.j12_i23_f04_blend(spark, "").collect())) < MOST
    assert len(got) == 60 and all(r["rank"] == r["pre_rank"] for r in got)


def test_a_context_gets_its_texts_when_it_is_cut(spark, hits, monkeypatch):
    monkeypatch.setattr(search, "_fused_payload", lambda *a: hits)
    got = []
    assert shuffled(spark, lambda: got.extend(search.context_hits(spark, "").collect())) < MOST
    texts = {r["chunk_id"]: r["text"] for r in hits.collect()}
    assert sorted((r["query_id"], r["rank"], r["chunk_id"], r["doc_id"], r["text"] == texts[r["chunk_id"]], r["source"]) for r in got) == sorted(
        (f"q{q}", k + 1, f"c{2 * k + q:02d}", f"d{2 * k + q:02d}", True, "bm25+rerank") for q in (0, 1) for k in range(5)
    )


def test_reranked_hits_may_leave_their_texts(spark, hits):
    assert shuffled(spark, lambda: retrieval.deduplicated(retrieval.lexical_rerank(hits, whole=False)).collect()) < MOST
    same = [[tuple(r) for r in retrieval.deduplicated(retrieval.lexical_rerank(hits, whole=w)).orderBy("query_id", "rank").collect()] for w in (True, False)]
    assert same[0] == same[1] and len(same[0]) == 60


def written(spark, run):
    """The Parquet files that run() leaves in the shared folder."""

    def files():
        return set(pathlib.Path(shared_folder(spark).removeprefix("file:")).rglob("*.parquet"))

    before = files()
    run()
    return [p for p in files() - before if p.is_file()]


@pytest.fixture
def repeating(tmp_path):
    """A folder of the test tables in which five chunks stand twice."""
    if not os.path.isdir(FOLDER):
        pytest.skip("needs the test tables")
    chunks = pq.read_table(f"{FOLDER}/chunks.parquet")
    pq.write_table(pa.concat_tables([chunks, chunks.slice(3, 5)]), tmp_path / "chunks.parquet")
    (tmp_path / "eval_cases.parquet").symlink_to(f"{FOLDER}/eval_cases.parquet")
    return str(tmp_path)


def test_a_context_needs_no_copy_of_the_chunks(spark, repeating):
    files = written(spark, lambda: search.i38_parsed_context(spark, repeating).collect())
    assert sum(pq.read_metadata(p).num_rows for p in files if "embedding_text" in pq.read_schema(p).names) == 5


def test_many_repeated_chunks_are_found_in_a_copy(spark, repeating, monkeypatch):
    few = search.chunk_table(spark, repeating)
    monkeypatch.setattr(ingest, "REGISTRY_ROWS", 2)
    many = search.chunk_table(spark, repeating)
    assert few.columns == many.columns and few.count() == many.count() == table(spark, FOLDER, "chunks").count()
    assert few.exceptAll(many).count() == 0


def test_scratch_tables_end_with_the_application(tmp_path):
    code = "import sys\nfrom pyspark.sql import SparkSession\nfrom lectern.session import settled\ns = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', sys.argv[1]).getOrCreate()\nassert settled(s.range(9)).count() == 9\ns.stop()"
    subprocess.run([sys.executable, "-c", code, str(tmp_path)], check=True, timeout=120)
    for _ in range(100):  # the JVM may end after its parent
        if not (left := list(tmp_path.rglob("*.parquet"))):
            break
        time.sleep(0.2)
    assert not left


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the test tables")
def test_fusing_two_lists_writes_no_vectors(spark, tmp_path):
    """Of the index, which is made anew here, only tokens and statistics are written."""
    folder = tmp_path / "in"
    folder.symlink_to(FOLDER)
    files = written(spark, lambda: search.j09_d07_e03_e04_g03_rrf(spark, str(folder)).collect())
    columns = {c for p in files for c in pq.read_schema(p).names}
    assert "tokens" in columns and "embedding" not in columns


def test_both_searches_are_those_of_each_list(spark):
    rng = random.Random(5)
    words = ["课", "程", "图", "书", "馆", "考", "试", "cs101", "2024", "a", "b"]
    chunks = spark.createDataFrame([(f"c{i:03d}", None if i == 7 else rng.choices(words, k=rng.randrange(12))) for i in range(200)], "chunk_id string, tokens array<string>").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", " ".join(rng.choices([*words, "zz"], k=i))) for i in range(9)], "query_id string, question string")
    index = indexing.built(chunks)
    got = retrieval.both_searches(queries, index, top_k=10)
    said = tx.sparse_tokens(F.col("question"))
    want = {
        "dense": retrieval.dense_search(*(indexing.hashed_embeddings(t, k, tokens=c, by="md5", normed=False) for t, k, c in ((queries, "query_id", said), (chunks, "chunk_id", F.coalesce("tokens", F.array().cast("array<string>"))))), top_k=10),
        "bm25": retrieval.sparse_search(queries, index, top_k=10),
    }
    for mode in want:
        rows = [sorted(map(tuple, x[mode].select("query_id", "chunk_id", "score", "rank").collect())) for x in (got, want)]
        assert rows[0] == rows[1]
        assert len(rows[0]) == 90


def test_a_hit_is_scored_without_lists_of_its_terms(spark):
    """The score equals that of term counts, and no list of a text's terms goes from Spark to Python."""
    rng = random.Random(7)
    words = ["图书馆", "图图图", "开放", "cs101", "2024", "A", "ab", "3.5", " ", "，", "K", "İ", "\U00020000", "\n"]
    some = lambda n: "".join(rng.choices(words, k=n))
    rows = [(some(30), some(8), some(5), "library") for _ in range(200)] + [(None, None, None, None), ("", "图图", "图", "library"), ("图图图", "图图图图", None, None)]
    df = spark.createDataFrame(rows, "text string, question string, title string, category string")
    terms = [tx.rerank_tokens(F.coalesce(c, F.lit(""))) for c in ("text", "question")]
    low = F.lower(F.coalesce("title", F.lit("")))
    titled = F.size(F.filter(F.array_distinct(terms[1]), lambda t: (F.length(t) > 1) & F.contains(low, t)))
    got = df.select(retrieval._matched(F.lower(F.coalesce("text", F.lit(""))), F.lower(F.coalesce("question", F.lit(""))), low).alias("m"), *terms, titled).collect()
    for (overlap, title), said, asked, want in got:
        have, wanted = Counter(said), Counter(t for t in asked if len(t) >= 2)
        assert (overlap, title) == (2.0 * sum(min(n, have[t]) for t, n in wanted.items()), want)
    plan = df.select(retrieval.lexical())._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and plan.count("ArrowEvalPython") == 1


def test_tokens_of_a_batch_equal_those_of_each_text(spark):
    rng = random.Random(11)
    words = ["课", "程一鿿", "CS101", "2024", "1999.5", "3.", ".7", "abcdefghijk12345678", "A", "ab", " ", "，", "K", "İ", "é", "\U00020000", "\n", "٣", "ſ", "4567.89.1"]
    rows = [("".join(rng.choices(words, k=rng.randrange(40))),) for _ in range(1500)] + [(None,), ("",), ("\n",), ("課。A",)]
    df = spark.createDataFrame(rows, "t string").repartition(2)
    both = df.select(tx.sparse_tokens(F.coalesce("t", F.lit(""))).alias("want"), hashing.tokenizer()(F.col("t")).alias("got")).collect()
    assert len(both) == len(rows) and all(r["want"] == r["got"] for r in both)


def test_the_index_by_chunk_is_tokenized_in_batches(spark, repeating, monkeypatch):
    seen = []
    monkeypatch.setattr(search.writers, "token_index", lambda df, path: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or df.limit(0).write.parquet(f"{path}/tokens"))
    monkeypatch.setattr(indexing, "open_token_index", lambda spark, path: path)
    search.sparse(spark, repeating)
    assert "regexp_extract_all" not in seen[0] and "ArrowEvalPython" in seen[0]


@pytest.mark.parametrize("name", ["b12_a15_json_summary", "i34_trace_ids", "k09_generation_modes"])
def test_the_cases_are_read_once(spark, repeating, monkeypatch, name):
    read = []
    monkeypatch.setattr(search, "table", lambda spark, d, t: read.append(t) or table(spark, d, t))
    entry.queries()[name](spark, repeating).collect()
    assert read.count("eval_cases") == 1


def test_the_mean_length_is_known_without_tokens(spark, tmp_path):
    tokenized = spark.createDataFrame([("c1", ["a", "b"]), ("c2", []), ("c3", ["a"] * 7)], "chunk_id string, tokens array<string>")
    writers.token_index(tokenized, str(tmp_path))
    said = spark.read.parquet(f"{tmp_path}/tokens")
    totals = indexing.corpus(said)
    assert "tokens" not in totals._jdf.queryExecution().executedPlan().toString().partition("ReadSchema")[2]
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/totals").collect()] == [(3, 3.0)] == [tuple(r) for r in indexing.corpus(said.drop("dl")).collect()]
