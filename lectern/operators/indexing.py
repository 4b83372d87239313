"""The sparse index (postings, lengths, term statistics) and the dense index (vectors with payload)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import hashing
from lectern.functions import text as tx
from lectern.session import folders, settled

K1, B, EPSILON = 1.5, 0.75, 0.25


def tokens_of(chunks: DataFrame, text_col: str = "embedding_text", tokens: Column | None = None) -> DataFrame:
    """(chunk_id, tokens); a null text has no tokens."""
    c = F.coalesce(F.col(text_col), F.lit(""))
    return chunks.select("chunk_id", (tx.sparse_tokens(c) if tokens is None else tokens).alias("tokens"))


def postings(tokenized: DataFrame) -> DataFrame:
    """(term, chunk_id, tf, dl), dl being the chunk's length in tokens.

    A chunk's tokens are all in one partition, so the counts are complete before the shuffle, one row for each term of it.
    """
    each = tokenized.select("chunk_id", F.size("tokens").alias("dl"), F.explode("tokens").alias("term"))
    return each.groupBy("chunk_id", "dl", "term").agg(F.count(F.lit(1)).cast("int").alias("tf")).select("term", "chunk_id", "tf", "dl")


def corpus(tokenized: DataFrame) -> DataFrame:
    """One row: n chunks and their mean length, by their column dl if there is one, so that no tokens are read for it."""
    dl = F.col("dl") if "dl" in tokenized.columns else F.size("tokens")
    return tokenized.agg(F.count(F.lit(1)).alias("n"), F.avg(dl).alias("avg_dl"))


def document_counts(tokenized: DataFrame) -> DataFrame:
    """(term, df), counted without postings: a chunk's distinct terms are added up where they are read."""
    return tokenized.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def term_stats(entries: DataFrame, totals: DataFrame) -> DataFrame:
    """(term, df, idf) of postings."""
    return weighted(entries.groupBy("term").agg(F.count(F.lit(1)).alias("df")), totals)


def weighted(counts: DataFrame, totals: DataFrame) -> DataFrame:
    """(term, df, idf): Okapi idf, negative ones replaced by EPSILON times the mean of all."""
    raw = (
        counts.crossJoin(F.broadcast(totals.select("n")))  # one row
        .select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    )
    mean = raw.agg(F.avg("raw").alias("mean"))
    idf = F.when(F.col("raw") < 0, F.lit(EPSILON) * F.col("mean")).otherwise(F.col("raw"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", idf.alias("idf"))  # one row


def hashed_embeddings(
    chunks: DataFrame, key: str = "chunk_id", text_col: str = "embedding_text", dimension: int = hashing.DIMENSION, tokens: Column | None = None, by: str = "blake2b", normed: bool = True
) -> DataFrame:
    """(key, embedding) by the hashing embedder, over words, numbers, ideographs and character pairs (or the given tokens).

    Vectors that aren't normed hold whole numbers, from which searches compute the same cosines without rounding.
    """
    embed = hashing.embedder(dimension, by, normed)
    said = tx.hash_tokens(F.coalesce(F.col(text_col), F.lit(""))) if tokens is None else tokens
    return chunks.select(F.col(key).alias(key), embed(said).alias("embedding"))


@dataclass(frozen=True)
class SparseIndex:
    """A BM25 index as tables in the shared folder or wherever it was written; ``buckets`` is 0 where entries have none."""

    chunks: DataFrame  # chunk_id
    entries: DataFrame  # term, chunk_id, tf, dl (and bucket)
    totals: DataFrame  # one row: n, avg_dl
    stats: DataFrame  # term, df, idf
    buckets: int = 0


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class TokenIndex:
    """A BM25 index by chunk, without postings: a search scores every chunk where it is read, so that only the best travel."""

    tokenized: DataFrame  # chunk_id, tokens (and dl, their number)
    totals: DataFrame  # one row: n, avg_dl
    stats: DataFrame  # term, df, idf


def built(tokenized: DataFrame) -> TokenIndex:
    """The index of tokenized chunks, for this session."""
    tokenized = settled(tokenized.select("chunk_id", "tokens"))
    totals = settled(corpus(tokenized))
    return TokenIndex(tokenized, totals, settled(weighted(settled(document_counts(tokenized)), totals)))


def open_token_index(spark: SparkSession, path: str) -> TokenIndex | None:
    """An index that was written by ``writers.token_index``; None where there is none."""
    if not folders(spark, f"{path}/tokens"):
        return None
    return TokenIndex(*(spark.read.parquet(f"{path}/{name}") for name in ("tokens", "totals", "term_stats")))


def open_sparse_index(spark: SparkSession, path: str) -> SparseIndex | None:
    """An index that was written by ``writers.sparse_index``; None where there is none."""
    if not folders(spark, f"{path}/postings"):
        return None
    lengths, stats = (spark.read.parquet(f"{path}/{name}") for name in ("doc_lengths", "term_stats"))
    meta = spark.read.parquet(f"{path}/totals")
    buckets = meta.first()["buckets"]  # one row
    return SparseIndex(lengths.select("chunk_id"), spark.read.parquet(f"{path}/postings"), meta.select("n", "avg_dl"), stats, buckets)


def open_vector_index(spark: SparkSession, path: str) -> DataFrame | None:
    """The vectors with their payload that were written by ``writers.vector_index``; None where there are none."""
    return spark.read.parquet(path) if folders(spark, path) else None
