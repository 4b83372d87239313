"""Writers: snapshots with a pointer to the latest, overwritten tables, JSON lines, CSV summaries, index tables, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.indexing import bucket_of, corpus, document_counts, weighted


def snapshot(df: DataFrame, folder: str, stamp: str) -> None:
    """An immutable copy under snapshot=<stamp>, and the table `latest` overwritten with the same rows."""
    path = f"{folder}/snapshots/snapshot={stamp}"
    df.write.mode("errorifexists").parquet(path)
    df.sparkSession.read.parquet(path).write.mode("overwrite").parquet(f"{folder}/latest")


def stamp(timestamp) -> F.Column:
    return F.date_format(timestamp, "yyyyMMdd'T'HHmmss'Z'")


def overwrite(df: DataFrame, path: str, kind: str = "parquet") -> None:
    df.write.mode("overwrite").format(kind).save(path)


def raw_bytes(fetches: DataFrame, path: str) -> None:
    """Bodies (source_id, n, content_hash, extension, body) as a table with a folder for each source, each under its file name."""
    name = F.concat(F.lpad(F.col("n").cast("string"), 4, "0"), F.lit("_"), F.substring("content_hash", 1, 16), F.col("extension"))
    name = F.when(F.col("n") < 10_000, name).otherwise(F.concat(F.col("n").cast("string"), F.lit("_"), F.substring("content_hash", 1, 16), F.col("extension")))
    fetches.select("source_id", name.alias("file"), "body").write.mode("overwrite").partitionBy("source_id").parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def by_split(cases: DataFrame, path: str) -> None:
    cases.write.mode("overwrite").partitionBy("split_name").json(path)


def csv_summary(df: DataFrame, path: str) -> None:
    """A summary (few rows) as one CSV file with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def sparse_index(postings: DataFrame, doc_lengths: DataFrame, term_stats: DataFrame, totals: DataFrame, path: str, buckets: int = 64, parts: int = 8) -> None:
    """The tables of a BM25 index; postings lie in hash buckets of their term, each of ``parts`` files, so that a search reads few of them."""
    bucketed = postings.withColumn("bucket", bucket_of(F.col("term"), buckets))
    # a frequent term's entries are spread over several files of its bucket
    bucketed.repartition("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(parts))).sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    doc_lengths.write.mode("overwrite").parquet(f"{path}/doc_lengths")
    totals.withColumn("buckets", F.lit(buckets)).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
    term_stats.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/term_stats")


def token_index(tokenized: DataFrame, path: str) -> None:
    """The tables of a BM25 index by chunk: chunk_id, tokens and their number (and other columns) of the chunks, and their statistics."""
    tokenized.withColumn("dl", F.size("tokens")).write.mode("overwrite").parquet(f"{path}/tokens")
    spark = tokenized.sparkSession
    said = spark.read.parquet(f"{path}/tokens")
    document_counts(said).write.mode("overwrite").parquet(f"{path}/counts")
    corpus(said).coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")
    weighted(spark.read.parquet(f"{path}/counts"), spark.read.parquet(f"{path}/totals")).write.mode("overwrite").parquet(f"{path}/term_stats")


def vector_index(vectors: DataFrame, path: str) -> None:
    """Vectors with their payload, in a folder for each category and sorted by year, so that filters prune files and pages."""
    vectors.sortWithinPartitions("effective_year", "status", "doc_id").write.mode("overwrite").partitionBy("category").parquet(path)


def json_summary(df: DataFrame, path: str) -> None:
    """A summary (few rows) as one JSON file, an array: a reader of whole files takes no more than the first of several records."""
    rows = df.agg(F.to_json(F.collect_list(F.struct(*df.columns)), {"ignoreNullFields": "false"}))
    rows.coalesce(1).write.mode("overwrite").text(path)


def per_query(hits: DataFrame, path: str) -> None:
    """One JSON line for each query: query_id and its hits (with their other columns) in order of rank."""
    fields = [c for c in hits.columns if c not in ("query_id", "rank")]
    lists = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("hits"))
    json_lines(lists, path)


def markdown(df: DataFrame, most_rows: int = 1000) -> str:
    """A summary table as Markdown; whole numbers as they are, others with three decimals.

    For reports that a person reads: a table of more than most_rows rows is refused.
    """

    def shown(v) -> str:
        if v is None:
            return ""
        return f"{v:.3f}" if isinstance(v, float) and v != int(v) else str(int(v)) if isinstance(v, float) else str(v)

    rows = df.limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows are no summary; write them as a table")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(shown(v) for v in r) + " |" for r in rows])
