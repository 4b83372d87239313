"""Fetches as a stream: each content once, within a watermark, and an upserting sink for documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.ingest import upserted
from lectern.session import folders, remove, settled


def first_seen(fetches: DataFrame, delay: str = "7 days") -> DataFrame:
    """Successful fetches of a stream, each content once as long as the watermark remembers it."""
    return fetches.where("status_code < 400 and content_hash is not null").withWatermark("crawl_time", delay).dropDuplicatesWithinWatermark(["content_hash"])


def upsert_into(path: str, key: str, order: str, buckets: int = 64):
    """A foreachBatch function that merges each batch into a table of versions (see ``latest``).

    The table lies in hash buckets of its key.  A batch rewrites only the buckets it has keys of, each as a new folder
    bucket=<b>/version=<epoch>; what was there stays until the next batch for that bucket is written, so that at any time
    every bucket has a whole version, and an epoch that is run again writes the same folders.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        batch = settled(batch.where(F.col(key).isNotNull()).withColumn("bucket", bucket_of(key, buckets)))
        touched = sorted(r["bucket"] for r in batch.select("bucket").distinct().collect())  # at most ``buckets`` numbers
        known = {b: [v for v in found if v < epoch] for b, found in versions(spark, path).items()}
        old = [f"{path}/bucket={b}/version={max(known[b])}" for b in touched if known.get(b)]
        rows = batch.drop("bucket")
        current = spark.read.schema(rows.schema).parquet(*old) if old else rows.limit(0)
        merged = upserted(current, rows, key, order).withColumns({"bucket": bucket_of(key, buckets), "version": F.lit(epoch)})
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(path)
        for b in touched:
            for v in sorted(known.get(b, []))[:-1]:  # the one before stays for readers that are at it
                remove(spark, f"{path}/bucket={b}/version={v}")

    return write


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def versions(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """The versions of each bucket that are there."""
    out: dict[int, list[int]] = {}
    for name in folders(spark, f"{path}/bucket=*/version=*"):
        b, v = (int(part.split("=")[1]) for part in name.split("/")[-2:])
        out.setdefault(b, []).append(v)
    return out


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    """The table as it is: the last version of each bucket; None before the first batch."""
    known = versions(spark, path)
    last = [f"{path}/bucket={b}/version={max(v)}" for b, v in sorted(known.items())]
    return spark.read.parquet(*last) if last else None


def hourly_counts(fetches: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(hour, source_id, n, failed) of a stream of fetches, late rows up to the watermark included."""
    return (
        fetches.withWatermark("crawl_time", delay)
        .groupBy(F.window("crawl_time", "1 hour").alias("hour"), "source_id")
        .agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("status_code") >= 400).cast("int")).alias("failed"))
    )
