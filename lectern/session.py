"""Reading the tables of a data folder, and cutting lineage where a result is used more than once."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_KEPT: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.  Where that is unset, a temporary one if Spark runs on this machine only, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("a cluster must name the folder that its executors share in spark.checkpoint.dir")
        folder = _OWN.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="lectern-")
        _OWN[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new folder name in a folder of the application in the shared folder, which is deleted when the application ends.

    Only what exists can be marked for deletion, so the application's folder is made first.
    """
    shared = shared_folder(spark)
    key = f"{spark.sparkContext.applicationId} {shared}"
    if key not in _OWN:
        _OWN[key] = f"{shared}/lectern-{uuid.uuid4().hex}"
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_OWN[key])
        system = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        system.mkdirs(hadoop)
        system.deleteOnExit(hadoop)
    return f"{_OWN[key]}/{uuid.uuid4().hex}"


def folders(spark: SparkSession, pattern: str) -> list[str]:
    """The paths that match a pattern."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return [str(f.getPath().toString()) for f in found or ()]


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def kept(spark: SparkSession, name: str, source: str, make: Callable[[str], None]) -> str:
    """The folder of what make(folder) wrote, once in an application as long as the source isn't written anew."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    status = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path)
    key = f"{spark.sparkContext.applicationId} {shared_folder(spark)} {name} {source} {status.getModificationTime()} {status.getLen()}"
    if key not in _KEPT or not folders(spark, f"{_KEPT[key]}/*"):  # somebody may have cleared the folder
        folder = scratch(spark)
        make(folder)
        _KEPT[key] = folder
    return _KEPT[key]


def settled(df: DataFrame) -> DataFrame:
    """The frame computed once, as a compressed table in the shared folder.

    Later reads prune its columns, and none of it hangs on an executor that may be lost.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most so many rows in what runs within, for rows that are long (vectors, lists of tokens)."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    if not 0 < int(before) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose rows are dear to work on (long texts), dealt out where it comes in fewer partitions than there are cores.

    A small file is one row group and would keep one core busy while the others wait; a table of many splits stays as it is.
    """
    df, cores = table(spark, folder, name), spark.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores)
