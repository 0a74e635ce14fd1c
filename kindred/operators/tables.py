"""Kept tables: results written to the folder that all executors share, which cuts their lineage."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def hadoop_path(spark: SparkSession, path: str):
    """Hadoop's path and file system: a path without a scheme lies where Spark itself would put it."""
    jvm = spark.sparkContext._jvm
    found = jvm.org.apache.hadoop.fs.Path(path)
    system = found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(found), system


def shared_folder(spark: SparkSession) -> str:
    """The address, with its scheme, of a new folder below spark.checkpoint.dir.

    Where that is not set the session's checkpoint folder is taken, or, in one machine's local mode as in tests, one
    below the warehouse. On a cluster without either there is no folder that all executors are known to share.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and (given := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        base = given.get()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir", "spark-warehouse").rstrip("/") + "/checkpoints"
    return f"{hadoop_path(spark, base)[0].toString().rstrip('/')}/{uuid.uuid4().hex}"


def remove_folder(spark: SparkSession, folder: str) -> None:
    path, system = hadoop_path(spark, folder)
    system.delete(path, True)


def _write(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep(df: DataFrame, name: str = "table") -> DataFrame:
    """df, written and read again: nothing before it is ever computed twice, whichever executors are lost."""
    return _write(df, f"{shared_folder(df.sparkSession)}/{name}")


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A keep() whose tables are removed at the end: what comes of them must be kept elsewhere by then."""
    folder, made = shared_folder(spark), 0

    def held(df: DataFrame, name: str = "table") -> DataFrame:
        nonlocal made
        made += 1
        return _write(df, f"{folder}/{made}-{name}")

    try:
        yield held
    finally:
        remove_folder(spark, folder)
