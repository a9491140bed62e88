"""Intermediate tables, written to a folder that all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Only a local session without one (tests) gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        folder = context.getCheckpointDir()
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
            folder = context.getCheckpointDir()
    return folder


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """What is written inside has its shuffle files removed as soon as it is written; else they stay until the driver collects its garbage."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


_scopes: list[list[str]] = []


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def tables_removed(spark: SparkSession):
    """Tables that saved() writes inside are removed at the end, but for what is taken from the list of their paths, which is in the order of writing."""
    written: list[str] = []
    _scopes.append(written)
    try:
        yield written
    finally:
        _scopes.remove(written)
        for path in written:
            remove(spark, path)


def saved(df: DataFrame, compression: str = "snappy", by: str | None = None) -> DataFrame:
    """The same rows, read from a table written to the shared folder: a lost executor costs no recomputation, and no shuffle file of df stays.

    by: a column of few values, each of which gets a folder, so that readers of some values skip the others.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    out = df.write.option("compression", compression)
    with shuffles_removed(spark):
        (out.partitionBy(by) if by else out).parquet(path)
    for written in _scopes[-1:]:
        written.append(path)
    return spark.read.schema(df.schema).parquet(path)
