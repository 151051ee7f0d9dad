"""Folders for intermediate tables that all tasks share.

A table that a returned DataFrame still reads goes when the driver ends (``until_exit``). Within
``scope``, all tables made since go at its end: for steps whose result is written elsewhere.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Only a local master may do without that setting (tests); a cluster must name a folder
    that all its machines see.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{tempfile.gettempdir()}/quillmill-scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    files, hadoop_path = file_system(spark, path)
    files.delete(hadoop_path, True)


def until_exit(spark: SparkSession, path: str) -> None:
    """Remove a scratch table, which is there by now, when the driver ends."""
    files, hadoop_path = file_system(spark, path)
    files.deleteOnExit(hadoop_path)


def written(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` as a scratch table, read back: what tasks made of it stays the same however often it is read. ``compression``: else the session's."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    until_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch tables that were made inside."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            discard(spark, path)
