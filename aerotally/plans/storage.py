"""Shared scratch tables: how a long plan is cut without local state.

A table that is read twice, or that an iterative operator hands to its next
round, is written as Parquet below ``spark.checkpoint.dir`` and read back, so
every executor sees it and a lost executor costs nothing but a retry.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


_recording: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders that are written inside, for :func:`discard` once nothing reads them."""
    paths: list[str] = []
    _recording.append(paths)
    try:
        yield paths
    finally:
        _recording.remove(paths)


def discard(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete folders of the shared one; those that are gone are left out."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. Where the session names none, a fresh local one in local mode; a cluster must name one."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.getCheckpointDir():
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir().rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other call has."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    for paths in _recording:
        paths.append(path)
    return path


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it as a scan of those files."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
