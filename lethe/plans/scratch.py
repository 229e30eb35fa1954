"""Scratch tables in the folder that driver and executors share.

Long plans cut their lineage by writing an intermediate table as Parquet below
``spark.checkpoint.dir`` and reading it back.  The files survive a lost executor.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_KEPT: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; one of our own only where that is unset and Spark runs in one process."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not sc.getCheckpointDir():
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='lethe-shared-')}")
        root = sc.getCheckpointDir()
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder; removed at the end of the application."""
    if not _KEPT:
        atexit.register(drop_all)
    path = f"{shared_root(spark)}/lethe/{label}-{uuid.uuid4().hex}"
    _KEPT.append((spark, path))
    return path


def write(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` to a scratch table; the table read back, and its path for ``drop``."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def table(df: DataFrame, label: str) -> DataFrame:
    """``write`` for a table that stays until the application ends."""
    return write(df, label)[0]


@contextmanager
def scope() -> Iterator[list[str]]:
    """Delete at the end every scratch path made inside but those put into the list; all of them after an error."""
    before, keep = {path for _, path in _KEPT}, []
    failed = True
    try:
        yield keep
        failed = False
    finally:
        for spark, path in [x for x in _KEPT if x[1] not in before and (failed or x[1] not in keep)]:
            drop(spark, path)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no plan still to run reads."""
    _KEPT[:] = [x for x in _KEPT if x[1] != path]
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def drop_all() -> None:
    while _KEPT:
        spark, path = _KEPT.pop()
        try:
            drop(spark, path)
        except Exception:  # the session has ended already
            return
