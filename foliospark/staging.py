"""Cut lineage by writing a table into the cluster's shared checkpoint folder.

A staged table survives the loss of any executor, is columnar (so later reads
prune columns) and gives the optimizer real statistics.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_local_root: tempfile.TemporaryDirectory | None = None
_written: list[str] = []


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own (removed
    when Python exits): on a cluster such a folder would not be visible to the
    other machines.
    """
    global _local_root
    configured = spark.conf.get(CHECKPOINT_KEY, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that every executor can reach")
    if _local_root is None:
        _local_root = tempfile.TemporaryDirectory(prefix="foliospark-", ignore_cleanup_errors=True)
    return _local_root.name


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a DataFrame that scans the written table."""
    spark = df.sparkSession
    path = f"{checkpoint_root(spark)}/foliospark/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_sized(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """``stage`` with the bytes written."""
    staged = stage(df, label)
    return staged, folder_bytes(df.sparkSession, _written[-1])


def folder_bytes(spark: SparkSession, path: str) -> int:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside delete their shuffle files when they end; their results are in written tables."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def release(spark: SparkSession) -> int:
    """Delete every table staged so far by this process; call it once their results are stored."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    count = len(_written)
    while _written:
        path = hadoop.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)
    return count
