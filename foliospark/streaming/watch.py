"""Watch a folder: new files through Structured Streaming, changes and deletions by snapshot."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from foliospark.operators import store
from foliospark.sources.documents import list_folder, load_files
from foliospark.staging import stage

BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
SNAPSHOT = "watch_path string, file_path string, size bigint, mtime bigint, cycle bigint"

#: Gets the documents, the load errors (file_path, error) and the removed paths (file_path).
Process = Callable[[DataFrame, DataFrame, DataFrame], None]


def stream_new_files(
    spark: SparkSession, folder: str, checkpoint: str, process: Process, interval: str | None = None, ocr=None
) -> StreamingQuery:
    """Feed (documents, errors, no removed paths) of newly arrived files to ``process``.

    Without ``interval`` everything available is processed once and the query ends.
    A file stream never reports modified or deleted files; use ``watch_cycle`` for those.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_SCHEMA)
        .option("recursiveFileLookup", "true")
        .load(folder)
    )

    def handle(batch: DataFrame, _epoch: int) -> None:
        loaded = stage(load_files(batch, ocr), "watched")
        _hand_over(loaded, loaded.select("file_path").limit(0), process)

    writer = files.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()


def read_snapshot(spark: SparkSession, path: str, watch_path: str) -> DataFrame:
    """Latest stored listing of a watched folder, with one row of null ``file_path`` per cycle.

    That row keeps the cycle known when the folder was empty. No rows before the first cycle.
    """
    try:
        rows = spark.read.schema(SNAPSHOT).parquet(path).where(F.col("watch_path") == watch_path)
    except Exception as exc:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], SNAPSHOT)
    newest = rows.agg(F.max("cycle")).scalar()
    return rows.where(F.col("cycle") == newest)


def _hand_over(loaded: DataFrame, removed: DataFrame, process: Process) -> None:
    process(
        loaded.where(F.col("error").isNull()).drop("error"),
        loaded.where(F.col("error").isNotNull()).select("file_path", "error"),
        removed,
    )


def watch_cycle(
    spark: SparkSession, folder: str, snapshots: str, process: Process, ocr=None, ocr_policy: str = "manual"
) -> DataFrame:
    """One polling cycle: diff the listing with the stored snapshot, process added, modified and
    removed files, store the new snapshot. Returns (file_path, change).

    Only changed files are opened. With an ``ocr`` function, files that failed are loaded
    again as ``ocr_policy`` says (see ``retry_with_ocr``).
    """
    previous = read_snapshot(spark, snapshots, folder)
    current = stage(list_folder(spark, folder), "listing")
    changes = stage(store.snapshot_changes(previous.where(F.col("file_path").isNotNull()), current), "changes")
    removed = changes.where(F.col("change") == "removed").select("file_path")
    # Names only; Spark's own listing of the folder is held by the driver as well.
    wanted = [r.file_path for r in changes.where(F.col("change") != "removed").select("file_path").toLocalIterator()]
    if wanted:
        loaded = stage(load_files(_files(spark, wanted)), "watched")
        failed = loaded.where(F.col("error").isNotNull())
        if ocr is not None and ocr_policy != "manual":
            chosen = failed if ocr_policy == "full-auto" else failed.where(F.col("error").contains("OCR"))
            again = [r.file_path for r in chosen.select("file_path").toLocalIterator()]
            if again:
                retried = stage(load_files(_files(spark, again), ocr), "watched-ocr")
                loaded = loaded.join(retried.select("file_path"), "file_path", "left_anti").unionByName(retried)
        _hand_over(loaded, removed, process)
    elif not removed.isEmpty():
        _hand_over(load_files(_files(spark, [folder]).limit(0)), removed, process)
    cycle = (previous.agg(F.max("cycle")).first()[0] or 0) + 1
    rows = current.select(F.lit(folder).alias("watch_path"), "file_path", "size", "mtime", F.lit(cycle).cast("long").alias("cycle"))
    marker = spark.createDataFrame([(folder, None, None, None, cycle)], SNAPSHOT)
    rows.unionByName(marker).write.mode("append").parquet(snapshots)
    return changes


def _files(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)


def retry_with_ocr(errors: DataFrame, decisions: DataFrame, policy: str) -> DataFrame:
    """Paths to load again with OCR: none (manual), the OCR candidates, or every failed file."""
    if policy == "manual":
        return errors.select("file_path").limit(0)
    if policy == "ocr-required":
        ocr = decisions.where(F.array_contains("flags", "ocr_required")).select("file_path")
        return errors.select("file_path").join(ocr, "file_path", "left_semi")
    return errors.select("file_path")
