"""Jobs composed of the operators: index, audit, search and the scheduled run."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from foliospark.functions import text as tx
from foliospark.operators import audit, history, index, remediation, store
from foliospark.sources.documents import flattened_json, load_folder
from foliospark.sources.extract import Ocr
from foliospark.staging import stage

# The read-only table layout: one folder per table below a root.
DOCUMENTS, HISTORY, RUNS = "documents", "audit_history", "schedule_runs"
JOBS = ("audit", "report", "ocr-pending", "evaluate")


@dataclass(frozen=True)
class IndexResult:
    decisions: DataFrame
    actions: DataFrame
    errors: DataFrame
    removed: DataFrame


def with_history(decisions: DataFrame, now: Column, source_command: str) -> DataFrame:
    """Decisions as audit-history rows; the id orders events written at the same second."""
    return decisions.select(
        F.monotonically_increasing_id().alias("id"),
        "file_path",
        now.alias("audit_timestamp"),
        "flags",
        F.col("action").alias("remediation_action"),
        "should_index",
        F.lit(source_command).alias("source_command"),
        "duplicate_of",
    )


def decide(documents: DataFrame, errors: DataFrame, policy=remediation.ISOLATE_FLAGS, batch_size: int = audit.BATCH_SIZE) -> DataFrame:
    """Audit decisions for loaded documents plus OCR decisions for load errors.

    JSON documents are judged by the chunks of their flattened form; other texts
    never leave the JVM for that.
    """
    flat = flattened_json(F.when(F.col("file_extension") == ".json", F.col("content")))
    prepared = documents.withColumn("chunk_text", F.coalesce(flat, F.col("content")))
    judged = remediation.plan(audit.audit_documents(prepared, batch_size), policy)
    return stage(judged.unionByName(remediation.error_decisions(errors)), "decisions")


def documents_table(spark: SparkSession, root: str, schema: StructType) -> store.KeyedTable:
    return store.KeyedTable(spark, f"{root}/{DOCUMENTS}", "file_path", schema)


def index_documents(
    spark: SparkSession,
    documents: DataFrame,
    errors: DataFrame,
    root: str,
    now: Column,
    source_command: str = "index",
    sanitize: bool = False,
    force: bool = False,
    policy=remediation.ISOLATE_FLAGS,
    gone: DataFrame | None = None,
) -> IndexResult:
    """Audit, record, and upsert documents whose stored content changed.

    Hash comparison comes first, so unchanged documents are not written again. Only the
    paths in ``gone`` (file_path) are removed from the index: ``documents`` may be a few
    changed files of many.
    """
    docs = documents.withColumn("content", tx.sanitize("content")) if sanitize else documents
    decisions = decide(docs, errors, policy)
    with_history(decisions, now, source_command).write.mode("append").parquet(f"{root}/{HISTORY}")

    allowed = remediation.indexable(docs, decisions)
    rows = stage(index.stored_documents(allowed), "to-index")
    target = documents_table(spark, root, rows.schema)
    stored = target.read()
    actions = stage(store.upsert_actions(stored, rows, force=force), "upsert-actions")
    none = stored.select("file_path").limit(0)
    removed = stage(stored.select("file_path").join(gone, "file_path", "left_semi") if gone is not None else none, "orphans")
    changed = rows.join(actions.where(F.col("action") != "unchanged").select("file_path"), "file_path", "left_semi")
    target.upsert(changed)
    if not removed.isEmpty():
        target.delete(removed)
    return IndexResult(decisions, actions, errors, removed)


def index_folder(spark: SparkSession, folder: str, root: str, now: Column, ocr: Ocr | None = None, **options) -> IndexResult:
    """Index a whole folder; stored paths that its listing lacks are removed."""
    documents, errors = load_folder(spark, folder, ocr)
    known = documents.select("file_path").unionByName(errors.select("file_path"))
    table = store.KeyedTable(spark, f"{root}/{DOCUMENTS}", "file_path", StructType([StructField("file_path", StringType())]))
    return index_documents(spark, documents, errors, root, now, gone=store.orphans(table.read(), known), **options)


def watch_process(spark: SparkSession, root: str, now: Callable[[], Column], **options) -> Callable[[DataFrame, DataFrame, DataFrame], None]:
    """``process`` for ``streaming.watch``: indexes what changed and removes what was deleted."""

    def process(documents: DataFrame, errors: DataFrame, removed: DataFrame) -> None:
        index_documents(spark, documents, errors, root, now(), source_command="watch", gone=removed, **options)

    return process


def report(spark: SparkSession, root: str) -> DataFrame:
    """Report rows from the persisted documents and audit history."""
    layout = index.stored_documents(spark.createDataFrame([], "file_path string, file_extension string, content string")).schema
    stored = documents_table(spark, root, layout).read()
    documents = index.with_content(stored).select(
        "file_path", "file_extension", F.col("metadata.theme").alias("theme"), F.length("content").alias("content_length")
    )
    return history.report_rows(documents, history.latest_decisions(spark.read.parquet(f"{root}/{HISTORY}")))


def expand_jobs(jobs) -> list[str]:
    return list(JOBS) if not jobs or "all" in jobs else list(jobs)


def run_schedule(spark: SparkSession, steps: dict[str, Callable[[], dict]], jobs=None) -> dict:
    """Run the chosen steps in order; a failing step is recorded and does not stop the others."""
    results: dict[str, dict] = {}
    for name in expand_jobs(jobs):
        if name not in steps:
            results[name] = {"status": "skipped"}
            continue
        try:
            results[name] = {"status": "ok", **steps[name]()}
        except Exception as exc:  # noqa: BLE001 - reported in the run record
            results[name] = {"status": "error", "message": str(exc)}
    rows = spark.createDataFrame([(n, r["status"]) for n, r in results.items()], "step string, status string")
    return {"status": history.overall_status(rows).first()["status"], "jobs": list(results), "steps": results}


def exit_code(run: dict, critical: int = 2) -> int:
    """0 for ok and partial, 1 for error, ``critical`` when an aggregate metric regressed."""
    if (run["steps"].get("evaluate") or {}).get("critical"):
        return critical
    return 1 if run["status"] == "error" else 0
