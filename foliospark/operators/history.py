"""Audit history, schedule runs and the corpus report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def filter_history(
    history: DataFrame, file_path: str | None = None, source_command: str | None = None, action: str | None = None
) -> DataFrame:
    """Conjunction of the filters that were given."""
    given = {"file_path": file_path, "source_command": source_command, "remediation_action": action}
    tests = [F.col(c) == v for c, v in given.items() if v is not None]
    return history.where(reduce(lambda a, b: a & b, tests)) if tests else history


def page(rows: DataFrame, limit: int, offset: int = 0, *order: Column) -> DataFrame:
    """A page in newest-first order (top-k, not a full sort)."""
    keys = order or (F.desc("audit_timestamp"), F.desc("id"))
    return rows.orderBy(*keys).offset(max(offset, 0)).limit(max(limit, 1))


def action_summary(history: DataFrame) -> DataFrame:
    return history.groupBy("remediation_action").agg(F.count(F.lit(1)).alias("events"))


def latest_decisions(history: DataFrame) -> DataFrame:
    """Newest event per file by (audit_timestamp, id).

    An aggregate instead of a window: each task reduces its own rows first, so a
    file with a third of all events is no heavier than any other.
    """
    rest = [c for c in history.columns if c != "file_path"]
    newest = F.max_by(F.struct(*rest), F.struct("audit_timestamp", "id"))
    return history.groupBy("file_path").agg(newest.alias("e")).select("file_path", "e.*")


def recent_status_counts(runs: DataFrame, limit: int = 20, status: str | None = None) -> DataFrame:
    """Status counts over only the ``limit`` most recent runs, with the newest timestamp."""
    chosen = runs if status is None else runs.where(F.col("status") == status)
    recent = chosen.orderBy(F.desc("run_timestamp"), F.desc("id")).limit(limit)
    return recent.groupBy("status").agg(
        F.count(F.lit(1)).alias("runs"), F.max("run_timestamp").alias("latest")
    )


def report_rows(documents: DataFrame, latest: DataFrame) -> DataFrame:
    """One row per known path: indexed document, latest decision, or both."""
    d = documents.withColumn("indexed", F.lit(True))
    joined = d.join(latest, "file_path", "full_outer")
    text = lambda c: F.coalesce(c, F.lit(""))
    return joined.select(
        "file_path",
        F.coalesce("indexed", F.lit(False)).alias("indexed"),
        text("file_extension").alias("file_extension"),
        text("theme").alias("theme"),
        F.coalesce("content_length", F.lit(0)).cast("long").alias("content_length"),
        "audit_timestamp",
        text("remediation_action").alias("latest_action"),
        F.col("should_index").alias("latest_should_index"),
        text("source_command").alias("latest_source_command"),
        F.coalesce("flags", F.array().cast("array<string>")).alias("latest_flags"),
    )


def report_summary(rows: DataFrame) -> DataFrame:
    """Report totals in one pass."""
    is_action = lambda a: F.count_if(F.col("latest_action") == a)
    return rows.agg(
        F.count_if("indexed").alias("indexed_documents"),
        F.count_if(F.col("latest_action") != "").alias("documents_with_history"),
        F.count(F.lit(1)).alias("rows_total"),
        is_action("ocr_required").alias("pending_ocr_documents"),
        is_action("index_with_review").alias("review_documents"),
        is_action("isolate").alias("isolated_documents"),
        is_action("ignore_duplicate").alias("duplicate_documents"),
        F.count_if(F.col("indexed") & (F.col("latest_action") == "")).alias("indexed_without_history"),
    )


def report_counts(rows: DataFrame) -> DataFrame:
    """(dimension, value, files) for extension, theme, action, source and flag in one pass."""
    pair = lambda name, c: F.struct(F.lit(name).alias("dimension"), c.alias("value"))
    singles = F.array(
        pair("extension", F.col("file_extension")),
        pair("theme", F.col("theme")),
        pair("action", F.col("latest_action")),
        pair("source", F.col("latest_source_command")),
    )
    flags = F.transform("latest_flags", lambda f: F.struct(F.lit("flag").alias("dimension"), f.alias("value")))
    return (
        rows.select(F.inline(F.concat(singles, flags)))
        .where(F.col("value") != "")
        .groupBy("dimension", "value")
        .agg(F.count(F.lit(1)).alias("files"))
    )


def overall_status(steps: DataFrame) -> DataFrame:
    """error beats partial (anything but ok or skipped) beats ok."""
    return steps.agg(
        F.when(F.bool_or(F.col("status") == "error"), "error")
        .when(F.bool_or(~F.col("status").isin("ok", "skipped")), "partial")
        .otherwise("ok")
        .alias("status")
    )
