"""Duplicate documents by normalised content fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from foliospark.functions import text as tx
from foliospark.operators.skew import salted_lookup
from foliospark.staging import stage


def with_fingerprint(df: DataFrame, content: str = "content", out: str = "fingerprint") -> DataFrame:
    return df.withColumn(out, tx.fingerprint(F.coalesce(F.col(content), F.lit(""))))


def duplicate_groups(prints: DataFrame, path: str = "file_path") -> DataFrame:
    """One row per repeated fingerprint: the kept path (smallest) and the group size."""
    return (
        prints.groupBy("fingerprint")
        .agg(F.min(path).alias("kept_path"), F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )


def detect_duplicates(prints: DataFrame, path: str = "file_path") -> DataFrame:
    """Every document but the first of its fingerprint, with ``duplicate_of``.

    The narrow (path, fingerprint) table is written first, so the text is hashed
    once although it is needed twice. Groups are reduced with map-side combine; the
    look-up back to the members is salted, so a text copied into a third of the
    corpus is shared by many tasks.
    """
    members = stage(prints.select(path, "fingerprint"), "fingerprints")
    return (
        salted_lookup(members, duplicate_groups(members, path), "fingerprint", path)
        .where(F.col(path) != F.col("kept_path"))
        .select(path, "fingerprint", F.col("kept_path").alias("duplicate_of"))
    )


def unique_documents(docs: DataFrame, path: str = "file_path", content: str = "content") -> DataFrame:
    """The documents that remain after dropping duplicates."""
    prints = with_fingerprint(docs, content).select(path, "fingerprint")
    return docs.join(detect_duplicates(prints, path).select(path), path, "left_anti")


def with_duplicate_of(prints: DataFrame, within: str, path: str = "file_path") -> DataFrame:
    """``duplicate_of`` decided inside groups of bounded size (audit batches)."""
    same = Window.partitionBy(within, "fingerprint")
    first = F.min(path).over(same)
    return prints.withColumn("duplicate_of", F.when(F.col(path) != first, first))
