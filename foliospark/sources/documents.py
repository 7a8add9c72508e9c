"""Folders of documents as DataFrames."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType

from foliospark.functions import text as tx
from foliospark.operators.audit import EXTENSION_PRIORITY
from foliospark.operators.remediation import ERROR_PREFIX
from foliospark.sources.extract import LoadError, Ocr, extract, flatten_json
from foliospark.staging import stage

LOADED = "file_path string, file_extension string, content string, metadata_json string, error string"


def list_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Supported files below a folder: file_path, file_extension, size, mtime. File contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return (
        files.select(
            F.col("path").alias("file_path"),
            tx.file_extension("path").alias("file_extension"),
            F.col("length").alias("size"),
            F.unix_micros("modificationTime").alias("mtime"),
        )
        .where(F.col("file_extension").isin(*EXTENSION_PRIORITY))
    )


def scan_order(files: DataFrame) -> DataFrame:
    """Files by kind, size and path; for display only, jobs do not need a global order."""
    from foliospark.operators.audit import extension_priority

    return files.orderBy(extension_priority("file_extension"), "size", F.lower("file_path"))


def load_files(files: DataFrame, ocr: Ocr | None = None) -> DataFrame:
    """Extract every file of (path, content) rows; failures become rows with ``error`` set.

    ``ocr`` (bytes, extension) -> text is an optional hook for images and scanned PDFs.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, ext, data in zip(batch["path"], batch["file_extension"], batch["content"]):
                try:
                    text, meta = extract(bytes(data), ext, ocr)
                    rows.append((path, ext, text, json.dumps(meta, ensure_ascii=False, sort_keys=True), None))
                except Exception as exc:  # noqa: BLE001 - any failure is reported with its file
                    rows.append((path, ext, None, None, f"{ERROR_PREFIX}{path}: {exc}"))
            yield pd.DataFrame(rows, columns=["file_path", "file_extension", "content", "metadata_json", "error"])

    named = files.withColumn("file_extension", tx.file_extension("path"))
    supported = named.where(F.col("file_extension").isin(*EXTENSION_PRIORITY))
    return supported.select("path", "file_extension", "content").mapInPandas(run, LOADED)


def load_folder(spark: SparkSession, folder: str, ocr: Ocr | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of a folder. The extraction runs once: both read the written result."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    loaded = stage(load_files(files, ocr), "loaded")
    documents = loaded.where(F.col("error").isNull()).drop("error")
    return documents, loaded.where(F.col("error").isNotNull()).select("file_path", "error")


def load_folder_strict(spark: SparkSession, folder: str, ocr: Ocr | None = None) -> DataFrame:
    """Documents of a folder; raises the first error, or when there is nothing to load."""
    documents, errors = load_folder(spark, folder, ocr)
    first = errors.orderBy("file_path").first()
    if first is not None:
        raise LoadError(first["error"])
    if documents.isEmpty():
        raise LoadError(f"Nenhum arquivo textual suportado foi encontrado em: {folder}")
    return documents


@F.pandas_udf(StringType())
def flattened_json(texts: pd.Series) -> pd.Series:
    """JSON text as ``path: value`` lines; text that is not JSON is returned unchanged."""

    def one(raw):
        if raw is None:
            return None
        try:
            return "\n".join(flatten_json(json.loads(raw))) or raw
        except ValueError:
            return raw

    return texts.map(one)


def prefer_stored(stored: DataFrame | None, folder_documents: DataFrame) -> DataFrame:
    """The stored documents if there are any, otherwise those read from disk."""
    return folder_documents if stored is None or stored.isEmpty() else stored


def load_csv_rows(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, first line as header; raises on a wrong suffix or an empty table."""
    if not path.lower().endswith(".csv"):
        raise LoadError(f"Extensão inválida para CSV: {path}")
    rows = spark.read.options(header=True, encoding="UTF-8", multiLine=True).csv(path)
    if not rows.columns:
        raise LoadError(f"CSV sem cabeçalho válido: {path}")
    if rows.isEmpty():
        raise LoadError(f"CSV sem linhas de dados: {path}")
    return rows


def load_eval_queries(spark: SparkSession, path: str) -> DataFrame:
    """Benchmark queries from JSON: a list of queries or an object with a ``queries`` list."""
    raw = spark.read.option("multiLine", "true").json(path)
    rows = raw.select(F.explode("queries").alias("q")).select("q.*") if "queries" in raw.columns else raw
    blank = {"description": F.lit(""), "min_score": F.lit(0.0)}
    for name, default in blank.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), default) if name in rows.columns else default)
    return rows.select("query", "expected_files", "description", "min_score")


def load_flat_index(spark: SparkSession, path: str) -> DataFrame:
    """Legacy flat index: a JSON list of file entries, possibly nested under one key."""
    raw = spark.read.option("multiLine", "true").json(path)
    nested = [f.name for f in raw.schema.fields if f.dataType.typeName() == "array" and "struct" in f.dataType.simpleString()]
    return raw.select(F.explode(nested[0]).alias("e")).select("e.*") if nested else raw
