"""Chunk store rows, term scans and a persisted inverted index."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from foliospark.functions import catalog, text as tx
from foliospark.operators import chunking
from foliospark.staging import stage

BROADCAST_ROWS = 500_000
TERM_BUCKETS = 64
BUCKET_SPREAD = 8
MAX_STARTS = 1000


def bounded(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a written table only when its counted rows stay under ``limit``.

    Larger tables are returned unhinted, so the join shuffles instead.
    """
    return F.broadcast(df) if df.count() <= limit else df


def stored_documents(docs: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rows as the index keeps them: metadata, catalogue header, content hash and chunks, and the columns ``keep``.

    No shuffle: one row in, one row out. The text is stored once, as its chunks.
    """
    df = catalog.with_catalog(docs)
    df = chunking.with_chunks(df, text="indexable")
    return df.select(
        "file_path",
        "file_extension",
        "metadata",
        "catalog_text",
        F.sha2(F.concat("indexable", F.lit("\n"), F.to_json("metadata")), 256).alias("content_hash"),
        chunking.or_blank_chunk("chunks").alias("chunks"),
        *keep,
    )


def with_content(stored: DataFrame) -> DataFrame:
    """Add ``content``: the stored chunks joined by blank lines, which document ranking reads."""
    return stored.withColumn("content", F.array_join("chunks", "\n\n"))


@dataclass(frozen=True)
class TermScan:
    """Occurrences of the wanted terms plus the two corpus statistics BM25 needs."""

    hits: DataFrame  # keys..., dl, term, tf
    keys: tuple[str, ...]
    rows: int
    total_length: int

    @property
    def avg_length(self) -> float:
        return self.total_length / self.rows if self.rows else 0.0


def shingles(tokens: Column, n: int, first: Sequence[str] | None = None) -> Column:
    """Runs of ``n`` adjacent tokens joined by a space; only those starting with ``first`` if given."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - n + 1, F.lit(1)))
    if first is not None:
        starts = F.filter(starts, lambda i: F.get(tokens, i - 1).isin(list(first)))
    runs = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) >= n, runs).otherwise(F.array().cast("array<string>"))


def phrase_starts(vocabulary: DataFrame) -> dict[int, list[str] | None]:
    """Phrase lengths in a (term, words) vocabulary, each with the words its phrases start with.

    The start words only save work; beyond MAX_STARTS of them (None) every run is considered.
    """
    heads = vocabulary.where(F.col("words") > 1).select("words", F.substring_index("term", " ", 1).alias("head"))
    rows = heads.distinct().limit(MAX_STARTS + 1).collect()
    if len(rows) > MAX_STARTS:
        return {r["words"]: None for r in vocabulary.where(F.col("words") > 1).select("words").distinct().collect()}
    starts: dict[int, list[str] | None] = {}
    for r in rows:
        starts.setdefault(r["words"], []).append(r["head"])
    return starts


def scan_terms(
    rows: DataFrame,
    keys: Sequence[str],
    tokens: Column,
    vocabulary: DataFrame,
    phrases: dict[int, list[str] | None] | None = None,
) -> TermScan:
    """One pass over the text: keep only occurrences of ``vocabulary.term``.

    Terms are counted inside each row, so nothing is shuffled before the filter,
    and the row count and total length are observed during the same pass. The
    (small) result is written, so later steps never read the text again.
    ``phrases`` adds multi-word terms (see phrase_starts).
    """
    seen = Observation()
    wanted = bounded(vocabulary.select("term").distinct())
    measured = rows.select(*keys, tokens.alias("__tokens")).withColumn("dl", F.size("__tokens"))
    measured = measured.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")
    )
    terms = F.col("__tokens")
    for n, first in sorted((phrases or {}).items()):
        terms = F.concat(terms, shingles(F.col("__tokens"), n, first))
    # The outer form keeps the optimizer from adding a filter that counts the terms twice.
    counted = measured.select(*keys, "dl", F.inline_outer(tx.term_counts(terms)))
    hits = counted.select(*keys, "dl", "term", "tf").join(wanted, "term", "left_semi")
    written = stage(hits, "term-hits")
    stats = seen.get
    return TermScan(written, tuple(keys), int(stats["rows"]), int(stats["total"]))


def postings(rows: DataFrame, keys: Sequence[str], tokens: Column) -> DataFrame:
    """Every (key, term) occurrence with tf and the row's length; no shuffle."""
    measured = rows.select(*keys, tokens.alias("__tokens"))
    terms = F.inline_outer(tx.term_counts("__tokens"))
    entries = measured.select(*keys, F.size("__tokens").alias("dl"), terms)
    return entries.where(F.col("term").isNotNull()).drop("first")


def term_stats(entries: DataFrame) -> DataFrame:
    """Document frequency and total occurrences per term (map-side combined)."""
    return entries.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("occurrences")
    )


def corpus_stats(rows: DataFrame, tokens: Column) -> DataFrame:
    length = F.size(tokens)
    return rows.agg(F.count(F.lit(1)).alias("documents"), F.avg(length).alias("avg_length"))


def term_bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def write_index(docs: DataFrame, path: str) -> None:
    """Persist documents, chunks and both posting tables under ``path``.

    Postings are laid out by term bucket so a search reads only the buckets of
    its own terms; each bucket is spread over several files by document, so a
    term found in every document does not end up in one task.
    """
    spark = docs.sparkSession
    stored_documents(docs).write.mode("overwrite").parquet(f"{path}/documents")
    stored = with_content(spark.read.parquet(f"{path}/documents"))
    chunks = chunking.explode_chunks(stored, "file_path")
    for name, rows, keys, tokens in (
        ("chunk_postings", chunks, ["file_path", "chunk_index"], tx.search_tokens("text")),
        ("doc_postings", stored, ["file_path"], tx.tokens("content")),
    ):
        spread = F.pmod(F.xxhash64("file_path"), F.lit(BUCKET_SPREAD))
        entries = postings(rows, keys, tokens).withColumn("bucket", term_bucket(F.col("term")))
        laid_out = entries.repartition("bucket", spread).sortWithinPartitions("bucket", "term")
        laid_out.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
        lengths = rows.select(F.size(tokens).alias("dl"))
        lengths.agg(
            F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("dl"), F.lit(0)).alias("total")
        ).write.mode("overwrite").parquet(f"{path}/{name}_stats")


def read_index(spark: SparkSession, path: str, name: str, keys: Sequence[str], terms: Sequence[str]) -> TermScan:
    """Occurrences of ``terms`` from a persisted posting table, pruned to their buckets."""
    table = spark.read.parquet(f"{path}/{name}")
    one = spark.range(1)
    buckets = sorted(
        r[0] for r in one.select(F.explode(F.array(*[term_bucket(F.lit(t)) for t in terms]))).distinct().collect()
    )
    hits = table.where(F.col("bucket").isin(buckets) & F.col("term").isin(list(terms))).drop("bucket")
    stats = spark.read.parquet(f"{path}/{name}_stats").first()
    return TermScan(hits, tuple(keys), int(stats["rows"]), int(stats["total"]))
