"""Corpus audit: features, outliers, duplicates and similarity clusters per ingestion batch.

An audit compares the documents of one ingestion batch (at most 200 files, in
scan order) with each other. The text is read once to derive a narrow feature
row per document; everything after that works on those rows and needs a single
shuffle, by batch.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from foliospark.functions import text as tx, words
from foliospark.operators import chunking, dedup, quantiles
from foliospark.operators.skew import number_rows
from foliospark.staging import stage

BATCH_SIZE = 200
#: Rows of a batch compared at once.
COMPARED = 512
SIMILARITY_THRESHOLD = 0.3
SIGNATURE_TERMS = 24
MIN_TERM_CHARS = 4
MIN_DOCUMENT_CHARS = 200
MAX_REPETITION_RATIO = 0.4
HIGH_NUMERIC_RATIO = 0.35
LOW_UNIQUE_RATIO = 0.2
ROBUST_Z = 3.5
SHARED_TERMS = 8

# Scan order of file kinds.
EXTENSION_PRIORITY = {
    ".txt": 0, ".md": 1, ".json": 2, ".pdf": 3, ".docx": 4, ".xlsx": 5,
    ".png": 6, ".jpg": 6, ".jpeg": 6, ".tif": 6, ".tiff": 6, ".bmp": 6,
}


def extension_priority(extension: Column | str) -> Column:
    ranks = F.create_map(*[F.lit(v) for pair in EXTENSION_PRIORITY.items() for v in pair])
    return F.coalesce(F.try_element_at(ranks, tx.col(extension)), F.lit(99))


def repetition_ratio(lines: Column) -> Column:
    """Share of non-blank lines whose normalised text occurs more than once."""


    def ratio(ordered: Column) -> Column:
        repeated = F.filter(ordered, lambda x, i: (x == F.get(ordered, i + 1)) | (x == F.get(ordered, i - 1)))
        return F.when(F.size(ordered) > 1, F.size(repeated) / F.size(ordered)).otherwise(F.lit(0.0))

    return tx.let(F.sort_array(lines), ratio)


def signature_candidates(tokens: Column) -> Column:
    return F.filter(
        tokens, lambda t: (F.length(t) >= MIN_TERM_CHARS) & F.rlike(t, F.lit(tx.ANY_NON_DIGIT))
    )


_FEATURES = (
    "fingerprint string, char_count int, token_count int, unique_token_ratio double, numeric_ratio double,"
    " repetition_ratio double, signature_terms array<string>"
)


def _features_of(raw: str) -> tuple:
    """The features of one text, by the rules of ``tx.fingerprint``, ``repetition_ratio``, ``signature_candidates`` and ``tx.top_terms``."""
    text = raw.strip()
    folded = words.casefold(text)
    counts = Counter(words.WORD.findall(folded))  # in order of first occurrence
    tokens = counts.total()
    terms = [t for t in counts if len(t) >= MIN_TERM_CHARS and (t.isalpha() or words.NOT_DIGIT.search(t))]
    lines = Counter(filter(None, map(words.collapse_ws, folded.splitlines())))
    repeated = sum(n for n in lines.values() if n > 1)
    return (
        hashlib.sha256(words.collapse_ws(raw.lower()).encode()).hexdigest(),
        len(text),
        tokens,
        len(counts) / tokens if tokens else 0.0,
        words.digits(text) / len(text) if text else 0.0,
        repeated / lines.total() if lines else 0.0,
        sorted(terms, key=counts.__getitem__, reverse=True)[:SIGNATURE_TERMS],
    )


def _text_features(texts: pa.Array) -> pa.Array:
    columns = zip(*(_features_of(t or "") for t in texts.to_pylist()), strict=True)
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.string()))
    names = [f.strip().split(" ")[0] for f in _FEATURES.split(",")]
    made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)] if len(texts) else [pa.array([], k) for k in kinds]
    return pa.StructArray.from_arrays(made, names)


def document_features(docs: DataFrame) -> DataFrame:
    """Narrow per-document features from (file_path, file_extension, content); no shuffle.

    An optional ``chunk_text`` column replaces the content for counting usable chunks
    (flattened JSON, for example). A text goes to Python once and is read there.
    """
    chunk_source = "chunk_text" if "chunk_text" in docs.columns else "content"
    # Only Markdown sections depend on white space around the text.
    stripped = F.when(F.col("file_extension") == ".md", tx.strip(chunk_source)).otherwise(F.col(chunk_source))
    df = docs.select(
        "file_path",
        "file_extension",
        F.octet_length("content").alias("size_bytes"),
        stripped.alias("__chunked"),
        # Not to be evaluated a second time in a filter pushed below.
        F.arrow_udf(_text_features, _FEATURES).asNondeterministic()("content").alias("__f"),
    )
    return chunking.with_chunks(df, text="__chunked").select(
        "file_path",
        extension_priority("file_extension").alias("scan_priority"),
        "size_bytes",
        "__f.fingerprint",
        "__f.char_count",
        "__f.token_count",
        "__f.unique_token_ratio",
        "__f.numeric_ratio",
        "__f.repetition_ratio",
        F.size("chunks").alias("usable_chunk_count"),
        "__f.signature_terms",
    )


def assign_batches(features: DataFrame, batch_size: int = BATCH_SIZE) -> DataFrame:
    """Cut the corpus into consecutive batches in scan order (priority, size, path)."""
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    order = ["scan_priority", "size_bytes", "__lower_path", "file_path"]
    # Range partitioning samples its input, so the features are written before it:
    # the text is then parsed once, and only narrow rows are sampled and ordered.
    narrow = stage(features.withColumn("__lower_path", F.lower("file_path")), "audit-features")
    ranged = narrow.repartitionByRange(*order).withColumn("__pid", F.spark_partition_id())
    numbered = number_rows(stage(ranged, "audit-order"), "__pid", order)
    return (
        numbered.withColumn("batch_id", F.floor(F.col("row_index") / batch_size).cast("long"))
        .drop("__pid", "__lower_path", "row_index")
    )


def is_robust_outlier(value: Column, median: Column, mad: Column) -> Column:
    """Median/MAD outlier test, with the ratio rule when the MAD is zero."""
    flat = F.when(median == 0, value > 0).otherwise((value >= median * 3) | (value <= median / 3))
    return F.when(mad == 0, flat).otherwise(F.abs((value - median) * 0.6745 / mad) > ROBUST_Z)


def with_outlier_flags(batched: DataFrame) -> DataFrame:
    """``flags``: the sorted outlier reasons of each document, judged inside its batch."""
    batch = Window.partitionBy("batch_id")
    df = batched
    for name in ("char", "token"):
        df = df.withColumn(f"__{name}_median", F.median(f"{name}_count").over(batch))
    for name in ("char", "token"):
        deviation = F.abs(F.col(f"{name}_count") - F.col(f"__{name}_median"))
        df = df.withColumn(f"__{name}_mad", F.median(deviation).over(batch))
    robust = lambda n: is_robust_outlier(F.col(f"{n}_count"), F.col(f"__{n}_median"), F.col(f"__{n}_mad"))
    checks = {
        "char_count_outlier": robust("char"),
        "low_vocabulary_document": (F.col("token_count") >= 20) & (F.col("unique_token_ratio") < LOW_UNIQUE_RATIO),
        "no_usable_chunks": F.col("usable_chunk_count") == 0,
        "numeric_heavy": F.col("numeric_ratio") > HIGH_NUMERIC_RATIO,
        "repetitive_content": F.col("repetition_ratio") > MAX_REPETITION_RATIO,
        "token_count_outlier": robust("token"),
        "very_short_document": (F.col("char_count") > 0) & (F.col("char_count") < MIN_DOCUMENT_CHARS),
    }
    flags = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in checks.items()]))
    return df.withColumn("flags", flags).drop(
        "__char_median", "__token_median", "__char_mad", "__token_mad"
    )


def _overlaps(owner: np.ndarray, code: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, first column, Jaccard matrix) of all pairs of row blocks.

    ``code`` are the terms as numbers, grouped by their row ``owner``. Only terms that both
    blocks have become columns of the matrices multiplied.
    """
    starts = range(0, len(sizes), COMPARED)
    spans = [slice(*np.searchsorted(owner, (a, a + COMPARED))) for a in starts]
    for a, left in zip(starts, spans, strict=True):
        for c, right in zip(starts, spans, strict=True):
            both = np.intersect1d(code[left], code[right])

            def member(first: int, span: slice, both: np.ndarray = both) -> np.ndarray:
                made = np.zeros((min(COMPARED, len(sizes) - first), len(both)), np.float32)
                there = np.isin(code[span], both)
                made[owner[span][there] - first, np.searchsorted(both, code[span][there])] = 1.0
                return made

            shared = (member(a, left) @ member(c, right).T).astype(np.float64)
            union = sizes[a : a + COMPARED, None] + sizes[None, c : c + COMPARED] - shared
            yield a, c, np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)


def _link_batch(batch: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Connected components of one batch under Jaccard >= threshold, compared block by block."""
    batch = batch.sort_values("file_path", ignore_index=True)
    n = len(batch)
    sizes = batch["signature_terms"].map(len).to_numpy(np.float64)
    owner = np.repeat(np.arange(n), sizes.astype(np.int64))
    code, names = pd.factorize(np.array([t for terms in batch["signature_terms"] for t in terms], dtype=object))

    links, ends = np.zeros(n, np.int64), []
    for a, c, jaccard in _overlaps(owner, code, sizes):
        i, j = np.nonzero(jaccard >= threshold)
        apart = i + a != j + c
        ends.append((i[apart] + a, j[apart] + c))
        links[a : a + COMPARED] += np.bincount(i[apart], minlength=len(jaccard))
    left, right = (np.concatenate(e) for e in zip(*ends, strict=True)) if ends else (owner[:0], owner[:0])
    label = np.arange(n)
    while True:
        lower = label.copy()
        np.minimum.at(lower, left, label[right])
        lower = lower[lower]
        if np.array_equal(lower, label):
            break
        label = lower

    # Mean over all pairs of a cluster, linked or not; the cluster is named by its smallest row.
    total = np.zeros(n)
    for a, c, jaccard in _overlaps(owner, code, sizes) if len(left) else ():
        i, j = np.nonzero(label[a : a + COMPARED, None] == label[None, c : c + COMPARED])
        apart = i + a != j + c
        total += np.bincount(label[i[apart] + a], jaccard[i[apart], j[apart]], n)
    size = np.bincount(label, minlength=n)[label] if n else label
    uses = pd.DataFrame({"label": label[owner], "term": code}).value_counts().reset_index()
    uses = uses[uses["count"].to_numpy() == np.bincount(label, minlength=n)[uses["label"].to_numpy()]] if n else uses
    common = {k: sorted(names[g.to_numpy()])[:SHARED_TERMS] for k, g in uses.groupby("label")["term"]}
    member = size > 1
    out = batch.drop(columns=["signature_terms"])
    out["cluster_id"] = np.where(member, batch["file_path"].to_numpy(object)[label], None)
    out["cluster_size"] = size
    out["average_similarity"] = np.where(member, total[label] / np.maximum(size * (size - 1), 1), np.nan)
    out["shared_terms"] = pd.Series([common.get(k, []) if m else None for k, m in zip(label, member, strict=True)], dtype=object)
    out["links"] = links
    return out


def with_clusters(batched: DataFrame, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """Add cluster_id (smallest member path), size, shared terms and mean similarity.

    Documents outside any cluster of two keep a null ``cluster_id``. ``links`` is
    the number of batch neighbours at or above the threshold.
    """
    kept = [f for f in batched.schema.fields if f.name != "signature_terms"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    schema += (
        ", cluster_id string, cluster_size bigint, average_similarity double,"
        " shared_terms array<string>, links bigint"
    )
    linked = batched.groupBy("batch_id").applyInPandas(lambda pdf: _link_batch(pdf, threshold), schema)
    return linked.withColumn("average_similarity", F.round(F.nanvl("average_similarity", F.lit(None)), 3))


def audit_documents(
    docs: DataFrame, batch_size: int = BATCH_SIZE, threshold: float = SIMILARITY_THRESHOLD
) -> DataFrame:
    """One audited row per document: flags, duplicate_of and cluster, judged inside its batch.

    ``docs`` needs file_path, file_extension and content. One shuffle by
    ``batch_id`` serves the outlier windows, the duplicate window and the
    clustering.
    """
    batched = assign_batches(document_features(docs), batch_size)
    flagged = with_outlier_flags(batched.repartition("batch_id"))
    marked = dedup.with_duplicate_of(flagged, "batch_id")
    narrow = marked.select(
        "batch_id", "file_path", "flags", "duplicate_of", "signature_terms"
    )
    return with_clusters(narrow, threshold)


def clusters(audited: DataFrame) -> DataFrame:
    """One row per cluster. A cluster never exceeds its batch, so the lists stay bounded."""
    return (
        audited.where(F.col("cluster_id").isNotNull())
        .groupBy("batch_id", "cluster_id")
        .agg(
            F.array_sort(F.collect_list("file_path")).alias("member_paths"),
            F.first("shared_terms").alias("shared_terms"),
            F.first("average_similarity").alias("average_similarity"),
        )
    )


def flag_counts(flagged: DataFrame, flags: str = "flags") -> DataFrame:
    return (
        flagged.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("documents"))
    )


def summary(audited: DataFrame) -> DataFrame:
    """Corpus totals of an audit: documents, duplicates, outliers, clusters."""
    clustered = F.when(F.col("cluster_id") == F.col("file_path"), 1)
    return audited.agg(
        F.count(F.lit(1)).alias("total_documents"),
        F.count("duplicate_of").alias("duplicates"),
        F.count_if(F.size("flags") > 0).alias("outliers"),
        F.count(clustered).alias("clusters"),
    )


def robust_stats(values: DataFrame, value: str) -> DataFrame:
    """Median and MAD of an integer measure over the whole table, exact, without one task that holds its values."""
    measured = stage(values.select(F.col(value).cast("long").alias("v")), "measure")
    middle = quantiles.median(measured, "v")
    spread = None if middle is None else quantiles.median(measured, F.abs(F.col("v") - F.lit(middle)))
    return values.sparkSession.createDataFrame([(middle, spread)], "median double, mad double")
