"""Turn audit findings and load errors into index / review / isolate decisions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

from foliospark.functions import text as tx

# Flags that keep a document out of the index unless a policy overrides them.
ISOLATE_FLAGS = (
    "low_vocabulary_document", "no_usable_chunks", "numeric_heavy", "repetitive_content", "very_short_document",
)
OCR_EXTENSIONS = (".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp")
ERROR_PREFIX = "Falha ao carregar "


def isolate_policy(flags: str | Iterable[str] | None = None) -> tuple[str, ...]:
    """Flags that isolate: the default set, a comma-separated string, or any iterable."""
    if flags is None:
        return ISOLATE_FLAGS
    parts = flags.split(",") if isinstance(flags, str) else flags
    return tuple(dict.fromkeys(str(p).strip().lower() for p in parts if str(p).strip()))


def action(flags: Column, policy: Iterable[str] = ISOLATE_FLAGS) -> Column:
    isolating = F.array(*[F.lit(f) for f in policy]).cast("array<string>")
    return (
        F.when(F.array_contains(flags, "duplicate_document"), "ignore_duplicate")
        .when(F.arrays_overlap(flags, isolating), "isolate")
        .when(F.size(flags) > 0, "index_with_review")
        .otherwise("index")
    )


def plan(audited: DataFrame, policy: Iterable[str] = ISOLATE_FLAGS) -> DataFrame:
    """One decision per audited document: flags, action, should_index, duplicate_of."""
    extra = F.array_compact(
        F.array(
            F.when(F.col("duplicate_of").isNotNull(), F.lit("duplicate_document")),
            F.when(F.col("cluster_id").isNotNull(), F.lit("cluster_similar_document")),
        )
    )
    return (
        audited.withColumn("flags", F.array_sort(F.array_union("flags", extra)))
        .withColumn("action", action(F.col("flags"), policy))
        .select(
            "file_path",
            "flags",
            "action",
            F.col("action").isin("index", "index_with_review").alias("should_index"),
            "duplicate_of",
        )
    )


def action_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("action").agg(F.count(F.lit(1)).alias("documents"))


def error_decisions(errors: DataFrame, message: str = "error") -> DataFrame:
    """Load errors that OCR could cure, as ``ocr_required`` decisions; other errors yield no row."""
    pattern = f"(?s)^{ERROR_PREFIX}(.*?): (.*)$"
    path = tx.strip(F.regexp_extract(message, pattern, 1))
    low = tx.casefold(message)
    ext = tx.file_extension("file_path")
    pdf = ext == ".pdf"
    needs_ocr = (
        (pdf & F.contains(low, F.lit("pdf sem texto extraivel")))
        | (~pdf & F.contains(low, F.lit("imagem requer ocr")))
        | F.contains(low, F.lit("ocr para imagem indisponivel"))
        | F.contains(low, F.lit("ocr executado mas nao produziu texto"))
        | F.contains(low, F.lit("ocr para pdf indisponivel"))
    )
    return (
        errors.withColumn("file_path", path)
        .where((F.col("file_path") != "") & ext.isin(*OCR_EXTENSIONS) & needs_ocr)
        .select(
            "file_path",
            F.array(F.lit("ocr_required")).alias("flags"),
            F.lit("ocr_required").alias("action"),
            F.lit(False).alias("should_index"),
            F.lit(None).cast("string").alias("duplicate_of"),
        )
    )


def indexable(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Only the documents whose decision allows indexing."""
    return docs.join(decisions.where("should_index").select("file_path"), "file_path", "left_semi")


def review_candidates(docs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Documents to re-index selectively: those sent to review."""
    wanted = decisions.where(F.col("action") == "index_with_review").select("file_path")
    return docs.join(wanted, "file_path", "left_semi")


def error_summary(errors: DataFrame, message: str = "error") -> DataFrame:
    """One row: total, counts per error class, and three sample messages."""
    low = tx.casefold(message)
    says = lambda words: F.count_if(F.contains(low, F.lit(words)))
    samples = errors.orderBy(message).limit(3).agg(F.array_sort(F.collect_list(message))).scalar()
    return errors.agg(
        F.count(F.lit(1)).alias("total"),
        says("pdf sem texto extraivel").alias("pdf_without_text"),
        says("suporte a pdf indisponivel").alias("pdf_dependency"),
        says("imagem requer ocr").alias("image_requires_ocr"),
        says("ocr para imagem indisponivel").alias("image_ocr_dependency"),
    ).withColumn("samples", samples)
