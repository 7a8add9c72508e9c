"""Segment, window, quality-filter and de-duplicate text, all inside the row.

Everything is array functions over one document, so chunking never shuffles.
Windows are cut by one regular-expression pass over the text instead of one
``substring`` per window: ``substring`` walks from the start of the string each
time, which is quadratic for book-sized texts.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foliospark.functions import text as tx, words

MAX_CHARS = 1000
OVERLAP = 120
MIN_CHUNK_CHARS = 60
MIN_ALPHA_RATIO = 0.30
MAX_NUMERIC_RATIO = 0.60
MIN_UNIQUE_WORDS = 5

# Openings that mark a chunk as boilerplate (matched on lower-cased text).
BOILERPLATE = (
    r"^(table\s+of\s+contents|tabela\s+de\s+conte[uú]do|summ?[aá]rio|index|[ií]ndice"
    r"|copyright|all\s+rights?\s+reserved|isbn[:\s]|page\s+[0-9]+\s+of\s+[0-9]+|p[aá]gina\s+[0-9]+)"
)
HEADING_MARK = "\u0001"
# White space as in the JVM's expressions.
_BOILERPLATE = re.compile(BOILERPLATE, re.ASCII)
_HEADING = re.compile(r"^(#{1,6}\s+.+)$", re.ASCII | re.MULTILINE)


def paragraphs(text: Column) -> Column:
    """Blocks separated by at least one blank line; the whole text if there are none."""
    blocks = F.filter(F.transform(F.split(text, f"\n{tx.WS}*\n+"), tx.strip), lambda p: p != "")
    return tx.let(blocks, lambda parts: F.when(F.size(parts) > 0, parts).otherwise(F.array(tx.strip(text))))


def markdown_sections(text: Column) -> Column:
    """One segment per heading with its body, plus the preamble; paragraphs if no heading.

    Each heading line is wrapped in U+0001 marks and the text split there, so odd
    elements are headings and the next element is the body. U+0001 never occurs in
    sanitised text; any present in raw text is blanked first.
    """
    clean = F.translate(text, HEADING_MARK, " ")
    marked = F.regexp_replace(clean, r"(?md)^(#{1,6}\s+.+)$", f"{HEADING_MARK}$1{HEADING_MARK}")

    def sections(parts: Column) -> Column:
        def section(part: Column, i: Column) -> Column:
            body = F.coalesce(F.get(parts, i + 1), F.lit(""))
            headed = F.when(body == "", part).otherwise(F.concat(part, F.lit("\n"), body))
            return F.when(i == 0, part).when(i % 2 == 1, headed)

        found = F.filter(F.transform(parts, section), lambda p: p.isNotNull() & (p != ""))
        return F.when(F.size(parts) == 1, paragraphs(text)).otherwise(found)

    return tx.let(F.transform(F.split(marked, HEADING_MARK), tx.strip), sections)


def windows(text: Column, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> Column:
    """Overlapping windows of ``max_chars`` over an already stripped text."""
    if max_chars <= 0:
        raise ValueError("max_chars must be positive")
    if overlap < 0:
        raise ValueError("overlap must not be negative")
    if overlap >= max_chars:
        raise ValueError("overlap must be smaller than max_chars")
    step = max_chars - overlap
    reach = math.ceil(max_chars / step)
    count = F.ceil((F.length(text) - max_chars) / F.lit(step)).cast("int") + 1

    def cut(blocks: Column) -> Column:
        pieces = F.transform(
            F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
            lambda i: tx.strip(F.substring(F.array_join(F.slice(blocks, i, reach), ""), 1, max_chars)),
        )
        return F.filter(pieces, lambda w: w != "")

    steps = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), 0)
    return (
        F.when(text == "", F.array().cast("array<string>"))
        .when(F.length(text) <= max_chars, F.array(text))
        .otherwise(tx.let(steps, cut))
    )


def quality_reason(chunk: Column | str) -> Column:
    """Why a (stripped) chunk is rejected; null when it is accepted."""
    c = tx.col(chunk)
    low = F.lower(c)
    words = F.array_distinct(F.filter(F.split(low, f"{tx.WS}+"), lambda w: w != ""))
    return (
        F.when(F.length(c) < MIN_CHUNK_CHARS, "too_short")
        .when(tx.letters(c) / F.length(c) < MIN_ALPHA_RATIO, "low_alpha_ratio")
        .when(tx.digits(c) / F.length(c) > MAX_NUMERIC_RATIO, "high_numeric_ratio")
        .when(F.size(words) < MIN_UNIQUE_WORDS, "low_vocabulary")
        .when(F.substring(low, 1, 200).rlike(BOILERPLATE), "boilerplate")
    )


def with_segments(df: DataFrame, text: str, extension: str, out: str) -> DataFrame:
    """Segments by file kind. JSON is chunked as text; flatten it first (sources.documents) for key paths."""
    t, ext = F.col(text), F.col(extension)
    return df.withColumn(out, F.when(ext == ".md", markdown_sections(t)).otherwise(paragraphs(t)))


def with_windows(
    df: DataFrame, text: str, extension: str, out: str, max_chars: int = MAX_CHARS, overlap: int = OVERLAP
) -> DataFrame:
    """Array of windows of every segment, before any quality filter."""
    seg = f"__{out}_segments"
    df = with_segments(df, text, extension, seg)
    cut = F.flatten(F.transform(F.col(seg), lambda s: windows(s, max_chars, overlap)))
    return df.withColumn(out, F.coalesce(cut, F.array().cast("array<string>"))).drop(seg)


def _accepted(chunk: str) -> bool:
    """No ``quality_reason``."""
    n = len(chunk)
    if n < MIN_CHUNK_CHARS:
        return False
    # Where half are ASCII letters, neither ratio has to be counted; the first words tell most texts.
    if 2 * words.ascii_letters(chunk) < n and (words.letters(chunk) / n < MIN_ALPHA_RATIO or words.digits(chunk) / n > MAX_NUMERIC_RATIO):
        return False
    low = chunk.lower()
    if len(set(low.split(None, 20)[:20])) < MIN_UNIQUE_WORDS and len(set(low.split())) < MIN_UNIQUE_WORDS:
        return False
    return not _BOILERPLATE.search(low[:200])


def _segments(text: str, markdown: bool) -> list[str]:
    """``markdown_sections`` or ``paragraphs`` of one text; empty segments give no window."""
    if markdown:
        marked = _HEADING.sub(rf"{HEADING_MARK}\1{HEADING_MARK}", text.replace(HEADING_MARK, " "))
        first, *parts = map(str.strip, marked.split(HEADING_MARK))
        if parts:
            return [first, *(f"{head}\n{body}" if body else head for head, body in zip(parts[::2], parts[1::2], strict=True))]
    return [p.strip() for p in words.BLANK_LINES.split(text)]


def chunks_of(text: str | None, extension: str | None, max_chars: int = MAX_CHARS, overlap: int = OVERLAP) -> list[str]:
    """``windows`` of every segment of one text, those without a quality reason, each once."""
    step = max_chars - overlap

    def windows_of(segment: str) -> list[str]:
        if len(segment) <= max_chars:
            return [segment]
        count = math.ceil((len(segment) - max_chars) / step) + 1
        return [segment[k * step : k * step + max_chars].strip() for k in range(count)]

    cut = (w for s in _segments(text or "", extension == ".md") for w in windows_of(s))
    return [w for w in dict.fromkeys(cut) if _accepted(w)]


def _chunker(max_chars: int, overlap: int):
    """``chunks_of`` every text; one pass over a text in Python."""

    def run(texts: pa.Array, extensions: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), extensions.to_pylist(), strict=True)
        return pa.array([chunks_of(text, extension, max_chars, overlap) for text, extension in pairs], pa.list_(pa.string()))

    # Not to be evaluated a second time in a filter pushed below.
    return F.arrow_udf(run, "array<string>").asNondeterministic()


def with_chunks(
    df: DataFrame,
    text: str = "content",
    extension: str = "file_extension",
    out: str = "chunks",
    max_chars: int = MAX_CHARS,
    overlap: int = OVERLAP,
    keep_quality: bool = True,
) -> DataFrame:
    """Full chunking of a document: segment, window, quality filter, de-duplicate.

    ``keep_quality=False`` gives the variant without filter and de-duplication.
    """
    if not keep_quality:
        return with_windows(df, text, extension, out, max_chars, overlap)
    windows(F.lit(""), max_chars, overlap)  # checks the limits
    return df.withColumn(out, _chunker(max_chars, overlap)(F.col(text), F.col(extension)))


def explode_chunks(df: DataFrame, key: str, chunks: str = "chunks", *keep: str) -> DataFrame:
    """One row per chunk: key, chunk_index, text (and any ``keep`` columns).

    The outer form is used because for the inner one the optimizer adds a
    size(chunks) > 0 filter below, which evaluates the whole chunking again.
    """
    rows = df.select(key, *keep, F.posexplode_outer(chunks).alias("chunk_index", "text"))
    return rows.where(F.col("chunk_index").isNotNull())


def or_blank_chunk(chunks: str = "chunks") -> Column:
    """A document whose chunks were all rejected is stored with one empty chunk."""
    c = F.col(chunks)
    return F.when(F.size(c) > 0, c).otherwise(F.array(F.lit("")))


def join_chunks(chunk_rows: DataFrame, key: str) -> DataFrame:
    """Rebuild one document per key from its chunk rows: content, bytes, preview."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return (
        chunk_rows.groupBy(key)
        .agg(ordered.alias("__parts"))
        .select(
            key,
            F.array_join(F.transform("__parts", lambda p: p["text"]), "\n\n").alias("content"),
            F.get("__parts", F.lit(0))["text"].alias("__head"),
        )
        .select(
            key,
            "content",
            F.octet_length("content").alias("size_bytes"),
            F.substring(tx.strip(F.replace("__head", F.lit("\n"), F.lit(" "))), 1, 220).alias("preview"),
        )
    )
