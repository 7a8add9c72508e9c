"""Search over a stored index: positional postings in blocks, scored where they lie.

``write`` lays a corpus out once:

* ``files``: (position, file_path, has_word, ...) with positions in path order;
* for each field (documents or chunks under one tokeniser) ``blocks``: rows (segment, term)
  with up to ``BLOCK`` postings as arrays: document numbers as differences, term
  frequencies, lengths, and places of the term as differences, written by the task that
  holds the segment;
* ``terms`` (term, df), ``spectrum`` (df, number of terms) and ``totals``;
* ``repeats`` (segment, position, first): rows whose path an earlier row has, with the first of that path;
* ``stems`` (stem, term), where ``write_stems`` was called: the vocabulary by stem.

A document number is ``position << CHUNK_BITS | chunk``: numbers follow paths, so ties need
no look-up, and a segment is a range of positions; all rows of a path are in one. A search joins the blocks of the wanted
terms with the queries that ask for them and deals them out by segment. A task adds up all
contributions to its own documents and returns the best few per query, so what is shuffled
afterwards is a few rows per query and segment. Phrases are found by intersecting places
and become blocks of their own. No search reads a text or writes one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window, functions as F

from foliospark.functions import stemming, text as tx, words
from foliospark.operators import chunking, retrieval as rt
from foliospark.operators.index import bounded
from foliospark.staging import stage

BLOCK = 128
CHUNK_BITS = 20
#: Files of a segment and rows of a partition, as powers of two.
SEGMENT_BITS, PARTITION_BITS = 13, 22
#: Tokens that a task holds while it inverts them.
HELD = 1 << 21
#: Tokens that it holds as Python strings.
PIECE = 1 << 17

_BLOCKS = (
    "segment bigint, term string, n int, docs array<bigint>, tfs array<int>, lens array<int>, places array<int>"
)


@dataclass(frozen=True)
class Field:
    """What is indexed: whole documents (column ``content``) or the array column ``chunks``."""

    name: str
    tokens: Callable[[str], list[str]]
    chunked: bool = False
    blank: bool = True  # rows without a token count as documents


DOCUMENTS = Field("documents", words.tokens, blank=False)
FOLDED_DOCUMENTS = Field("folded_documents", words.folded_tokens)
CHUNKS = Field("chunks", words.search_tokens, chunked=True)
FOLDED_CHUNKS = Field("folded_chunks", words.folded_tokens, chunked=True)


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _differences(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Differences to the value before; values at ``starts`` stay."""
    out = np.diff(values, prepend=0)
    out[starts] = values[starts]
    return out


def _sums(differences: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Inverse of ``_differences`` for runs of the given sizes."""
    total = np.cumsum(differences)
    starts = np.cumsum(sizes) - sizes
    before = np.where(starts > 0, total[starts - 1], 0)
    return total - np.repeat(before, sizes)


def _invert(block: int):
    """Rows (segment, doc, tokens) in document order -> blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, pa.Array]] = []
        segment, size = None, 0

        def blocks() -> Iterator[pa.RecordBatch]:
            docs = np.concatenate([d for d, _ in held])
            lists = pa.concat_arrays([t for _, t in held])
            lens = lists.value_lengths().to_numpy().astype(np.int64)
            if not lens.sum():
                return
            coded = lists.flatten().dictionary_encode()
            del lists
            held.clear()
            code = coded.indices.to_numpy()
            order = np.argsort(code, kind="stable").astype(np.int32)
            code = code[order]
            row = np.repeat(np.arange(len(docs), dtype=np.int32), lens)
            place = np.arange(len(code), dtype=np.int32) - np.repeat((np.cumsum(lens) - lens).astype(np.int32), lens)
            row, place = row[order], place[order]
            del order
            fresh = np.ones(len(code), bool)
            fresh[1:] = (code[1:] != code[:-1]) | (row[1:] != row[:-1])
            at = np.flatnonzero(fresh)  # first place of every posting
            tfs = np.diff(np.append(at, len(code)))
            terms = code[at]
            first = np.append(True, terms[1:] != terms[:-1])
            inside = np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]
            cuts = np.flatnonzero(inside % block == 0)  # first posting of every block
            number = docs[row[at]]
            length = lens[row[at]]
            ends = np.append(cuts, len(at))
            spots = np.append(at[cuts], len(code))
            columns = [
                pa.array(np.full(len(cuts), segment), pa.int64()),
                coded.dictionary.take(pa.array(terms[cuts])),
                pa.array(np.diff(ends), pa.int32()),
                _lists(ends, _differences(number, cuts), pa.int64()),
                _lists(ends, tfs, pa.int32()),
                _lists(ends, length, pa.int32()),
                _lists(spots, _differences(place, at), pa.int32()),
            ]
            whole = pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _BLOCKS.split(", ")])
            for k in range(0, len(cuts), 20_000):
                yield whole.slice(k, 20_000)

        for batch in batches:
            segments = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(segments)) + 1).tolist(), len(segments)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and (segments[a] != segment or size >= HELD):
                    yield from blocks()
                    held, size = [], 0
                segment = int(segments[a])
                part = batch.column(2).slice(a, b - a)
                held.append((batch.column(1).slice(a, b - a).to_numpy(), part))
                size += len(part.flatten())
        if held:
            yield from blocks()

    return run


def _lay_out(field: Field, block: int, texts_of: Callable[[str | list[str] | None, str | None], list[str]]):
    """Rows (segment, position, text, extension) in order -> blocks, then (term null, n: rows counted, docs: [tokens])."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = total = 0

        def tokenised() -> Iterator[pa.RecordBatch]:
            nonlocal counted, total
            segments, docs, tokens, size = [], [], [], 0
            for batch in batches:
                for row in zip(*batch.columns, strict=True):
                    segment, position, text, extension = (value.as_py() for value in row)
                    for chunk, part in enumerate(texts_of(text, extension)):
                        found = field.tokens(part)
                        segments.append(segment)
                        docs.append(position << CHUNK_BITS | chunk)
                        tokens.append(found)
                        size += len(found)
                        counted += field.blank or bool(found)
                    if size >= PIECE or len(docs) >= PIECE:
                        total += size
                        yield _rows(segments, docs, tokens)
                        segments, docs, tokens, size = [], [], [], 0
            total += size
            yield _rows(segments, docs, tokens)

        yield from _invert(block)(tokenised())
        none = [pa.array([None], pa.list_(pa.int32()))] * 3
        columns = [pa.array([0], pa.int64()), pa.array([None], pa.string()), pa.array([counted], pa.int32()), pa.array([[total]], pa.list_(pa.int64())), *none]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _BLOCKS.split(", ")])

    return run


def _whole(text: str | None, extension: str | None) -> list[str]:
    return [text or ""]


def _given(chunks: list[str] | None, extension: str | None) -> list[str]:
    return chunks or []


def _rows(segments: list[int], docs: list[int], tokens: list[list[str]]) -> pa.RecordBatch:
    columns = [pa.array(segments, pa.int64()), pa.array(docs, pa.int64()), pa.array(tokens, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(columns, ["segment", "doc", "tokens"])


def write(
    docs: DataFrame, path: str, fields: Sequence[Field], keep: Sequence[str] = (), block: int = BLOCK, segment_bits: int = SEGMENT_BITS,
    derive: Callable[[DataFrame, Sequence[str]], DataFrame] | None = None,
) -> None:
    """Lay out (file_path, content and/or chunks) under ``path``; ``keep`` columns go to ``files``. Rows of one path lie side by side.

    ``derive`` makes the rows to index of those of ``docs``, one by one, and keeps the columns it is
    given; it is applied once, after they are ordered. Without chunks the content is chunked by its ``file_extension``, without
    content it is the chunks joined by blank lines. ``add_field`` indexes more fields later.
    """
    spark = docs.sparkSession
    ordered = docs.repartitionByRange("file_path").sortWithinPartitions("file_path")
    serial = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    fits = F.assert_true(serial < 1 << PARTITION_BITS, F.lit("too many files in a partition; raise spark.sql.shuffle.partitions"))
    position = F.shiftleft(F.spark_partition_id().cast("bigint"), PARTITION_BITS) + serial + F.coalesce(fits.cast("bigint"), F.lit(0))
    # Ranges of paths, sorted: the window moves and sorts nothing.
    first = F.min("position").over(Window.partitionBy("file_path"))
    placed = ordered.withColumn("position", position).withColumn("first", first)
    placed = derive(placed, ("position", "first")) if derive else placed
    columns = [c for c in ("content", "chunks", "file_extension") if c in placed.columns]
    placed.select("file_path", *keep, *columns, "position", "first").write.mode("overwrite").parquet(f"{path}/rows")
    numbered = spark.read.parquet(f"{path}/rows")
    content = F.col("content") if "content" in columns else F.array_join("chunks", "\n\n")
    worded = content.rlike(tx.HAS_WORD)
    numbered.select("position", "file_path", worded.alias("has_word"), *keep).write.mode("overwrite").parquet(f"{path}/files")
    for field in fields:
        add_field(spark, path, field, block, segment_bits)


def add_field(spark: SparkSession, path: str, field: Field, block: int = BLOCK, segment_bits: int = SEGMENT_BITS) -> None:
    """Index a field of the rows that ``write`` has laid out. A task writes the blocks of its segments; no posting is shuffled."""
    rows = spark.read.parquet(f"{path}/rows")
    root, seen = f"{path}/{field.name}", Observation()
    segment = F.shiftright("first", segment_bits).alias("segment")
    rows.where("position <> first").select(segment, "position", "first").write.mode("overwrite").parquet(f"{root}/repeats")
    if not field.chunked:
        text = F.col("content") if "content" in rows.columns else F.array_join("chunks", "\n\n")
        texts_of = _whole
    elif "chunks" in rows.columns:
        text, texts_of = F.col("chunks"), _given
    else:  # cut, split and inverted by one pass over the text
        text, texts_of = F.col("content"), chunking.chunks_of
    extension = F.col("file_extension") if "file_extension" in rows.columns else F.lit(None).cast("string")
    laid = rows.select(segment, "position", text.alias("text"), extension.alias("extension")).mapInArrow(_lay_out(field, block, texts_of), _BLOCKS)
    counts = F.col("term").isNull()
    summed = lambda value: F.coalesce(F.sum(F.when(counts, value).cast("long")), F.lit(0).cast("long"))
    laid = laid.observe(seen, summed(F.col("n")).alias("rows"), summed(F.get("docs", F.lit(0))).alias("total"))
    laid.where(~counts).write.mode("overwrite").parquet(f"{root}/blocks")
    totals = spark.createDataFrame([(seen.get["rows"], seen.get["total"])], "rows bigint, total bigint")
    totals.coalesce(1).write.mode("overwrite").parquet(f"{root}/totals")
    terms = spark.read.schema(_BLOCKS).parquet(f"{root}/blocks").groupBy("term").agg(F.sum("n").alias("df"))
    terms.write.mode("overwrite").parquet(f"{root}/terms")
    spectrum = spark.read.parquet(f"{root}/terms").groupBy("df").agg(F.count(F.lit(1)).alias("terms"))
    spectrum.coalesce(1).write.mode("overwrite").parquet(f"{root}/spectrum")


def write_stems(index: Index, field: Field) -> None:
    """Stem the vocabulary of a field once; no text and no posting is read."""
    root = index.field(field).root
    stemmed = stemming.with_stems(index.spark.read.parquet(f"{root}/terms").select("term"))
    stemmed.select("stem", "term").repartition("stem").sortWithinPartitions("stem", "term").write.mode("overwrite").parquet(f"{root}/stems")


class Index:
    """A written index; ``field`` opens one of its fields."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.files = spark.read.parquet(f"{path}/files")
        self.rows = spark.read.parquet(f"{path}/rows")

    def field(self, field: Field) -> Postings:
        return Postings(self, field.name)


class Postings:
    """One field of an index."""

    def __init__(self, index: Index, name: str):
        read = index.spark.read
        root = f"{index.path}/{name}"
        self.index, self.root = index, root
        self.blocks = index.spark.read.schema(_BLOCKS).parquet(f"{root}/blocks")  # an empty one has no file to tell
        self.terms = read.parquet(f"{root}/terms")
        self.repeats = read.parquet(f"{root}/repeats")
        self.rows, self.total = read.parquet(f"{root}/totals").first()

    @property
    def average(self) -> float:
        return self.total / self.rows if self.rows else 0.0

    @cached_property
    def mean_idf(self) -> float:
        """Mean of ln(N - df + .5) - ln(df + .5) over the vocabulary, from its spectrum of df."""
        spectrum = self.index.spark.read.parquet(f"{self.root}/spectrum")
        idf = F.log(self.rows - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        return float(spectrum.agg(F.sum(idf * F.col("terms")) / F.sum("terms")).first()[0] or 0.0)

    def of_terms(self, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(blocks, (term, df)) of single words and of phrases, whose words are joined by a space."""
        singles = wanted.where(~F.contains("term", F.lit(" "))).select("term").distinct()
        blocks = self.blocks.join(singles, "term", "left_semi").select("segment", "term", "n", "docs", "tfs", "lens")
        counts = self.terms.join(singles, "term", "left_semi").select("term", "df")
        phrases = wanted.where(F.contains("term", F.lit(" "))).select("term").distinct()
        if phrases.isEmpty():
            return blocks, counts
        found = stage(self.phrases(phrases), "phrase-blocks")
        more = found.groupBy("term").agg(F.sum("n").alias("df"))
        return blocks.unionByName(found), counts.unionByName(more)

    def phrases(self, wanted: DataFrame) -> DataFrame:
        """Blocks of phrases: documents in which the words stand side by side, found by their places."""
        parts = wanted.select(F.col("term").alias("phrase"), F.posexplode(F.split("term", " ")).alias("offset", "term"))
        words = wanted.select(F.col("term").alias("phrase"), F.size(F.split("term", " ")).alias("words"))
        met = self.blocks.join(parts, "term").join(words, "phrase").select(
            "segment", "phrase", "offset", "words", "docs", "tfs", "lens", "places"
        )
        dealt = met.repartition("segment", "phrase").sortWithinPartitions("segment", "phrase", "offset")
        return dealt.mapInArrow(_adjoin, "segment bigint, term string, n int, docs array<bigint>, tfs array<int>, lens array<int>")

    @property
    def stems(self) -> DataFrame:
        return self.index.spark.read.schema("stem string, term string").parquet(f"{self.root}/stems")

    def of_stems(self, wanted: DataFrame) -> DataFrame:
        """Blocks of stems: the postings of all their forms, frequencies of one document added up."""
        forms = self.stems.join(wanted.select("stem").distinct(), "stem", "left_semi")
        met = self.blocks.join(forms, "term").select("segment", "stem", "docs", "tfs", "lens")
        dealt = met.repartition("segment", "stem").sortWithinPartitions("segment", "stem")
        return dealt.mapInArrow(_merge, "segment bigint, term string, n int, docs array<bigint>, tfs array<int>, lens array<int>")

    def best(
        self, blocks: DataFrame, weights: DataFrame, k1: float, b: float, limit: int | None, grouped: bool = False, merged: bool = False
    ) -> DataFrame:
        """(query_id, doc, score): the ``limit`` best of each segment (None: all that have a term).

        ``weights``: (query_id, term, weight). ``grouped`` scores files by their best chunk;
        ``merged`` adds up the scores of rows that have one path (and chunk number).
        """
        asked = weights.groupBy("term").agg(F.collect_list(F.struct("query_id", "weight")).alias("asked"))
        kept = blocks.join(asked.select("term"), "term", "left_semi").select("segment", "term", "docs", "tfs", "lens")
        # The queries of a term go once to each segment that has it, not with every block.
        lists = kept.select("segment", "term").distinct().join(asked, "term")
        parts = kept.unionByName(lists, allowMissingColumns=True)
        if merged:
            parts = parts.unionByName(self.repeats, allowMissingColumns=True)
        rows = parts.repartition("segment").sortWithinPartitions("segment", "term")
        kind = weights.schema["query_id"].dataType.simpleString()
        return rows.mapInArrow(_score(k1, b, self.average, limit, grouped), f"query_id {kind}, doc bigint, score double")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first ``keys`` columns of a sorted stream."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_pylist() for k in range(keys)]
        names = list(zip(*columns, strict=True))
        start = 0
        for i, name in enumerate(names):
            if name != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held).combine_chunks()
                held, start, last = [], i, name
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, list sizes) of a list column."""
    column = table[name].combine_chunks()
    column = column if isinstance(column, pa.Array) else column.chunk(0)
    return column.flatten().to_numpy(), column.value_lengths().to_numpy().astype(np.int64)


def _adjoin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _groups(batches, 2):
        offsets = table["offset"].to_numpy()
        words = table["words"][0].as_py()
        if len(np.unique(offsets)) < words:
            continue
        differences, sizes = _flat(table, "docs")
        docs = _sums(differences, sizes)
        tfs, _ = _flat(table, "tfs")
        lens, _ = _flat(table, "lens")
        steps, _ = _flat(table, "places")
        place = _sums(steps, tfs.astype(np.int64))
        numbers, local = np.unique(docs, return_inverse=True)
        length = np.zeros(len(numbers), np.int64)
        length[local] = lens
        start = np.repeat(local.astype(np.int64) << 32, tfs) + place - np.repeat(np.repeat(offsets, sizes), tfs)
        part = np.repeat(np.repeat(offsets, sizes), tfs)
        lists = sorted((start[part == k] for k in range(words)), key=len)  # the rarest word first
        shared = lists[0]
        for other in lists[1:]:
            shared = np.intersect1d(shared, other)
        rows, counts = np.unique(shared >> 32, return_counts=True)
        if not len(rows):
            continue
        whole = [0, len(rows)]
        columns = [
            table["segment"][:1].combine_chunks(), table["phrase"][:1].combine_chunks(), pa.array([len(rows)], pa.int32()),
            _lists(whole, _differences(numbers[rows], np.array([0])), pa.int64()),
            _lists(whole, counts, pa.int32()), _lists(whole, length[rows], pa.int32()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["segment", "term", "n", "docs", "tfs", "lens"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in _groups(batches, 2):
        differences, sizes = _flat(table, "docs")
        numbers, first, local = np.unique(_sums(differences, sizes), return_index=True, return_inverse=True)
        counts = np.bincount(local, _flat(table, "tfs")[0]).astype(np.int64)
        whole = [0, len(numbers)]
        columns = [
            table["segment"][:1].combine_chunks(), table["stem"][:1].combine_chunks(), pa.array([len(numbers)], pa.int32()),
            _lists(whole, _differences(numbers, np.array([0])), pa.int64()),
            _lists(whole, counts, pa.int32()), _lists(whole, _flat(table, "lens")[0][first], pa.int32()),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["segment", "term", "n", "docs", "tfs", "lens"])


def rounded(values: np.ndarray) -> np.ndarray:
    """Half away from zero to the digits of all scores."""
    scale = 10.0**rt.DIGITS
    return np.sign(values) * np.floor(np.abs(values) * scale + 0.5) / scale


def _firsts(numbers: np.ndarray, positions: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Document numbers with repeated positions replaced by the first of their path."""
    order = np.argsort(positions)
    positions, firsts = positions[order], firsts[order]
    position = numbers >> CHUNK_BITS
    at = np.minimum(np.searchsorted(positions, position), len(positions) - 1)
    moved = (firsts[at] << CHUNK_BITS) | (numbers & ((1 << CHUNK_BITS) - 1))
    return np.where(positions[at] == position, moved, numbers)


def _score(k1: float, b: float, average: float, limit: int | None, grouped: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, 1):
            posted = table.filter(table["docs"].is_valid())
            lists = table.filter(table["asked"].is_valid())
            if not posted.num_rows:  # repeated paths without any of the terms
                continue
            differences, sizes = _flat(posted, "docs")
            numbers = _sums(differences, sizes)
            repeats = table.filter(table["first"].is_valid()) if "first" in table.column_names else table[:0]
            if repeats.num_rows:
                numbers = _firsts(numbers, repeats["position"].to_numpy(), repeats["first"].to_numpy())
            numbers, local = np.unique(numbers, return_inverse=True)
            tfs = _flat(posted, "tfs")[0].astype(np.float64)
            lens = _flat(posted, "lens")[0].astype(np.float64)
            norm = 1.0 - b + (b * lens / average if average else 0.0)
            base = tfs * (k1 + 1.0) / (tfs + k1 * norm)
            # The postings of a term lie side by side, each document once, or one path several times.
            named = posted["term"].combine_chunks().dictionary_encode()
            named = named if isinstance(named, pa.Array) else named.chunk(0)
            code = named.indices.to_numpy()
            stops = np.cumsum(sizes)
            starts = stops - sizes
            heads = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            spans = [slice(i, j) for i, j in zip(starts[heads].tolist(), np.append(starts[heads[1:]], stops[-1]).tolist(), strict=True)]
            own = pa.compute.index_in(lists["term"].combine_chunks(), named.dictionary)
            own = own if isinstance(own, pa.Array) else own.chunk(0)
            asked = lists["asked"].combine_chunks()
            asked = asked if isinstance(asked, pa.Array) else asked.chunk(0)
            owner = np.repeat(own.to_numpy(), asked.value_lengths().to_numpy())
            flat = asked.flatten()
            weight = flat.field(1).to_numpy()
            coded = flat.field(0).dictionary_encode(null_encoding="encode")
            query = coded.indices.to_numpy()
            order = np.argsort(query, kind="stable")
            scores, touched = np.zeros(len(numbers)), np.zeros(len(numbers), bool)
            ids, at, best = [], [], []
            for rows in np.split(order, np.flatnonzero(np.diff(query[order])) + 1):
                scores[:], touched[:] = 0.0, False
                for term, w in zip(owner[rows].tolist(), weight[rows].tolist(), strict=True):
                    spots = local[spans[term]]
                    if repeats.num_rows:
                        np.add.at(scores, spots, base[spans[term]] * w)
                    else:
                        scores[spots] += base[spans[term]] * w
                    touched[spots] = True
                total, number = scores[touched], numbers[touched]
                if grouped:  # the best chunk of each file; files are runs
                    file = number >> CHUNK_BITS
                    first = np.flatnonzero(np.append(True, file[1:] != file[:-1]))
                    total, number = np.maximum.reduceat(total, first), file[first]
                if limit is not None and len(total) > limit:  # only those that rounding can bring among the best are sorted
                    least = np.partition(total, len(total) - limit)[len(total) - limit] - 2 * 10.0**-rt.DIGITS
                    total, number = total[total >= least], number[total >= least]
                total = rounded(total)
                if limit is not None and len(total) > limit:
                    keep = np.lexsort((number, -total))[:limit]
                    total, number = total[keep], number[keep]
                ids.append(np.full(len(total), query[rows[0]]))
                at.append(number)
                best.append(total)
            names = coded.dictionary.take(pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([names, pa.array(np.concatenate(at)), pa.array(np.concatenate(best))], ["query_id", "doc", "score"])

    return run


def _weights(counts: DataFrame, wanted: DataFrame, idf: Column) -> DataFrame:
    return wanted.join(counts, "term").select("query_id", "term", (F.col("qtf") * idf).alias("weight"))


def _top(scored: DataFrame, limit: int, order: str = "doc") -> DataFrame:
    return rt.top(scored, limit, order)


def _named(scored: DataFrame, index: Index, position: Column) -> DataFrame:
    """Add file_path; ``scored`` is small (the best rows)."""
    return scored.withColumn("position", position).join(index.files.select("position", "file_path"), "position").drop("position")


def search_chunks(
    index: Index, queries: DataFrame, limit: int, query: str = "query", field: Field = CHUNKS, merged: bool = False
) -> DataFrame:
    """Top chunks per query (query_id, file_path, chunk_index, score, rank); underscored tokens are phrases.

    With ``merged`` the rows of a repeated path are one document, as in ``retrieval.search_chunks``.
    """
    postings = index.field(field)
    wanted = stage(rt.phrase_terms(queries, query), "query-phrases")
    blocks, counts = postings.of_terms(wanted)
    df = F.col("df")
    idf = F.log((postings.rows - df + 0.5) / (df + 0.5))
    weights = _weights(counts, wanted, F.when(idf <= 0, 1e-6).otherwise(idf))
    best = stage(_top(postings.best(blocks, weights, 1.2, 0.75, limit, merged=merged), limit), "chunk-hits")
    chunk = F.col("doc").bitwiseAND((1 << CHUNK_BITS) - 1).cast("int")
    named = _named(best, index, F.shiftright("doc", CHUNK_BITS))
    return named.select("query_id", "file_path", chunk.alias("chunk_index"), "score", "rank")


def hit_files(index: Index, hits: DataFrame) -> DataFrame:
    """Stored rows of the files among ``hits`` (file_path, ...); no other text is moved or written."""
    paths = bounded(hits.select("file_path").distinct())
    return stage(index.rows.drop("position", "first").join(paths, "file_path", "left_semi"), "hit-files")


def rank_simple(index: Index, queries: DataFrame, limit: int, field: Field = FOLDED_DOCUMENTS) -> DataFrame:
    """Document ranking with the smoothed idf; documents that share no term are left out."""
    postings = index.field(field)
    wanted = stage(rt.query_terms(queries, tx.folded_tokens("query")), "query-terms")
    blocks, counts = postings.of_terms(wanted)
    df = F.col("df")
    weights = _weights(counts, wanted, F.log1p((postings.rows - df + 0.5) / (df + 0.5)))
    best = stage(_top(postings.best(blocks, weights, 1.5, 0.75, limit), limit), "simple-hits")
    return _named(best, index, F.shiftright("doc", CHUNK_BITS)).select("query_id", "file_path", "score", "rank")


def search_stemmed(index: Index, queries: DataFrame, limit: int, query: str = "query", field: Field = DOCUMENTS) -> DataFrame:
    """Documents that hold any inflected form of a query word: (query_id, file_path, score, rank).

    A stem is weighed as one term: its frequency in a document is that of all its forms. A
    query word takes part by its stem, whether or not the corpus has that very form.
    """
    postings = index.field(field)
    asked = stemming.with_stems(rt.query_terms(queries, tx.tokens(query)))
    wanted = stage(asked.groupBy("query_id", "stem").agg(F.sum("qtf").alias("qtf")), "query-stems")
    blocks = stage(postings.of_stems(wanted), "stem-blocks")
    counts = blocks.groupBy("term").agg(F.sum("n").alias("df"))
    df = F.col("df")
    idf = F.log1p((postings.rows - df + 0.5) / (df + 0.5))
    weights = _weights(counts, wanted.withColumnRenamed("stem", "term"), idf)
    best = stage(_top(postings.best(blocks, weights, 1.5, 0.75, limit), limit), "stemmed-hits")
    return _named(best, index, F.shiftright("doc", CHUNK_BITS)).select("query_id", "file_path", "score", "rank")


def search_relevant_documents(index: Index, queries: DataFrame, limit: int = 3, field: Field = FOLDED_CHUNKS) -> DataFrame:
    """Chunk ranking rolled up to documents; token overlap replaces a query's all-zero scores."""
    postings = index.field(field)
    wanted = stage(rt.query_terms(queries, tx.folded_tokens("query")), "query-terms")
    blocks, counts = postings.of_terms(wanted)
    df = F.col("df")
    weights = _weights(counts, wanted, F.log1p((postings.rows - df + 0.5) / (df + 0.5)))
    scored = postings.best(blocks, weights, 1.5, 0.75, limit, grouped=True).where(F.col("score") > 0)
    best = stage(_top(scored, limit).drop("rank"), "relevant")
    missed = queries.select("query_id").distinct().join(best.select("query_id").distinct(), "query_id", "left_anti")
    if not missed.isEmpty():
        # k1 = 0 counts a term once per chunk: the score is the number of shared terms.
        ones = wanted.join(missed, "query_id", "left_semi").select("query_id", "term", F.lit(1.0).alias("weight"))
        overlap = stage(_top(postings.best(blocks, ones, 0.0, 0.0, limit, grouped=True), limit).drop("rank"), "overlap")
        none = missed.join(overlap.select("query_id").distinct(), "query_id", "left_anti")
        first = index.files.agg(F.min("position")).scalar()
        empty = none.select("query_id", first.alias("doc"), F.lit(0.0).alias("score")).where(F.col("doc").isNotNull())
        best = best.unionByName(overlap).unionByName(empty)
    return _named(_top(best, limit), index, F.col("doc")).select("query_id", "file_path", "score", "rank")


def rank_documents(index: Index, queries: DataFrame, limit: int, query: str = "query", field: Field = DOCUMENTS) -> DataFrame:
    """Okapi ranking with exactly ``limit`` rows per query if there are that many documents.

    Documents without a hit score zero and fill the list in path order; when none scores at
    all the list is the last documents in path order. Only queries with fewer than ``limit``
    positive scores, or so short that file names count, are scored in full.
    """
    postings = index.field(field)
    wanted = stage(rt.query_terms(queries, tx.tokens(query)), "query-terms")
    blocks, counts = postings.of_terms(wanted)
    df = F.col("df")
    idf = F.log(postings.rows - df + 0.5) - F.log(df + 0.5)
    weights = stage(_weights(counts, wanted, F.when(idf < 0, 0.25 * postings.mean_idf).otherwise(idf)), "weights")
    scored = postings.best(blocks, weights, 1.5, 0.75, limit).where(F.col("score") != 0)
    best = stage(_top(scored, limit), "document-hits")
    files = index.files.where("has_word").select("position", "file_path")
    found = best.groupBy("query_id").agg(F.count_if(F.col("score") > 0).alias("positive"))
    short = queries.select("query_id").distinct().join(found, "query_id", "left").where(F.coalesce("positive", F.lit(0)) < limit)
    brief = wanted.groupBy("query_id").agg(F.sum("qtf").alias("n")).where(F.col("n") < rt.SHORT_QUERY_TOKENS)
    special = stage(short.select("query_id").union(brief.select("query_id")).distinct(), "special-queries")
    out = _named(best, index, F.shiftright("doc", CHUNK_BITS)).select("query_id", "file_path", "score", "rank")
    if special.isEmpty():
        return out
    mine = weights.join(special, "query_id", "left_semi")
    full = postings.best(blocks, mine, 1.5, 0.75, None).where(F.col("score") != 0)
    full = stage(full.select("query_id", F.shiftright("doc", CHUNK_BITS).alias("position"), "score"), "special-scores")
    boosts = (
        files.select("position", F.explode(F.array_distinct(tx.tokens(F.concat("file_path", F.lit(" "), tx.file_name("file_path"))))).alias("term"))
        .join(wanted.join(brief, "query_id", "left_semi").select("query_id", "term"), "term")
        .select("query_id", "position", F.lit(rt.PATH_BOOST).alias("score"))
        .distinct()
    )
    full = stage(full.unionByName(boosts.join(full, ["query_id", "position"], "left_anti")), "special-scores")
    seen = full.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    lists = stage(special.join(seen, "query_id", "left"), "special-counts")
    most = lists.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    # Among the first limit + n documents at least ``limit`` have no score of their own.
    ends = lambda order, k: files.orderBy(order).limit(k).agg(F.array_sort(F.collect_list("position"))).scalar()
    filler = F.explode(F.when(F.col("n").isNull(), ends(F.desc("position"), limit)).otherwise(ends("position", limit + most)))
    zeros = lists.select("query_id", filler.alias("position")).join(full, ["query_id", "position"], "left_anti")
    padded = rt.top(full.unionByName(zeros.withColumn("score", F.lit(0.0))), limit, "position")
    named = padded.join(files, "position").select("query_id", "file_path", "score", "rank")
    return out.join(special, "query_id", "left_anti").unionByName(named)


def hybrid(index: Index, queries: DataFrame, limit: int = 10) -> DataFrame:
    """Hybrid retrieval (see ``retrieval.hybrid``) from an index whose ``files`` keep ``metadata``."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    asked = queries.where(tx.strip("query") != "").select("query_id", rt.expand_query("query").alias("query"))
    expanded = stage(asked, "queries")
    fetch = limit * rt.OVERFETCH
    fts = stage(rt.chunk_hits_to_documents(search_chunks(index, expanded, fetch)), "fts-documents")
    bm25 = stage(rank_documents(index, expanded, fetch), "bm25-documents")
    return rt.fused_ranking(fts, bm25, index.files, expanded, limit)
