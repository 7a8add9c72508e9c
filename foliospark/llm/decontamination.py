"""Benchmark decontamination with a distributed positional inverted index.

The index is partitioned by document: a shard holds consecutive documents of one task
and, for every term that the benchmark uses, the sorted list of its positions in the
shard. Shards are written to the shared folder and queried there. A window of
benchmark words is looked up by intersecting the position lists of its terms, each
moved back by the term's offset, from the shortest list on; a term that the shard
lacks ends the look-up at once. With ``slop`` above zero a term may stand that many
words from its place (proximity match).

The benchmark is taken in blocks of at most ``BLOCK`` windows, so what is sent to
the tasks has a fixed bound; each block has its own index.

Nulls and odd input: a null or wordless text has no words and no hits; a null item id
counts as the empty string; a null document id is carried along; repeated document
rows are reported each for itself, repeated items count once per id; an empty
benchmark leaves every document clean; an empty table gives an empty report; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from foliospark.llm.common import Scratch, free_name, texts

WINDOW = 10
#: Windows of the benchmark that are sent to the tasks at once.
BLOCK = 200_000
#: Words after which a shard is closed; a document is never split.
SHARD_WORDS = 1 << 17

#: A-Z become a-z; what is neither a letter, a digit nor above U+007F separates words.
_WORD_BYTES = bytes(
    b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def _windows(size: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                found = words(text)
                spans = [found[i : i + size] for i in range(max(1, len(found) - size + 1))] if found else []
                for at in range(0, len(spans), 10_000):
                    part = spans[at : at + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(part), pa.string()), pa.array(part, pa.list_(pa.binary()))], ["item", "words"]
                    )

    return cut


def benchmark_windows(items: DataFrame, key: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(item, words): the windows of each item; an item shorter than a window is one window."""
    named = items.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return named.mapInArrow(_windows(size), "item string, words array<binary>").distinct()


def _post(vocabulary):
    """Rows (id, text) -> shards of the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        task, serial = TaskContext.get().partitionId() << 33, 0
        ids: list[pa.Array] = []
        lengths: list[int] = []
        codes: list[np.ndarray] = []

        def shard() -> pa.RecordBatch:
            nonlocal serial
            sizes = np.array(lengths, np.int64)
            starts = np.cumsum(sizes + 1) - (sizes + 1)  # an empty place between documents
            flat = np.full(int((sizes + 1).sum()), -1, np.int32)
            for start, code in zip(starts.tolist(), codes, strict=True):
                flat[start : start + len(code)] = code
            places = np.flatnonzero(flat >= 0)
            places = places[np.argsort(flat[places], kind="stable")]
            terms, counts = np.unique(flat[places], return_counts=True)
            rows = task + serial + np.arange(len(sizes))
            serial += len(sizes)
            column = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
            keys = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                    column(rows, pa.int64()), column(starts, pa.int64()), column(sizes, pa.int64()),
                    column(terms, pa.int32()), column(np.cumsum(counts), pa.int64()), column(places, pa.int64()),
                ],
                ["ids", "rows", "starts", "sizes", "terms", "stops", "places"],
            )

        words_held = 0
        for batch in batches:
            for i, text in enumerate(texts(batch.column(1))):
                found = words(text)
                ids.append(batch.column(0).slice(i, 1))
                lengths.append(len(found))
                codes.append(np.fromiter((number(w, -1) for w in found), np.int32, len(found)))
                words_held += len(found)
                if words_held >= SHARD_WORDS or len(ids) >= 20_000:
                    yield shard()
                    ids, lengths, codes, words_held = [], [], [], 0
        if ids:
            yield shard()

    return run


def build_index(docs: DataFrame, vocabulary, scratch: Scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards. ``vocabulary`` is a broadcast {term: number}; other terms need no postings."""
    kind = docs.schema[key].dataType.simpleString()
    schema = (
        f"ids array<{kind}>, rows array<bigint>, starts array<bigint>, sizes array<bigint>, "
        "terms array<int>, stops array<bigint>, places array<bigint>"
    )
    return scratch.put(docs.select(key, text).mapInArrow(_post(vocabulary), schema), "index")


def _intersect(lists: list[np.ndarray], offsets: np.ndarray, slop: int) -> np.ndarray:
    """Starts at which every list has its offset; ``lists`` are sorted, the shortest is first."""
    starts = lists[0] - offsets[0]
    for places, offset in zip(lists[1:], offsets[1:], strict=True):
        at = np.searchsorted(places, starts + (offset - slop))
        found = places[np.minimum(at, len(places) - 1)]
        starts = starts[(at < len(places)) & (found <= starts + (offset + slop))]
        if not len(starts):
            break
    return starts


def _look_up(windows, slop: int):
    """Shards -> (row, item, start, stop): runs of words of a document that lie in windows of the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, sizes, codes = windows.value
        places_of = np.arange(codes.shape[1])[None, :] < sizes[:, None] if len(codes) else None
        for batch in batches:
            for i in range(batch.num_rows):
                rows, starts, lengths, terms, stops, places = (batch.column(c)[i].values.to_numpy() for c in range(1, 7))
                if not len(terms) or not len(codes):
                    continue
                slot = np.full(int(codes.max()) + 2, -1, np.int64)
                slot[terms] = np.arange(len(terms))
                begins = np.concatenate([[0], stops[:-1]])
                counts = stops - begins
                hits: list[tuple[int, int, int]] = []
                for w in np.flatnonzero(((slot[codes] >= 0) | ~places_of).all(axis=1)).tolist():
                    size = int(sizes[w])
                    mine = slot[codes[w, :size]]
                    order = np.argsort(counts[mine], kind="stable")
                    lists = [places[begins[s] : stops[s]] for s in mine[order].tolist()]
                    found = _intersect(lists, order, slop)
                    hits.extend((items[w], s, size) for s in found.tolist())
                if hits:
                    yield from _runs(hits, rows, starts, lengths)

    return run


def _runs(hits, rows, starts, lengths) -> Iterator[pa.RecordBatch]:
    """Joins the overlapping hits of one item in one document; cuts what slop moved beyond the text."""
    out: dict[tuple[int, str], list[list[int]]] = {}
    for item, start, size in sorted(hits, key=lambda h: h[1]):
        doc = int(np.searchsorted(starts, max(start, 0), side="right")) - 1
        low = max(start - int(starts[doc]), 0)
        high = min(start - int(starts[doc]) + size, int(lengths[doc]))
        spans = out.setdefault((int(rows[doc]), item), [])
        if spans and low <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], high)
        elif low < high:
            spans.append([low, high])
    flat = [(r, item, a, b) for (r, item), spans in out.items() for a, b in spans]
    for at in range(0, len(flat), 50_000):
        columns = zip(*flat[at : at + 50_000], strict=True)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row", "item", "start", "stop"]
        )


def _block(windows: DataFrame):
    """The windows of one block as arrays over the block's own vocabulary."""
    rows = windows.toArrow()
    items = rows.column("item").to_pylist()
    listed = rows.column("words").to_pylist()
    vocabulary: dict[bytes, int] = {}
    sizes = np.array([len(x) for x in listed], np.int64)
    codes = np.zeros((len(listed), max(sizes, default=1)), np.int64)
    for i, found in enumerate(listed):
        codes[i, : len(found)] = [vocabulary.setdefault(w, len(vocabulary)) for w in found]
    return vocabulary, (items, sizes, codes)


def matches(
    docs: DataFrame, windows: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", slop: int = 0, block: int = BLOCK
) -> tuple[DataFrame, DataFrame]:
    """(documents, matches).

    documents: row, id, n_words for every input row. matches: row, item, start, stop
    (word positions, stop excluded), disjoint for each row and item. With ``slop`` = 0
    the matches are exact phrases.
    """
    context = docs.sparkSession.sparkContext
    windows = scratch.put(windows, "windows")
    blocks = max(1, -(-windows.count() // block))
    if blocks > 1:
        # Rows are numbered by place of reading. Every block must read the same places, so they are written once.
        docs = scratch.put(docs.select(key, text), "documents")
    documents = found = None
    for b in range(blocks):
        vocabulary, arrays = _block(windows.where(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == b))
        index = build_index(docs, context.broadcast(vocabulary), scratch, key, text)
        part = index.mapInArrow(_look_up(context.broadcast(arrays), slop), "row bigint, item string, start bigint, stop bigint")
        found = part if found is None else found.unionAll(part)
        if documents is None:
            documents = index.select(F.explode(F.arrays_zip("ids", "rows", "sizes")).alias("d")).select(
                F.col("d.rows").alias("row"), F.col("d.ids").alias("id"), F.col("d.sizes").alias("n_words")
            )
    return documents, scratch.put(found, "matches")


def covered(spans: str):
    """Words covered by an array of (start, stop) spans that may overlap."""
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("reach"))
    step = lambda acc, s: F.struct(
        (acc["total"] + F.greatest(F.lit(0).cast("long"), s["stop"] - F.greatest(acc["reach"], s["start"]))).alias("total"),
        F.greatest(acc["reach"], s["stop"]).alias("reach"),
    )
    return F.aggregate(F.array_sort(spans), start, step, lambda acc: acc["total"])


def report(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """(``key``, n_words, n_hit, items, contaminated) for every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "decontamination")
    documents, found = matches(docs, benchmark_windows(benchmark, item_key, item_text), scratch, key, text)
    hits = found.groupBy("row").agg(
        F.collect_list(F.struct("start", "stop")).alias("spans"), F.array_sort(F.collect_set("item")).alias("items")
    )
    return documents.join(hits, "row", "left").select(
        F.col("id").alias(key),
        "n_words",
        F.coalesce(covered("spans"), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("spans").isNotNull().alias("contaminated"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any hit, with their columns.

    A row is named by its id and a hash of its text. The names of the rows with hits are
    written, so Spark knows their size: a few are sent to the tasks and no text moves.
    """
    scratch = Scratch(docs.sparkSession, "decontamination-keep")
    mark = free_name(docs, "decontamination_row")
    named = docs.withColumn(mark, F.concat_ws("|", F.xxhash64(text), F.col(key).isNull(), F.col(key).cast("string")))
    documents, found = matches(named, benchmark_windows(benchmark), scratch, mark, text)
    dirty = documents.join(found.select("row").distinct(), "row", "left_semi").select(F.col("id").alias(mark)).distinct()
    dirty = scratch.put(dirty, "dirty")
    scratch.clear(dirty)
    return named.join(dirty, mark, "left_anti").drop(mark)
