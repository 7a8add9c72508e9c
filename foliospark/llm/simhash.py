"""Near duplicates by 64-bit SimHash, compared bit-sliced.

1. A fingerprint per text, from all its word shingles.
2. Equal fingerprints fall together; from here on there is one row per fingerprint.
3. Fingerprints that differ in at most ``radius`` bits agree in ``agree`` of ``radius + agree``
   bit ranges, so each is filed under every choice of so many ranges. No link is lost.
4. Inside a file the fingerprints stand as vertical bit planes. One machine word holds
   the same bit of 64 fingerprints; carry-save counters update 64 distances at a
   time, and a block is given up once all 64 exceed the radius.
5. Each task returns a spanning forest of the links it found, never all pairs, and
   the forests are joined to components.

Files above ``TILE`` fingerprints are cut into chunks and compared chunk against
chunk, so no task gets a whole file.

``keep_one`` looks for near copies (about 0.8 of the five-word shingles in common) and
not for equal fingerprints only: its texts link within ``NEAR_RADIUS`` bits, if 128 more
bits of the same shingles agree as well (``NEAR_BITS`` of all 192 may differ). Both are
tested by the task that holds the pair; the further bits travel with the fingerprint.
Texts with equal 64 bits are one class. Larger ``agree`` means more, but smaller files and
never another result.

Nulls and odd input: null, empty or blank texts have fingerprint zero and link like
any other; rows with a null id get a fingerprint and a component, but no id can be the
null one; repeated rows share both; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from foliospark.llm.common import Scratch, columns_of, free_name, texts, words
from foliospark.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
AGREE = 2
TILE = 1024
#: ``keep_one``: bits of the fingerprint that may differ, and of its three words of 64 bits together.
NEAR_RADIUS, NEAR_BITS, WORDS = 8, 27, 3
#: Fingerprint-and-block pairs compared in one go; bounds the memory of a task.
ITEMS = 1 << 13
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _scrambled(hashes: np.ndarray, word: int) -> np.ndarray:
    """Further 64 bits of each hash; word 0 is the hash itself."""
    if not word:
        return hashes
    mixed = hashes ^ np.uint64(word * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(odd)
    return mixed ^ (mixed >> np.uint64(31))


def fingerprint(text: bytes) -> int:
    """SimHash of the word shingles of one text: bit b is set if more than half the hashes have it."""
    return fingerprints(text, 1)[0]


def fingerprints(text: bytes, n_words: int = WORDS) -> list[int]:
    """The fingerprint and ``n_words`` - 1 further words of 64 bits from the same shingles."""
    tokens = words(text)
    if not tokens:
        return [0] * n_words
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(tokens) < SHINGLE:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: -(SHINGLE - 1)], ends[SHINGLE - 1 :]
    digest = xxhash.xxh64_digest
    ones = np.zeros((n_words, 64), np.int64)
    for at in range(0, len(starts), 1 << 15):
        spans = zip(starts[at : at + (1 << 15)].tolist(), ends[at : at + (1 << 15)].tolist(), strict=True)
        hashes = np.frombuffer(b"".join([digest(joined[i:j], SEED) for i, j in spans]), ">u8").astype(np.uint64)
        for k in range(n_words):
            bits = np.unpackbits(_scrambled(hashes, k).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones[k] += bits.sum(axis=0, dtype=np.int64)
    return [int.from_bytes(np.packbits(row).tobytes(), "big", signed=True) for row in 2 * ones > len(starts)]


@F.arrow_udf(T.LongType())
def _fingerprints(column: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t) for t in texts(column)], pa.int64())


@F.arrow_udf(T.ArrayType(T.LongType()))
def _wide_fingerprints(column: pa.Array) -> pa.Array:
    return pa.array([fingerprints(t) for t in texts(column)], pa.list_(pa.int64()))


def fingerprint_of(text: Column | str) -> Column:
    """The fingerprint as a signed 64-bit number."""
    return _fingerprints(F.col(text) if isinstance(text, str) else text)


def as_hex(print_: Column | str) -> Column:
    """16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(print_), 16, "0"))


def planes_of(prints: np.ndarray) -> np.ndarray:
    """64 rows, most significant bit first; row b holds bit b of all fingerprints, 64 to a word."""
    bits = np.unpackbits(prints.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).T
    packed = np.packbits(bits, axis=1, bitorder="little")
    width = -(-packed.shape[1] // 8) * 8
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, width - packed.shape[1])))).view(np.uint64)


def sliced_links(groups: np.ndarray, prints: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i < j, of one group whose fingerprints differ in at most ``radius`` bits.

    ``groups`` is sorted. A unit of work is one fingerprint against one block of 64;
    units whose 64 distances all exceed the radius are dropped on the way.
    """
    n = len(prints)
    planes = planes_of(prints)
    stops = np.searchsorted(groups, groups, side="right")
    first, last = (np.arange(n) + 1) >> 6, (stops - 1) >> 6
    spans = np.where(stops > np.arange(n) + 1, last - first + 1, 0)
    rows = np.repeat(np.arange(n), spans)
    blocks = np.arange(len(rows)) - np.repeat(np.cumsum(spans) - spans, spans) + first[rows]
    levels = int(radius).bit_length()
    ahead = (1 << levels) - 1 - radius  # counters start here, so that they overflow beyond the radius
    for at in range(0, len(rows), ITEMS):
        row, block = rows[at : at + ITEMS], blocks[at : at + ITEMS]
        low = np.clip(row + 1 - 64 * block, 0, 64).astype(np.uint64)
        high = np.clip(stops[row] - 64 * block, 0, 64).astype(np.uint64)
        below = lambda k: np.where(k == 64, FULL, (np.uint64(1) << (k & np.uint64(63))) - np.uint64(1))
        beyond = ~(below(high) & ~below(low))
        counters = [np.full(len(row), FULL if ahead >> k & 1 else 0, np.uint64) for k in range(levels)]
        values = prints[row]
        for b in range(64):
            own = np.uint64(0) - ((values >> np.uint64(63 - b)) & np.uint64(1))
            carry = planes[b][block] ^ own
            for k in range(levels):
                counters[k], carry = counters[k] ^ carry, counters[k] & carry
            beyond |= carry
            if b % 8 == 7:
                alive = beyond != FULL
                if not alive.all():
                    row, block, beyond, values = row[alive], block[alive], beyond[alive], values[alive]
                    counters = [c[alive] for c in counters]
                if not len(row):
                    break
        if len(row):
            unit, bit = np.nonzero(np.unpackbits((~beyond).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield row[unit], 64 * block[unit] + bit


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n nodes the smallest node linked to it, directly or through others."""
    root = np.arange(n)
    for i, j in links:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            np.minimum.at(root, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
            while (root[root] != root).any():
                root = root[root]
            i, j = i[apart], j[apart]
    return root


def _close(links: Iterator[tuple[np.ndarray, np.ndarray]], wide: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The links whose ``wide`` rows differ in at most ``most`` bits."""
    for i, j in links:
        near = np.bitwise_count(wide[i] ^ wide[j]).sum(axis=1) <= most
        yield i[near], j[near]


def _compare(radius: int, most: int | None):
    """Rows (file, low, high, print, further words) sorted by tile -> edges of spanning forests."""

    def edges(rows: np.ndarray) -> pa.RecordBatch:
        wide = np.ascontiguousarray(rows[:, 3:]).view(np.uint64)
        links = sliced_links(_numbered(rows[:, :3]), np.ascontiguousarray(wide[:, 0]), radius)
        root = forest(len(rows), links if most is None else _close(links, wide, most))
        off = root != np.arange(len(root))
        return pa.RecordBatch.from_arrays([pa.array(rows[off, 3]), pa.array(rows[root[off], 3])], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1))
            if sum(map(len, held)) < 1 << 15:
                continue
            rows = np.concatenate(held)
            # The last tile may go on in the next batch.
            ends = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            cut = int(ends[-1]) if len(ends) else 0
            held = [rows[cut:]]
            if cut:
                yield edges(rows[:cut])
        if held and sum(map(len, held)):
            yield edges(np.concatenate(held))

    return run


def _numbered(keys: np.ndarray) -> np.ndarray:
    changes = (keys[1:] != keys[:-1]).any(axis=1)
    return np.concatenate([[0], np.cumsum(changes)])


def _ranges(parts: int) -> list[tuple[int, int]]:
    """``parts`` ranges (shift, width) that cover the 64 bits."""
    cuts = [64 * k // parts for k in range(parts + 1)]
    return [(cuts[k], cuts[k + 1] - cuts[k]) for k in range(parts)]


def linked(
    prints: DataFrame, scratch: Scratch, radius: int = RADIUS, tile: int = TILE, agree: int = AGREE, most: int | None = None
) -> DataFrame:
    """Edges (u, v) that connect all fingerprints within ``radius`` of each other.

    ``prints`` has a column ``print`` of distinct fingerprints. With ``most`` all its other
    columns are further words, and no more than ``most`` bits of a linked pair differ in all.
    """
    words_ = ["print", *(c for c in prints.columns if c != "print" and most is not None)]
    part = lambda r: F.shiftrightunsigned("print", r[0]).bitwiseAND(F.lit((1 << r[1]) - 1))
    put = lambda key, r: F.shiftleft(key, r[1]).bitwiseOR(part(r))
    files = [
        F.shiftleft(reduce(put, chosen[1:], part(chosen[0])), 10).bitwiseOR(F.lit(k))
        for k, chosen in enumerate(combinations(_ranges(radius + agree), agree))
    ]
    filed = scratch.put(prints.select(*words_, F.explode(F.array(*files)).alias("file")), "files")
    sizes = filed.groupBy("file").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    chunks = F.ceil(F.col("n") / tile).cast("int")
    chunk = F.pmod(F.xxhash64("print"), F.col("chunks")).cast("int")
    others = F.when(F.col("chunks") == 1, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda k: k != F.col("chunk"))
    )
    tiles = (
        filed.join(sizes, "file")
        .withColumn("chunks", chunks)
        .withColumn("chunk", chunk)
        .select("file", *words_, "chunk", F.explode(others).alias("other"))
        .select("file", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), *words_)
    )
    dealt = tiles.repartition("file", "low", "high").sortWithinPartitions("file", "low", "high")
    return dealt.mapInArrow(_compare(radius, most), "u bigint, v bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = RADIUS) -> DataFrame:
    """(``key``, fingerprint, component_id, n_linked) for every row of ``docs``.

    ``component_id`` is the smallest non-null id that can be reached over links;
    ``n_linked`` the number of rows in the component.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.put(docs.select(F.col(key).alias("id"), fingerprint_of(text).alias("print")), "prints")
    found = _components(rows, scratch, radius)
    return rows.join(found, "print").select(
        F.col("id").alias(key), as_hex("print").alias("fingerprint"), "component_id", "n_linked"
    )


def _components(rows: DataFrame, scratch: Scratch, radius: int) -> DataFrame:
    """(print, component_id, n_linked) for each distinct fingerprint of ``rows`` (id, print)."""
    distinct = scratch.put(
        rows.groupBy("print").agg(F.min("id").alias("least_id"), F.count(F.lit(1)).alias("copies")), "distinct"
    )
    stars = components(linked(distinct.select("print"), scratch, radius), scratch)
    named = distinct.join(stars.withColumnRenamed("node", "print"), "print", "left").select(
        "print", F.coalesce("component", "print").alias("component"), "least_id", "copies"
    )
    least = named.groupBy("component").agg(F.min("least_id").alias("component_id"), F.sum("copies").alias("n_linked"))
    return scratch.put(named.select("print", "component").join(least, "component").drop("component"), "components")


def keep_one(
    docs: DataFrame, key: str = "doc_id", text: str = "text", radius: int = NEAR_RADIUS, most: int = NEAR_BITS
) -> DataFrame:
    """One row of ``docs`` for each component: that of the smallest id (a null id counts as the largest).

    Texts link if their fingerprints differ in at most ``radius`` bits and, with the further
    words, in at most ``most``. Of texts with one fingerprint the least further words count.

    The choice is made on (id, fingerprint) alone; texts are read a second time, and move
    once, to the row that their id and fingerprint name. Of rows equal in both one stays;
    all but one of them are left out before anything moves.
    """
    scratch = Scratch(docs.sparkSession, "simhash-keep")
    mark = free_name(docs, "simhash_row")
    name = lambda one: F.struct(
        one.alias("print"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.col(key).isNull().alias("no_id")
    )
    wide = free_name(docs, "simhash_words")
    printed = docs.select(key, _wide_fingerprints(F.col(text)).alias(wide))
    narrow = scratch.put(printed.select(F.col(key).alias("id"), name(F.col(wide)[0]).alias("name"), F.col(wide).alias("words")), "prints")
    further = [F.col("words")[k].alias(f"w{k}") for k in range(1, WORDS)]
    heads = narrow.groupBy(F.col("name.print").alias("print")).agg(
        F.min(F.struct(F.col("id").isNull(), "id", "name")).alias("head"), F.min("words").alias("words")
    )
    distinct = scratch.put(heads, "distinct")
    stars = components(linked(distinct.select("print", *further), scratch, radius, most=most), scratch)
    named = distinct.join(stars.withColumnRenamed("node", "print"), "print", "left")
    chosen = named.groupBy(F.coalesce("component", "print")).agg(F.min("head").alias("head")).select(F.col("head.name").alias(mark))
    kept = scratch.put(chosen, "kept")
    scratch.clear(kept)
    rows = docs.withColumn(mark, name(fingerprint_of(text)))
    # A filter on the first row lets tasks drop the others before the shuffle; the join needs no other one.
    first = rows.withColumn(f"{mark}_n", F.row_number().over(Window.partitionBy(mark).orderBy(mark))).where(F.col(f"{mark}_n") == 1)
    return first.join(kept, mark, "left_semi").select(*columns_of(docs))
