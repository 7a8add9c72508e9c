"""Removal of repeated passages with a logarithmic family of suffix arrays.

A passage of ``SPAN`` bytes is removed wherever it starts later than somewhere else: in a
document with a larger id, or further on in the same one. The work is that of an index
which grows batch by batch:

* **A batch** is what a task reads, about ``BATCH`` suffixes at a time. Its suffixes are
  sorted by their first ``GRAM`` bytes, equal ones by a hash of what surrounds them: the
  batch's suffix array, cut by a hash of those bytes into shards.
* **Levels.** A shard holds arrays of growing size. A new array is merge-scanned against
  each of them; a suffix that a level has too is a long match, the later place of the two
  is reported and one entry stays. The rest becomes the smallest level, and as long as two
  levels are about equal in size they are merged, so an entry is moved a logarithmic
  number of times.

Not every suffix has to be in the arrays. In any ``SPAN`` bytes there is one place whose
``GRAM`` bytes have the smallest hash (the leftmost of equal ones); equal passages have it
at the same offset. A suffix that is such a place for the passages starting in [lo, hi]
stands for them all; one in forty or so does. An entry is (first bytes, hash of the zone
[lo, hi + SPAN), place): two equal entries decide all their passages at once. Entries with
equal first bytes in different zones (the ends of a copy, a common phrase) decide nothing
yet: the passages of the first entry of each zone go through the same levels once more,
this time with the suffix of every byte. A passage reaches at least ``HALF`` bytes to the
right of the first bytes or to the left, so only those go on whose ``HALF`` bytes on that
side (24 bits of a hash) stand in another zone too. That is exact, for any number of copies: nothing
is compared pairwise, a zone is kept once, and first bytes with more than ``HOT`` zones in
one batch (a phrase that a third of the rows hold) skip the first round, so a shard never
fills with them.

A zone counts as equal by its first bytes and a 64-bit hash of all its bytes.

Nulls and odd input: a null text is empty; rows with a null id come before all others and
rows with one id in the order of a hash of their texts; of repeated rows (id and text) one
is the first and the others repeat it; texts under ``SPAN`` bytes stay whole; an empty
table gives an empty result; other columns are not read. Spans are cut from bytes, so what
is kept need not be valid UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from foliospark.llm.common import Scratch, texts

SPAN = 100
GRAM = 24
#: Starts of ``GRAM`` bytes in a passage.
REACH = SPAN - GRAM + 1
#: Bytes that a passage has on one side of its first bytes, at least.
HALF = (SPAN - GRAM) // 2
#: Suffixes of one batch.
BATCH = 1 << 20
#: Bytes of text handled at once; longer texts are cut between passages.
PIECE = 1 << 19
#: Zones of equal first bytes in one batch from which on they go straight to the second round.
HOT = 64
#: Bytes of text for each shard, and the least number of shards for each shuffle partition.
SHARD_BYTES, SHARDS = 1 << 22, 3

_ENTRY = GRAM + 8
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_OWNER = ("known", "id", "tie")
_RUNS = "shard int, body binary"
_FOUND = "kind tinyint, known tinyint, id bigint, tie bigint, lo int, hi int"
REPEAT, OPEN = 0, 1
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Entries:
    """Columns of suffix entries: ``rec`` (first bytes and zone hash), owner and place.

    ``before`` and ``span`` say where its passages start: at - before to at - before + span.
    ``sides`` are the hashes of the halves to the right and left, 24 bits each.
    """

    NAMES = ("rec", "sides", "known", "id", "tie", "at", "before", "span", "open")
    KINDS = (f"S{_ENTRY}", "S6", "i1", "i8", "i8", "i4", "u1", "u1", "?")

    def __init__(self, *columns: np.ndarray):
        for name, column in zip(self.NAMES, columns, strict=True):
            setattr(self, name, column)

    def __len__(self) -> int:
        return len(self.rec)

    def columns(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in self.NAMES]

    def take(self, which) -> Entries:
        return Entries(*[c[which] for c in self.columns()])

    def packed(self) -> bytes:
        parts = [len(self).to_bytes(8, "little"), *[np.ascontiguousarray(c).tobytes() for c in self.columns()]]
        return zstandard.ZstdCompressor(level=3).compress(b"".join(parts))

    @classmethod
    def unpacked(cls, body: bytes) -> Entries:
        data = zstandard.ZstdDecompressor().decompress(body)
        n, at, columns = int.from_bytes(data[:8], "little"), 8, []
        for kind in cls.KINDS:
            column = np.frombuffer(data, kind, n, at)
            at += column.nbytes
            columns.append(column.copy())
        return cls(*columns)

    def grams(self) -> np.ndarray:
        return np.frombuffer(self.rec.tobytes(), np.uint8).reshape(-1, _ENTRY)[:, :GRAM]

    def found(self, kind: int, start: np.ndarray | None = None, stop: np.ndarray | None = None) -> pa.RecordBatch:
        """Rows (kind, owner, lo, hi): the starts of passages, by default all of an entry."""
        lo = self.at - self.before if start is None else start
        hi = lo + self.span if stop is None else stop
        values = [np.full(len(self), kind, np.int8), self.known, self.id, self.tie, lo, hi]
        kinds = (pa.int8(), pa.int8(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        columns = [pa.array(v, k) for v, k in zip(values, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["kind", *_OWNER, "lo", "hi"])


def _before(a: Entries, i: np.ndarray, b: Entries, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a[i] is earlier than b[j], the two are one place)."""
    less, same = np.zeros(len(i), bool), np.ones(len(i), bool)
    for name in (*_OWNER, "at"):
        x, y = getattr(a, name)[i], getattr(b, name)[j]
        less |= same & (x < y)
        same &= x == y
    return less, same


def _repeats_with(first: np.ndarray) -> np.ndarray:
    """For each row of a sorted table the number of the last row before it, or itself, that is ``first``."""
    return np.flatnonzero(first)[np.cumsum(first) - 1]


class Levels:
    """The arrays of one shard, largest first."""

    def __init__(self) -> None:
        self.levels: list[Entries] = []

    def add(self, new: Entries) -> Iterator[pa.RecordBatch]:
        """Merge-scan an array against all levels, then make it the smallest; yields repeats."""
        for level in self.levels:
            if not len(new):
                return
            spot = np.searchsorted(level.rec, new.rec)
            hit = np.flatnonzero(level.rec[np.minimum(spot, len(level) - 1)] == new.rec)
            if not len(hit):
                continue
            spot = spot[hit]
            less, same = _before(new, hit, level, spot)
            yield new.take(hit[~less & ~same]).found(REPEAT)
            level.open[spot] |= new.open[hit]
            earlier, later = hit[less], spot[less]
            if len(earlier):
                yield level.take(later).found(REPEAT)
                for name in Entries.NAMES[2:-1]:  # bytes and hashes are the same
                    getattr(level, name)[later] = getattr(new, name)[earlier]
            rest = np.ones(len(new), bool)
            rest[hit] = False
            new = new.take(rest)
        if len(new):
            self.levels.append(new)
            while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
                self.merge()

    def merge(self) -> None:
        """The two smallest levels, which have no entry in common, become one."""
        small, large = self.levels.pop(), self.levels.pop()
        spots = np.searchsorted(large.rec, small.rec) + np.arange(len(small))
        rest = np.ones(len(small) + len(large), bool)
        rest[spots] = False
        merged = []
        for x, y in zip(large.columns(), small.columns(), strict=True):
            column = np.empty(len(rest), x.dtype)
            column[rest], column[spots] = x, y
            merged.append(column)
        self.levels.append(Entries(*merged))

    def undecided(self) -> Iterator[pa.RecordBatch]:
        """The passages whose first bytes, and those of a half beside them, stand in more than one zone."""
        while len(self.levels) > 1:
            self.merge()
        if not self.levels:
            return
        whole = self.levels[0]
        gram = whole.grams()
        group = np.zeros(len(whole), np.int64)
        group[1:] = np.cumsum((gram[1:] != gram[:-1]).any(axis=1))
        # A marked entry stands for others that went on at once, so all with its first bytes follow.
        marked = (np.bincount(group, whole.open) > 0)[group]
        sides = np.frombuffer(whole.sides.tobytes(), np.uint8).reshape(-1, 6).astype(np.int64)
        start = (whole.at - whole.before).astype(np.int64)
        stop, turn = start + whole.span, whole.at.astype(np.int64) - HALF
        for k, lo, hi in ((0, np.maximum(start, turn), stop), (3, start, np.minimum(stop, turn - 1))):
            there = np.flatnonzero(lo <= hi)
            code = group[there] << 24 | sides[there, k] << 16 | sides[there, k + 1] << 8 | sides[there, k + 2]
            _, kind, count = np.unique(code, return_inverse=True, return_counts=True)
            there = there[(count[kind] > 1) | marked[there]]
            if len(there):
                yield whole.take(there).found(OPEN, lo[there], hi[there])


def _grow(decided: bool):
    """Rows (shard, body) sorted by shard -> what the levels of each shard find."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, levels = None, Levels()

        def last() -> Iterator[pa.RecordBatch]:
            if not decided:
                yield from levels.undecided()

        for batch in batches:
            shards = batch.column(0).to_pylist()
            for i, shard in enumerate(shards):
                body = batch.column(1)[i].as_py()
                if shard < 0:  # settled before: passed on
                    yield Entries.unpacked(body).found(REPEAT if shard == -1 else OPEN)
                    continue
                if shard != now:
                    yield from last()
                    now, levels = shard, Levels()
                yield from levels.add(Entries.unpacked(body))
        yield from last()

    return run


class Batch:
    """Collects suffix entries of documents and gives them out as shards of a sorted array."""

    def __init__(self, shards: int, decided: bool, hot: int = HOT):
        self.shards, self.decided, self.hot = shards, decided, hot
        self.owners: list[tuple] = []
        self.parts: list[tuple] = []
        self.size = 0

    def add(self, rec: np.ndarray, sides: np.ndarray, doc: np.ndarray, at: np.ndarray, before: np.ndarray, span: np.ndarray) -> None:
        self.parts.append((rec, sides, doc, at.astype(np.int32), before.astype(np.uint8), span.astype(np.uint8)))
        self.size += len(rec)

    def forget(self) -> None:
        """Drop the owners if no entry names one."""
        if not self.parts:
            self.owners = []

    def sorted(self) -> Entries:
        rec, sides, doc, at, before, span = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        known, ids, ties = (np.array(c, k) for c, k in zip(zip(*self.owners, strict=True), ("i1", "i8", "i8"), strict=True))
        rank = np.empty(len(known), np.int64)
        rank[np.lexsort((ties, ids, known))] = np.arange(len(known))
        order = np.lexsort((at, rank[doc]))
        order = order[np.argsort(rec[order], kind="stable")]
        doc = doc[order]
        rest = at[order], before[order], span[order], np.zeros(len(doc), bool)
        return Entries(rec[order], sides[order], known[doc], ids[doc], ties[doc], *rest)

    def shards_of(self) -> Iterator[pa.RecordBatch]:
        """The array, without what repeats inside the batch, one row for each shard."""
        if not self.parts:
            return
        whole = self.sorted()
        self.parts, self.size = [], 0
        out: list[tuple[int, bytes]] = []
        first = np.ones(len(whole), bool)
        first[1:] = whole.rec[1:] != whole.rec[:-1]
        head = _repeats_with(first)
        rows = np.flatnonzero(~first)
        _, same = _before(whole, rows, whole, head[rows])
        if len(rows):
            out.append((-1, whole.take(rows[~same]).packed()))
            whole = whole.take(first)
        if self.decided:
            words = np.frombuffer(whole.rec.tobytes(), "<u8").reshape(-1, _ENTRY // 8)[:, -1:]
        else:
            gram = whole.grams()
            fresh = np.ones(len(whole), bool)
            fresh[1:] = (gram[1:] != gram[:-1]).any(axis=1)
            sizes = np.diff(np.append(np.flatnonzero(fresh), len(whole)))
            many = np.repeat(sizes > self.hot, sizes)
            if many.any():  # one stays, marked, so that other batches learn of it
                out.append((-2, whole.take(many & ~fresh).packed()))
                whole.open |= many & fresh
                whole = whole.take(~many | fresh)
            words = np.frombuffer(whole.grams().tobytes(), "<u8").reshape(-1, GRAM // 8)
        mixed = np.zeros(len(whole), np.uint64)
        for k in range(words.shape[1]):
            mixed = (mixed ^ words[:, k]) * _MIX[3]
            mixed ^= mixed >> np.uint64(32)
        shard = (mixed % np.uint64(self.shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order], prepend=-1)).tolist() + [len(order)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            out.append((int(shard[order[a]]), whole.take(order[a:b]).packed()))
        for k in range(0, len(out), 256):
            numbers, bodies = zip(*out[k : k + 256], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(bodies, pa.binary())], ["shard", "body"])


def _hashes(view: memoryview, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Big-endian hashes, as rows of bytes, of the bytes between ``starts`` and ``stops``."""
    digest = xxhash.xxh3_64_intdigest
    made = (digest(view[s:e]) for s, e in zip(starts.tolist(), stops.tolist(), strict=True))
    return np.fromiter(made, np.uint64, len(starts)).astype(">u8").view(np.uint8).reshape(-1, 8)


def _records(data: np.ndarray, view: memoryview, at: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """First bytes at ``at`` and hash of the bytes between ``starts`` and ``stops``."""
    made = np.empty((len(at), _ENTRY), np.uint8)
    made[:, :GRAM] = np.lib.stride_tricks.sliding_window_view(data, GRAM)[at]
    made[:, GRAM:] = _hashes(view, starts, stops)
    return made.reshape(-1).view(f"S{_ENTRY}")


def chosen(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, lo, hi): the places that stand for passages, and the starts of those passages.

    ``valid`` lists the starts of passages in ``data``, in order.
    """
    n = len(data) - GRAM + 1
    value = np.zeros(n, np.uint64)
    for k in range(GRAM // 8):
        value ^= np.ndarray(n, "<u8", data, 8 * k, (1,)) * _MIX[k]
    value ^= value >> np.uint64(31)
    value *= _MIX[3]
    value &= np.uint64(0xFFFFFFFF00000000)
    value |= np.arange(n, dtype=np.uint64)  # the leftmost of equal ones
    width = 1
    while 2 * width <= REACH:
        value = np.minimum(value[:-width], value[width:])
        width *= 2
    value = np.minimum(value[: len(value) - (REACH - width)], value[REACH - width :])
    at = (value[valid] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.ones(len(at), bool)
    first[1:] = at[1:] != at[:-1]
    starts = np.flatnonzero(first)
    stops = np.append(starts[1:], len(at)) - 1
    return at[starts], valid[starts], valid[stops]


def _pieces(batch: pa.RecordBatch, owners: list[tuple], size: int) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """Bytes of several texts and, for each text, (owner, its first byte there, its offset, length)."""
    parts: list[bytes] = []
    spans: list[tuple[int, int, int, int]] = []
    held = 0
    keys = zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True)
    for owner, text in zip(keys, texts(batch.column(3)), strict=True):
        if len(text) < SPAN:
            continue
        owners.append(owner)
        for offset in range(0, len(text) - SPAN + 1, size):
            part = text[offset : offset + size + SPAN - 1]
            if held and held + len(part) > size:
                yield b"".join(parts), spans
                parts, spans, held = [], [], 0
            parts.append(part)
            spans.append((len(owners) - 1, held, offset, len(part)))
            held += len(part)
    if parts:
        yield b"".join(parts), spans


def _sparse(shards: int, size: int, piece: int, hot: int):
    """Rows (known, id, tie, text) -> shards of suffix arrays over the chosen places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Batch(shards, decided=False, hot=hot)
        for batch in batches:
            held.forget()
            for joined, spans in _pieces(batch, held.owners, piece):
                data = np.frombuffer(joined, np.uint8)
                valid = np.concatenate([np.arange(s, s + n - SPAN + 1) for _, s, _, n in spans])
                at, lo, hi = chosen(data, valid)
                view = memoryview(joined)
                rec = _records(data, view, at, lo, hi + SPAN)
                sides = np.empty((len(at), 6), np.uint8)  # halves that reach out of the zone are not looked at
                sides[:, :3] = _hashes(view, at, at + GRAM + HALF)[:, :3]
                sides[:, 3:] = _hashes(view, np.maximum(at - HALF, 0), at + GRAM)[:, :3]
                which = np.searchsorted(np.array([s for _, s, _, _ in spans]), at, "right") - 1
                doc = np.array([d for d, _, _, _ in spans])[which]
                shift = np.array([o - s for _, s, o, _ in spans])[which]
                held.add(rec, sides.reshape(-1).view("S6"), doc, at + shift, at - lo, hi - lo)
                if held.size >= size:
                    yield from held.shards_of()
        yield from held.shards_of()

    return run


def _dense(shards: int, size: int, piece: int):
    """Rows (known, id, tie, text, spans) -> shards of suffix arrays over every passage in the spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Batch(shards, decided=True)
        for batch in batches:
            held.forget()
            keys = zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True)
            for owner, text, spans in zip(keys, texts(batch.column(3)), batch.column(4), strict=True):
                data, view = np.frombuffer(text, np.uint8), memoryview(text)
                flat = spans.values
                lo, hi = (flat.field(k).to_numpy() for k in range(2))
                mask = np.zeros(len(text) + 2, np.int32)
                np.add.at(mask, lo, 1)
                np.add.at(mask, hi + 1, -1)
                starts = np.flatnonzero(np.cumsum(mask) > 0)
                held.owners.append(owner)
                for k in range(0, len(starts), piece):
                    at = starts[k : k + piece]
                    none = np.zeros(len(at), np.uint8)
                    rec = _records(data, view, at, at, at + SPAN)
                    held.add(rec, none.astype("S6"), np.full(len(at), len(held.owners) - 1), at, none, none)
                    if held.size >= size:
                        yield from held.shards_of()
        yield from held.shards_of()

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, text, copy, spans) -> (key, n_bytes, removed, kept)."""
    for batch in batches:
        sizes, removed, kept = [], [], []
        for text, copy, spans in zip(texts(batch.column(1)), batch.column(2).to_pylist(), batch.column(3), strict=True):
            runs: list[tuple[int, int]] = []
            if copy > 1 and len(text) >= SPAN:
                runs = [(0, len(text))]
            elif spans.is_valid and len(spans.values):
                lo, hi = (spans.values.field(k).to_numpy() for k in range(2))
                order = np.argsort(lo, kind="stable")
                lo, stop = lo[order], np.maximum.accumulate(hi[order] + SPAN)
                fresh = np.flatnonzero(np.append(True, lo[1:] > stop[:-1]))
                runs = list(zip(lo[fresh].tolist(), stop[np.append(fresh[1:], len(lo)) - 1].tolist(), strict=True))
            sizes.append(len(text))
            removed.append([{"start": a, "stop": b} for a, b in runs])
            edges = [0, *[x for r in runs for x in r], len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)) if runs else text)
        span = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, span), pa.array(kept, pa.binary())],
            ["key", "n_bytes", "removed", "kept"],
        )


def _family(runs: DataFrame, shards: int, decided: bool) -> DataFrame:
    """All arrays of a shard meet in one task, one after the other; settled rows go anywhere."""
    spread = F.when(F.col("shard") >= 0, F.col("shard")).otherwise(F.pmod(F.xxhash64("body"), F.lit(shards)).cast("int"))
    dealt = runs.withColumn("place", spread).repartition("place").sortWithinPartitions("shard")
    return dealt.select("shard", "body").mapInArrow(_grow(decided), _FOUND)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside delete their shuffle files when they end; their results are in written tables."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def remove_repeats(
    docs: DataFrame, key: str = "doc_id", text: str = "text", batch: int = BATCH, piece: int = PIECE, hot: int = HOT
) -> DataFrame:
    """(``key``, n_bytes, removed array<struct<start, stop>>, kept binary), one row for each row of ``docs``.

    ``removed`` are the maximal runs of bytes that some earlier passage repeats. ``key`` is
    an integer column. ``batch``, ``piece`` and ``hot`` bound memory and change no result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-levels")
    number = F.coalesce(F.col(key).cast("bigint"), F.lit(0))
    counted = docs.groupBy(number).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("size"))
    most, size = counted.agg(F.max("n"), F.coalesce(F.sum("size"), F.lit(0))).first()
    named = docs.select(
        F.col(key).alias("key"),
        F.col(key).isNotNull().cast("tinyint").alias("known"),
        number.alias("id"),
        (F.xxhash64(F.col(text)) if (most or 0) > 1 else F.lit(0).cast("bigint")).alias("tie"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    shards = max(SHARDS * int(spark.conf.get("spark.sql.shuffle.partitions")), size // SHARD_BYTES)
    long = named.where(F.octet_length("text") >= SPAN).select(*_OWNER, "text")
    with _shuffles_dropped(spark):
        found = scratch.put(_family(long.mapInArrow(_sparse(shards, batch, piece, hot), _RUNS), shards, decided=False), "coarse")
    spans = F.collect_list(F.struct("lo", "hi")).alias("spans")
    unsettled = found.where(F.col("kind") == OPEN).groupBy(*_OWNER).agg(spans)
    again = long.join(unsettled, [*_OWNER]).select(*_OWNER, "text", "spans").mapInArrow(_dense(shards, batch, piece), _RUNS)
    with _shuffles_dropped(spark):
        fine = scratch.put(_family(again, shards, decided=True), "fine")
    repeats = found.where(F.col("kind") == REPEAT).unionAll(fine).groupBy(*_OWNER).agg(spans)
    copies = Window.partitionBy(*_OWNER).orderBy("tie")
    joined = named.join(repeats, [*_OWNER], "left").withColumn("copy", F.row_number().over(copies))
    kind = docs.schema[key].dataType.simpleString()
    out = f"key {kind}, n_bytes bigint, removed array<struct<start:int,stop:int>>, kept binary"
    return joined.select("key", "text", "copy", "spans").mapInArrow(_cut, out).withColumnRenamed("key", key)
