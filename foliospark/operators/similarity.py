"""Similarity clusters over a whole corpus: an exact set-similarity self-join and its components.

Documents are compared by the Jaccard similarity of their signature terms. Nothing is
compared with everything:

* documents with the same terms are one class, which goes on under a number;
* terms are numbered from rare to common over the corpus, those of one class are only
  counted. Two sets with similarity ``t`` or more share a term among the first
  ``n - ceil(t * n) + 1`` of each (``n`` its size), so a set is filed under those rare
  terms only, once for each. A pair counts under the first term that the two share;
* a set that could only meet a smaller one under a term is compared with smaller ones only;
* a term of more than ``BLOCK`` sets is cut into blocks by hash, and each pair of blocks is
  one cell. Blocks are large, as a set is shuffled once for each block of its term.

A task reads many cells at once. Pairs are first judged by the bits of the terms that follow
the shared one, and counted exactly where these leave a link possible. The task returns link
counts per set and the smallest set that its links lead to, never the pairs. Components come
from contracting those.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliospark.operators import graph
from foliospark.operators.index import bounded
from foliospark.operators.skew import number_rows
from foliospark.staging import shuffles_dropped, stage

THRESHOLD = 0.3
#: Sets in a block of a term.
BLOCK = 1 << 15
#: Rows of whole cells that a task holds at once, and sets whose results it holds.
CELL_ROWS = 1 << 16
HELD = 1 << 20
#: Pairs judged at once; sets with so many to meet are judged as a matrix.
PAIRS = 1 << 18
WIDE = 256
#: Terms compared at once.
COUNTED = 1 << 18
#: Bits of a set; longer sets are compared by sorting.
BITS = 256
SHORT = 64
_FOUND = "id bigint, head bigint, links bigint, similarity double"


def _prefix_length(size, threshold: float):
    """How many of a set's rarest terms it is filed under."""
    return size - F.ceil(size * threshold - 1e-9) + 1


def classes(sets: DataFrame) -> DataFrame:
    """(name, copies, terms): one row for each different set of terms; empty sets are left out."""
    ordered = sets.where(F.size("terms") > 0).select("name", F.array_sort(F.array_distinct("terms")).alias("terms"))
    return ordered.groupBy("terms").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("copies"))


def rare_first(groups: DataFrame) -> DataFrame:
    """(id, copies, size, terms array<int>): numbers of the terms that other classes have too, those of few classes first.

    ``groups`` are classes with an ``id``; ``size`` counts all terms of a class. Classes that
    share none are left out.
    """
    flat = groups.select("id", "copies", F.size("terms").alias("size"), F.explode("terms").alias("term"))
    order = ["df", "term"]
    # Written before it is dealt out by ranges, which samples it.
    frequency = stage(flat.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "similarity-terms")
    ranged = stage(frequency.repartitionByRange(*order).withColumn("pid", F.spark_partition_id()), "similarity-order")
    numbers = number_rows(ranged, "pid", order).select("term", F.col("row_index").cast("int").alias("number"))
    counted = flat.join(numbers, "term").groupBy("id", "copies", "size")
    return counted.agg(F.sort_array(F.collect_list("number")).alias("terms"))


def _cells(ranked: DataFrame, threshold: float, block: int) -> DataFrame:
    """Rows (term, low, high, left, id, copies, size, terms) of the block pairs that have to be compared."""
    # Terms of one class are the rarest and come before those that are numbered.
    kept = _prefix_length(F.col("size"), threshold) - (F.col("size") - F.size("terms"))
    kept = F.slice("terms", F.lit(1), F.greatest(kept, F.lit(0)).cast("int"))
    filed = ranked.select(F.explode(kept).alias("term"), "id", "copies", "size", "terms")
    counts = filed.groupBy("term").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    blocks = stage(counts.select("term", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "similarity-blocks")
    dealt = filed.join(bounded(blocks), "term", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    met = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    low = F.least("own", "other")
    return met.select(
        "term", low.alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") == low).alias("left"),
        "id", "copies", "size", "terms",
    )


def _pieces(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """A sorted stream in tables of whole cells (term, low, high), of about ``rows`` rows or one cell."""
    held: list[pa.RecordBatch] = []
    count, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(k).to_numpy() for k in range(3)]
        change = np.zeros(batch.num_rows, bool)
        change[0] = last is not None and tuple(k[0] for k in keys) != last
        for k in keys:
            change[1:] |= k[1:] != k[:-1]
        last = tuple(k[-1] for k in keys)
        cuts = np.flatnonzero(change)
        if count + batch.num_rows >= rows and len(cuts):
            a = int(cuts[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, a)])
            held, count, batch = [], 0, batch.slice(a)
        held.append(batch)
        count += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _spans(count: np.ndarray, most: int) -> Iterator[slice]:
    """Consecutive slices of ``count``, of about ``most`` in sum or one element."""
    total = np.cumsum(count)
    a = 0
    while a < len(count):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + most, "right")))
        yield slice(a, b)
        a = b


def _each(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the range, value) of all values in the ranges from ``start``."""
    owner = np.repeat(np.arange(len(count)), count)
    ahead = np.cumsum(count) - count
    return owner, np.arange(len(owner)) + np.repeat(start - ahead, count)


class _Rows:
    """Rows of whole cells. ``begin`` and ``count`` give the range of rows that each has to be compared with."""

    def __init__(self, table: pa.Table, threshold: float):
        self.threshold = threshold
        table = table.combine_chunks()
        term, low, high, left, ids, copies, size = (table[k].to_numpy() for k in range(7))
        lists = table["terms"].combine_chunks()
        lengths, flat = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()
        size = size.astype(np.int64)
        owner, spot = _each(np.cumsum(lengths) - lengths, lengths)
        at = np.flatnonzero(flat == term[owner]) - (np.cumsum(lengths) - lengths)
        rem = lengths - at  # the shared term and those behind it
        outer = rem < self.least(2 * size)
        change = np.ones(len(term), bool)
        change[1:] = (term[1:] != term[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
        cell = np.cumsum(change) - 1
        two = low != high
        side = np.where(two & ~left, 1, 0)
        order = np.lexsort((size, side, outer, cell))
        cell, two, side, size, outer, at, rem = (x[order] for x in (cell, two, side, size, outer, at, rem))
        self.n, self.size, self.rem, self.at = len(order), size, rem, at
        self.ids, self.copies, self.term = ids[order], copies[order].astype(np.float64), term[order]
        self.length = lengths[order]
        starts = (np.cumsum(lengths) - lengths)[order]
        self.flat = flat[_each(starts, self.length)[1]]
        self.start = np.cumsum(self.length) - self.length

        # The inner rows of a cell's side stand together, by size.
        inside = np.flatnonzero(~outer)
        span = int(size.max()) + 2
        key = ((cell * 2 + side) * span + size)[inside]
        facing = (cell * 2 + np.where(two, 1 - side, 0)) * span
        first = np.searchsorted(key, facing)
        end = np.searchsorted(key, np.where(outer, facing + size, facing + span - 1))
        own = np.cumsum(~outer) - 1
        end = np.where(~outer & ~two, own, np.where(~outer & two & (side == 0), first, end))
        self.count = np.maximum(end - first, 0)
        self.begin = np.zeros(self.n, np.int64)
        some = self.count > 0
        self.begin[some] = inside[first[some]]
        self._bits()

    def least(self, both: np.ndarray) -> np.ndarray:
        """How many terms two sets of ``both`` terms in all must share, or a little less."""
        t = self.threshold
        return np.ceil((t * both - 1e-9) / (1 + t) - 1e-7).astype(np.int64)

    def _bits(self) -> None:
        """Hashed bits of the terms behind the shared one, and how far two sets' bits may differ."""
        self.bits = np.empty((BITS // 64, self.n), np.uint64)
        for span in _spans(self.length + BITS, 1 << 23):
            owner, spot = _each((self.start + self.at + 1)[span], (self.rem - 1)[span])
            made = np.zeros((span.stop - span.start, BITS), bool)
            made[owner, (self.flat[spot].astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(24)] = True
            self.bits[:, span] = np.packbits(made, axis=1).view(np.uint64).T
        self.folded = np.bitwise_or.reduce(self.bits, axis=0)
        # Sets of a and b terms behind, that share s, differ in a + b - 2 s; the sum of both rows' slack, in sixteenths.
        slack = 16 * (self.rem - 2 * self.size * (self.threshold / (1 + self.threshold)))
        self.slack = np.ceil(slack + 1e-3).astype(np.int16 if self.size.max() < 900 else np.int32)
        #: Where the terms behind the shared one start and those before it, and how many they are.
        self.parts = ((self.start + self.at + 1, self.rem - 1), (self.start, self.at))
        if self.length.max() <= SHORT:
            self.padded = []
            for start, count in self.parts:
                owner, spot = _each(start, count)
                made = np.full((self.n, int(count.max())), -1, np.int32)
                made[owner, spot - start[owner]] = self.flat[spot]
                self.padded.append(made)

    def _near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Of pairs that came through the folded bits, those that may be links."""
        least = self.least(self.size[i] + self.size[j])
        a, b = self.rem[i], self.rem[j]
        apart = np.zeros(len(i), np.int64)
        for word in self.bits:
            apart += np.bitwise_count(word[i] ^ word[j])
        return (np.minimum(a, b) >= least) & (apart <= a + b - 2 * least)

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        kind = self.slack.dtype
        few = np.flatnonzero((self.count > 0) & (self.count < WIDE))
        for span in _spans(self.count[few], PAIRS):
            owner, j = _each(self.begin[few[span]], self.count[few[span]])
            i = few[span][owner]
            apart = np.left_shift(np.bitwise_count(self.folded[i] ^ self.folded[j]), 4, dtype=kind)
            kept = apart <= self.slack[i] + self.slack[j]
            yield i[kept], j[kept]
        many = np.flatnonzero(self.count >= WIDE)
        cuts = [0, *(np.flatnonzero(np.diff(self.begin[many])) + 1).tolist(), len(many)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            for span in _spans(self.count[many[a:b]], PAIRS):
                i = many[a:b][span]
                first, most = int(self.begin[i[0]]), int(self.count[i].max())
                columns = slice(first, first + most)
                apart = np.bitwise_count(self.folded[i][:, None] ^ self.folded[columns][None, :])
                kept = np.left_shift(apart, 4, dtype=kind) <= self.slack[i][:, None] + self.slack[columns][None, :]
                row, column = np.nonzero(kept)
                there = column < self.count[i][row]
                yield i[row[there]], first + column[there]

    def _shared(self, i: np.ndarray, j: np.ndarray, part: int) -> np.ndarray:
        """How many terms pairs share behind the one that they were met under (``part`` 0) or before it (1)."""
        start, count = self.parts[part]
        if self.length.max() <= SHORT:
            sides = [(x, int(count[x].max(initial=0))) for x in (i, j)]
            a, b = (np.ascontiguousarray(self.padded[part][x][:, :n].T) for x, n in sides)
            b[b == -1] = -2
            shared = np.zeros(len(i), np.uint8)
            for one in a:
                shared += np.bitwise_or.reduce((b == one).view(np.uint8), axis=0)
            return shared.astype(np.int64)
        keys = []
        for x in (i, j):
            owner, spot = _each(start[x], count[x])
            keys.append(owner << 32 | self.flat[spot].astype(np.int64))
        keys = np.sort(np.concatenate(keys))
        return np.bincount(keys[1:][keys[1:] == keys[:-1]] >> 32, minlength=len(i))

    def _survivors(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The pairs to be counted, many at a time."""
        held, count = [], 0
        for i, j in self.candidates():
            kept = self._near(i, j)
            held.append((i[kept], j[kept]))
            count += len(held[-1][0])
            if count >= PAIRS:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, count = [], 0
        if count:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row, row, similarity) of all links."""
        for i, j in self._survivors():
            made = []
            for span in _spans(self.length[i] + self.length[j], COUNTED):
                a, b = i[span], j[span]
                shared = 1 + self._shared(a, b, 0)
                union = self.size[a] + self.size[b] - shared
                linked = np.flatnonzero(shared >= self.threshold * union - 1e-9)
                linked = linked[self._shared(a[linked], b[linked], 1) == 0]  # else met under an earlier term
                made.append((a[linked], b[linked], shared[linked] / union[linked]))
            yield tuple(np.concatenate(x) for x in zip(*made, strict=True))


def _joined(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``parent``, by which each node has the smallest of its tree, after links between ``i`` and ``j``."""
    while True:
        a, b = parent[i], parent[j]
        apart = a != b
        if not apart.any():
            return parent
        i, j = i[apart], j[apart]
        a, b = a[apart], b[apart]
        parent[np.maximum(a, b)] = np.minimum(a, b)  # of several, one holds; the others come again
        while True:
            above = parent[parent]
            if (above == parent).all():
                break
            parent = above


class _Found:
    """Links and similarity by set, and the smallest set that a set's links lead to."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.count = 0

    def add(self, ids: np.ndarray, heads: np.ndarray, links: np.ndarray, similarity: np.ndarray) -> None:
        self.parts.append((ids, heads, links, similarity))
        self.count += len(ids)

    def merge(self) -> None:
        ids, heads, links, similarity = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        names, spot = np.unique(ids, return_inverse=True)
        parent = _joined(np.arange(len(names)), spot, np.searchsorted(names, heads))
        self.clear()
        self.add(names, names[parent], np.bincount(spot, links, len(names)), np.bincount(spot, similarity, len(names)))

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.count:
            self.merge()
            ids, heads, links, similarity = self.parts[0]
            self.clear()
            columns = [pa.array(x) for x in (ids, heads, np.rint(links).astype(np.int64), similarity)]
            yield pa.RecordBatch.from_arrays(columns, ["id", "head", "links", "similarity"])


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, merged = _Found(), 0
        for piece in _pieces(batches, CELL_ROWS):
            rows = _Rows(piece, threshold)
            names, spot = np.unique(rows.ids, return_inverse=True)
            links, total, parent = np.zeros(len(names)), np.zeros(len(names)), np.arange(len(names))
            for i, j, score in rows.links():
                if not len(i):
                    continue
                for a, b in ((i, j), (j, i)):
                    np.add.at(links, spot[a], rows.copies[b])
                    np.add.at(total, spot[a], rows.copies[b] * score)
                parent = _joined(parent, spot[i], spot[j])
            some = links > 0
            found.add(names[some], names[parent[some]], links[some], total[some])
            if found.count > merged + HELD:
                found.merge()
                merged = found.count
                if merged > HELD:
                    yield from found.rows()
                    merged = 0
        yield from found.rows()

    return run


def clusters(
    documents: DataFrame, name: str = "file_path", terms: str = "signature_terms", threshold: float = THRESHOLD, block: int = BLOCK
) -> DataFrame:
    """(``name``, cluster_id, cluster_size, links, mean_similarity), one row for each document.

    ``links`` counts the documents at or above ``threshold``, ``mean_similarity`` is their
    mean; ``cluster_id`` is the smallest name that links lead to, null for a document
    without a link. Documents without terms have no links. Names are taken to be unique;
    sets that have none are compared with no other set.
    """
    with shuffles_dropped(documents.sparkSession):
        given = stage(documents.select(F.col(name).alias("name"), F.col(terms).alias("terms")), "similarity-sets")
        groups = stage(classes(given).withColumn("id", F.monotonically_increasing_id()), "similarity-classes")
        ranked = stage(rare_first(groups.where(F.col("name").isNotNull())), "similarity-ranked")
        dealt = _cells(ranked, threshold, block).repartition("term", "low", "high").sortWithinPartitions("term", "low", "high")
        found = stage(dealt.mapInArrow(_compare(threshold), _FOUND), "similarity-links")
        heads = graph.components(found.select("id", "head"))
        counts = found.groupBy("id").agg(F.sum("links").alias("links"), F.sum("similarity").alias("similarity"))
        rows = groups.select("id", "name", "copies").join(counts, "id", "left").join(heads.withColumnRenamed("node", "id"), "id", "left")
        rows = stage(rows, "similarity-rows")
        sizes = (
            rows.where(F.col("component").isNotNull())
            .groupBy("component")
            .agg(F.min("name").alias("cluster_id"), F.sum("copies").alias("cluster_size"))
        )
        several = F.col("copies") > 1
        by_class = stage(
            rows.join(sizes, "component", "left").select(
                "id",
                (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
                (F.coalesce("similarity", F.lit(0.0)) + F.col("copies") - 1).alias("similarity"),
                F.coalesce("cluster_id", F.when(several, F.col("name"))).alias("cluster_id"),
                F.coalesce("cluster_size", F.when(several & F.col("name").isNotNull(), F.col("copies"))).alias("cluster_size"),
            ),
            "similarity-clusters",
        )
        class_of = given.select("name", F.array_sort(F.array_distinct("terms")).alias("terms")).join(groups.select("terms", "id"), "terms", "left")
        members = stage(class_of.select("name", "id"), "similarity-members")
    return members.join(by_class, "id", "left").select(
        F.col("name").alias(name),
        "cluster_id",
        F.coalesce("cluster_size", F.lit(1)).cast("bigint").alias("cluster_size"),
        F.coalesce("links", F.lit(0)).alias("links"),
        F.when(F.col("links") > 0, F.col("similarity") / F.col("links")).alias("mean_similarity"),
    )


def shared_terms(clustered: DataFrame, documents: DataFrame, name: str = "file_path", terms: str = "signature_terms", limit: int = 8) -> DataFrame:
    """(cluster_id, cluster_size, shared_terms): the first ``limit`` terms, sorted, that every member has."""
    members = clustered.where(F.col("cluster_id").isNotNull()).select(name, "cluster_id", "cluster_size")
    # Joined as whole sets; terms are counted in the task that reads them.
    sets = members.join(documents.select(name, F.array_distinct(terms).alias("terms")), name, "left")
    counted = (
        sets.select("cluster_id", "cluster_size", F.explode_outer("terms").alias("term"))
        .groupBy("cluster_id", "cluster_size", "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    everywhere = F.collect_list(F.when(F.col("n") == F.col("cluster_size"), F.col("term")))
    return counted.groupBy("cluster_id", "cluster_size").agg(F.slice(F.array_sort(everywhere), 1, limit).alias("shared_terms"))
