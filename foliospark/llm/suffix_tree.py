"""Language-model scoring with a probabilistic suffix tree over bytes.

A text is spelled as the UTF-8 bytes of its lower-cased words, one space between
words and END after the last. The tree holds variable-length contexts of up to ``DEPTH``
preceding bytes. A context is retained if its next-byte distribution diverges from that
of the context one byte shorter by at least ``GAIN`` nats in total (occurrences times
Kullback-Leibler divergence), or if a longer retained context needs it. Next-byte
distributions are smoothed towards the shorter context's. The longest retained suffix
of what precedes a byte is the state that scores it, so a text's probability is
proper: it sums to one over all word sequences.

Training is distributed: tasks count byte windows, the windows are grouped by their
three nearest context bytes, and each group is one or more whole subtrees, tested
where it lies. Every context that passes is kept in a table. A tree of at most
``STATES`` of them is sent to the tasks as one automaton. A larger one is cut by the nearest
context bytes into blocks of about ``BLOCK`` (context, next byte) pairs; one block at a time is
sent, and a pass over the texts adds up what it scores. The longest retained suffix of what
precedes a byte lies in one block, so each byte is scored in exactly one pass.

The unigram base needs the count of every word of a text. The ``HEAD`` most frequent
words are sent to the tasks; the others, none of which can be frequent, meet their
counts in a join.

Nulls and odd input: a null text counts as empty and has the one token END; a row
with a null id is scored but neither learned from nor held out; repeated rows are
scored and counted one by one; an empty table gives an empty result, and scores
against an empty training set are those of the uniform distribution; other columns
are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foliospark.llm.common import Scratch, largest, remainder, texts, words

DEPTH = 6
GAIN = 12.0
STATES = 32_768
BLOCK = 6_000_000
HEAD = 100_000
FOLDS = 10
SMOOTHING = 0.1
END = b"\n"
#: Bytes of text whose windows are counted in one sort, and counters merged before they are sent on.
CHUNK = 1 << 22
FLUSH = 1 << 18


def spelled(tokens: list[bytes]) -> bytes:
    return b" ".join(tokens) + END


# -- counting ---------------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text) -> (word, n), each task's sums; END is counted as a word."""
    held: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in texts(batch.column(0)):
            held.update(words(text))
            held[END] += 1
            if len(held) > FLUSH:
                yield out()
                held.clear()
    if held:
        yield out()


def windows_of(stream: bytes, depth: int) -> np.ndarray:
    """For each byte after the first ``depth`` its context, nearest byte first, and the byte itself, as one number.

    The context takes the top ``depth`` bytes of the number, the byte itself the lowest.
    """
    # Eight bytes that end before the byte itself, read as a little-endian number.
    before = np.ndarray((len(stream) - depth,), "<u8", bytes(8) + stream, depth, (1,))
    codes = before & np.uint64((1 << 64) - (1 << (64 - 8 * depth)))
    codes |= np.frombuffer(stream, np.uint8)[depth:]
    return codes


def windows_of_texts(pieces: list[bytes], depth: int) -> Iterator[np.ndarray]:
    """The windows of every byte of the spelled texts in their order, some ``CHUNK`` at a time; a text has END before it."""
    pad = END * depth
    stream = b"".join(pad + p for p in pieces)
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)) + depth)[:-1] - depth
    wanted = np.ones(len(stream) - depth, bool)
    wanted[(ends[:, None] + np.arange(depth)).ravel()] = False  # what predicts the padding before a text
    for at in range(0, len(wanted), CHUNK):
        yield windows_of(stream[at : at + CHUNK + depth], depth)[wanted[at : at + CHUNK]]


def _count_windows(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray] | None = None
        pieces: list[bytes] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            sums = held
            for codes in windows_of_texts(pieces, depth):
                new = np.unique(codes, return_counts=True)
                if sums is not None:
                    both, where = np.unique(np.concatenate([sums[0], new[0]]), return_inverse=True)
                    new = both, np.bincount(where, np.concatenate([sums[1], new[1]])).astype(np.int64)
                sums = new
            return sums

        def out(pair) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(pair[0]), 100_000):
                codes, n = (x[at : at + 100_000] for x in pair)
                yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n, pa.int64())], ["code", "n"])

        for batch in batches:
            for text in texts(batch.column(0)):
                pieces.append(spelled(words(text)))
                size += len(pieces[-1])
                if size >= CHUNK:
                    held = merged()
                    pieces, size = [], 0
                    if len(held[0]) > 8 * FLUSH:
                        yield from out(held)
                        held = None
        if pieces:
            held = merged()
        if held is not None:
            yield from out(held)

    return run


# -- divergence tests -------------------------------------------------------------------


def _shorter(codes: np.ndarray, depth: int) -> np.ndarray:
    """(context of ``depth`` bytes, next byte) as one number."""
    context = codes >> np.uint64(64 - 8 * depth) if depth else np.zeros(len(codes), np.uint64)
    return (context << np.uint64(8)) | (codes & np.uint64(255))


def _summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(keys, return_inverse=True)
    return found, np.bincount(where, n)


def gains(own: tuple[np.ndarray, np.ndarray], above: tuple[np.ndarray, np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Context numbers of ``depth`` bytes and the gain of each.

    ``own`` are (context and next byte, n) sorted, ``above`` the same of the contexts one byte shorter.
    """
    (key, n), (above_key, above_n) = own, above
    contexts, of = np.unique(key >> np.uint64(8), return_inverse=True)
    total = np.bincount(of, n)
    parents, parent_of = np.unique(above_key >> np.uint64(8), return_inverse=True)
    parent_total = np.bincount(parent_of, above_n)[np.searchsorted(parents, contexts >> np.uint64(8) if depth > 1 else contexts * np.uint64(0))]
    shorter = (key >> np.uint64(16)) << np.uint64(8) if depth > 1 else np.zeros(len(key), np.uint64)
    parent_n = above_n[np.searchsorted(above_key, shorter | (key & np.uint64(255)))]
    return contexts, np.bincount(of, n * np.log(n / parent_n)) - total * np.log(total / parent_total)


def _test_contexts(depth: int, near: int, floor: float, short):
    """Rows (code, n) sorted by code -> (depth, context, bytes, counts) of contexts worth at least ``floor``.

    The worth of a context is the largest gain of itself and of the longer contexts that
    need it. ``short`` has the sums for contexts of ``near`` bytes; rows that agree in
    one byte more come together.
    """

    def out(codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        tables = {d: _summed(_shorter(codes, d), n) for d in range(near + 1, depth + 1)}
        tables[near] = short.value
        below: tuple[np.ndarray, np.ndarray] | None = None
        for d in range(depth, near, -1):
            contexts, worth = gains(tables[d], tables[d - 1], d)
            if below is not None:
                np.maximum.at(worth, np.searchsorted(contexts, below[0] >> np.uint64(8)), below[1])
            below = contexts, worth
            good = contexts[worth >= floor]
            key, counts = tables[d]
            keep = np.isin(key >> np.uint64(8), good)
            key, counts = key[keep], counts[keep].astype(np.int64)
            offsets = pa.array(np.concatenate([[0], np.searchsorted(key >> np.uint64(8), good, side="right")]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int64())) for x in ((key & np.uint64(255)).astype(np.int64), counts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(good), d), pa.int32()), pa.array(good.view(np.int64)), *lists],
                ["depth", "context", "bytes", "counts"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - 8 * (near + 1))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            held.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            if sum(len(c) for c, _ in held) < FLUSH:
                continue
            codes, n = (np.concatenate(x) for x in zip(*held, strict=True))
            other = np.flatnonzero(codes >> shift != codes[-1] >> shift)
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from out(codes[:cut], n[:cut])
            held = [(codes[cut:], n[cut:])]
        if sum(len(c) for c, _ in held):
            yield from out(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


class Tree:
    """The tree as an automaton: for each state and byte the next state and the byte's log10 probability.

    States are contexts (nearest byte last). The retained set is closed under dropping the
    farthest byte; the automaton also needs it closed under dropping the nearest, and a
    state added for that has its parent's distribution.
    """

    def __init__(self, counted: dict[bytes, tuple[np.ndarray, np.ndarray]]):
        nodes = set(counted) | {b""}
        todo = list(nodes)
        while todo:
            context = todo.pop()
            for part in (context[1:], context[:-1]):
                if part not in nodes:
                    nodes.add(part)
                    todo.append(part)
        order = sorted(nodes, key=lambda c: (len(c), c))
        number = {c: i for i, c in enumerate(order)}
        longer: dict[bytes, list[bytes]] = {}
        for context in order[1:]:
            longer.setdefault(context[:-1], []).append(context)
        self.next = np.zeros((len(order), 256), np.int32)
        chance = np.full((len(order), 256), 1 / 256, np.float32)
        for i, context in enumerate(order):
            if context:
                above = number[context[1:]]
                chance[i], self.next[i] = chance[above], self.next[above]
            for child in longer.get(context, ()):
                self.next[i, child[-1]] = number[child]
            if context in counted:
                byte, n = counted[context]
                share = n.sum() + len(n)
                chance[i] *= len(n) / share
                chance[i, byte] += (n / share).astype(np.float32)
        self.logs = np.log10(chance)
        self.depth = max(map(len, order))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """log10 probability of each spelled text. All texts are stepped through together, in lanes of equal length.

        A lane starts ``depth`` bytes early, which is as far back as a state looks.
        """
        if not texts:
            return np.zeros(0)
        stream = np.frombuffer(b"".join(texts), np.uint8)
        lane = max(256, -(-len(stream) // 4096))
        lanes = -(-len(stream) // lane)
        padded = np.full(self.depth + lanes * lane, END[0], np.uint8)
        padded[self.depth : self.depth + len(stream)] = stream
        starts = np.arange(lanes) * lane
        state = np.zeros(lanes, np.int32)
        flat_next, flat_logs = self.next.reshape(-1), self.logs.reshape(-1)
        logs = np.empty((lane, lanes), np.float32)
        for k in range(self.depth + lane):
            at = state.astype(np.int64) * 256 + padded[starts + k]
            if k >= self.depth:
                logs[k - self.depth] = flat_logs[at]
            state = flat_next[at]
        sums = logs.T.reshape(-1)[: len(stream)].astype(np.float64)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        return np.add.reduceat(sums, np.cumsum(lengths) - lengths)


def context_bytes(number: int, depth: int) -> bytes:
    """A context number (nearest byte first) as bytes with the nearest last."""
    return number.to_bytes(8, "big")[8 - depth :][::-1] if depth else b""


class Block:
    """The retained contexts of one range of near contexts, for the windows in that range.

    For each depth sorted contexts with the log10 weight of the shorter context, and sorted
    (context, next byte) with the log10 probability. A byte seen after a context was seen after all
    shorter ones; where it was not, its probability is the shorter context's times the weight.
    """

    def __init__(self, first: int, last: int, levels: list[tuple[np.ndarray, np.ndarray]], depth: int):
        """``levels``: for each depth (context and next byte, n) sorted, of contexts that windows from ``first`` to ``last`` can need."""
        self.first, self.last, self.depth = np.uint64(first), np.uint64(last), depth
        self.levels = []
        above_keys, above = np.zeros(0, np.uint64), np.zeros(0)
        for d, (keys, n) in enumerate(levels):
            contexts, of, kinds = np.unique(keys >> np.uint64(8), return_inverse=True, return_counts=True)
            share = np.bincount(of, n) + kinds
            if d:
                shorter = (keys >> np.uint64(16)) << np.uint64(8) if d > 1 else np.zeros(len(keys), np.uint64)
                base = above[np.searchsorted(above_keys, shorter | (keys & np.uint64(255)))]
            else:
                base = np.full(len(keys), 1 / 256)
            above_keys, above = keys, (n + kinds[of] * base) / share[of]
            self.levels.append((contexts, np.log10(kinds / share), keys, np.log10(above).astype(np.float32)))

    def _logs(self, codes: np.ndarray) -> np.ndarray:
        """log10 probability of each of the sorted windows ``codes``."""
        logs = np.full(len(codes), -np.log10(256))
        live = np.arange(len(codes))
        for d, (contexts, weight, keys, own) in enumerate(self.levels):
            if not len(contexts):
                break
            short = _shorter(codes[live], d)
            at = np.minimum(np.searchsorted(contexts, short >> np.uint64(8)), len(contexts) - 1)
            hit = contexts[at] == short >> np.uint64(8)
            live, short, at = live[hit], short[hit], at[hit]
            pair = np.minimum(np.searchsorted(keys, short), len(keys) - 1)
            logs[live] = np.where(keys[pair] == short, own[pair], logs[live] + weight[at])
        return logs

    def score(self, texts: list[bytes]) -> np.ndarray:
        """What the bytes in the range add to the log10 probability of each spelled text."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        logs, start = np.zeros(lengths.sum()), 0
        for codes in windows_of_texts(texts, self.depth):
            inside = np.flatnonzero((codes >= self.first) & (codes <= self.last))
            of, found = pd.factorize(codes[inside])
            order = np.argsort(found)
            values = np.empty(len(found))
            values[order] = self._logs(found[order])
            logs[start + inside] = values[of]
            start += len(codes)
        return np.add.reduceat(logs, np.cumsum(lengths) - lengths) if texts else np.zeros(0)


class Grown:
    """The retained contexts of ``training``: short ones on the driver, longer ones in a table.

    Contexts of up to two bytes (at most 2 ** 24 sums) are tested on the driver, longer ones in the
    tasks. Of the longer ones the driver holds how many there are by their three nearest bytes.
    """

    def __init__(self, training: DataFrame, text: str, scratch: Scratch, depth: int = DEPTH, floor: float = GAIN):
        self.depth, self.near = depth, min(2, depth)
        near = self.near
        counted = training.select(text).mapInArrow(_count_windows(depth), "code bigint, n bigint")
        grams = scratch.put(counted.groupBy("code").agg(F.sum("n").alias("n")), "windows")
        top = F.shiftleft(F.shiftrightunsigned("code", 64 - 8 * near), 8).bitwiseOR(F.col("code").bitwiseAND(F.lit(255)))
        found = grams.groupBy(top.alias("key")).agg(F.sum("n").alias("n")).orderBy("key").toArrow()
        key, n = found.column("key").to_numpy().astype(np.uint64), found.column("n").to_numpy()
        self.short: list[tuple[np.ndarray, np.ndarray]] = []
        self.table: DataFrame | None = None
        #: Three nearest bytes of longer contexts, how many contexts and (context, next byte) pairs.
        self.groups = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(key):
            return
        tables = {near: (key, n)}
        for d in range(near - 1, -1, -1):
            longer = tables[d + 1][0]
            shorter = (longer >> np.uint64(16)) << np.uint64(8) if d else np.zeros(len(longer), np.uint64)
            tables[d] = _summed(shorter | (longer & np.uint64(255)), tables[d + 1][1])
        if depth > near:
            short = training.sparkSession.sparkContext.broadcast(tables[near])
            tested = (
                grams.repartition(F.shiftrightunsigned("code", 64 - 8 * (near + 1)))
                .sortWithinPartitions("code")
                .mapInArrow(_test_contexts(depth, near, floor, short), "depth int, context bigint, bytes array<bigint>, counts array<bigint>")
            )
            group = F.expr(f"shiftrightunsigned(context, 8 * (depth - {near + 1}))")
            self.table = scratch.put(tested.withColumn("group", group), "contexts")
            sizes = self.table.groupBy("group").agg(F.count(F.lit(1)).alias("c"), F.sum(F.size("bytes").cast("long")).alias("pairs")).orderBy("group").toArrow()
            self.groups = (sizes.column("group").to_numpy().astype(np.uint64), *(sizes.column(c).to_numpy().astype(np.int64) for c in ("c", "pairs")))
        needed = np.unique(self.groups[0] >> np.uint64(8))
        for d in range(near, -1, -1):  # from ``near`` down, so that what a longer context needs is known
            keys, sums = tables[d]
            contexts, gain = gains(tables[d], tables[d - 1], d) if d else (np.zeros(1, np.uint64), np.array([np.inf]))
            good = contexts[(gain >= floor) | np.isin(contexts, needed)]
            keep = np.isin(keys >> np.uint64(8), good)
            self.short.insert(0, (keys[keep], sums[keep]))
            needed = np.unique(good >> np.uint64(8)) if d > 1 else np.zeros(1, np.uint64)

    def _levels(self, first: int, last: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each depth (context and next byte, n) sorted, of contexts whose nearest bytes are from ``first`` to ``last``."""
        near, levels = self.near, []
        for d, (keys, n) in enumerate(self.short):
            lo, hi = (x >> (8 * (near + 1 - d)) for x in (first, last))
            a, b = np.searchsorted(keys >> np.uint64(8), np.array([lo, hi + 1], np.uint64))
            levels.append((keys[a:b], n[a:b]))
        if self.table is None:
            return levels
        rows = self.table.where(F.col("group").between(first, last)).select("depth", "context", "bytes", "counts").toArrow().combine_chunks()
        depths = rows.column("depth").to_numpy()
        for d in range(near + 1, self.depth + 1):
            part = rows.filter(pa.array(depths == d))
            lists = [part.column(c).combine_chunks() for c in ("bytes", "counts")]
            sizes = lists[0].value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            contexts = part.column("context").to_numpy().astype(np.int64).view(np.uint64)
            byte, n = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
            keys = (np.repeat(contexts, sizes) << np.uint64(8)) | byte.astype(np.uint64)
            order = np.argsort(keys)
            levels.append((keys[order], n[order].astype(np.int64)))
        return levels

    def whole(self) -> Tree:
        counted: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        for d, (keys, n) in enumerate(self._levels(0, (1 << (8 * (self.near + 1))) - 1)):
            contexts, starts = np.unique(keys >> np.uint64(8), return_index=True)
            for c, a, b in zip(contexts.tolist(), starts, np.append(starts, len(keys))[1:], strict=True):
                counted[context_bytes(c, d)] = (keys[a:b] & np.uint64(255)).astype(np.int64), n[a:b]
        return Tree(counted)

    def ranges(self) -> list[tuple[int, int]]:
        """First and last of the three nearest bytes of each block."""
        group, _, pairs = self.groups
        places = (np.cumsum(pairs) - pairs) // BLOCK
        starts = [0, *group[np.flatnonzero(np.diff(places)) + 1].tolist(), 1 << (8 * (self.near + 1))]
        return [(a, b - 1) for a, b in zip(starts, starts[1:], strict=False)]

    def small(self) -> bool:
        return self.groups[1].sum() <= STATES

    def parts(self) -> Iterator[Tree | Block]:
        """What scores each byte of a text exactly once: one automaton, or one block after the other."""
        if self.small():
            yield self.whole()
            return
        shift = 64 - 8 * (self.near + 1)
        for a, b in self.ranges():
            yield Block(a << shift, ((b + 1) << shift) - 1, self._levels(a, b), self.depth)


def learn(training: DataFrame, text: str, scratch: Scratch, depth: int = DEPTH, floor: float = GAIN) -> Tree:
    """The tree of all texts of ``training`` as one automaton."""
    return Grown(training, text, scratch, depth, floor).whole()


# -- scoring ----------------------------------------------------------------------------


def _score(tree, head):
    """Rows (row, id, text) -> scores by (a first part of) the tree, sums over frequent words, the other words with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value.get
        for batch in batches:
            pieces: list[bytes] = []
            size, at = 0, 0
            lists: list[tuple] = []

            def out(upto: int) -> pa.RecordBatch:
                scores = tree.value.score(pieces)
                n_tokens, sums, n_known, rare, n = zip(*lists, strict=True)
                return pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, upto - at), batch.column(1).slice(at, upto - at),
                        pa.array(n_tokens, pa.int64()), pa.array(scores), pa.array(sums, pa.float64()), pa.array(n_known, pa.int64()),
                        pa.array(rare, pa.list_(pa.binary())), pa.array(n, pa.list_(pa.int64())),
                    ],
                    ["row", "id", "n_tokens", "score", "base", "n_known", "rare", "n"],
                )

            for i, text in enumerate(texts(batch.column(2))):
                tokens = words(text)
                pieces.append(spelled(tokens))
                size += len(pieces[-1])
                tokens.append(END)
                logs = list(map(known, tokens))
                rare = Counter(t for t, x in zip(tokens, logs, strict=True) if x is None)
                logs = [x for x in logs if x is not None]
                lists.append((len(tokens), sum(logs), len(logs), list(rare), list(rare.values())))
                if size >= CHUNK:
                    yield out(i + 1)
                    pieces, lists, size, at = [], [], 0, i + 1
            if pieces:
                yield out(batch.num_rows)

    return run


def _score_more(tree):
    """Rows (row, id, text) -> (row, more) by a further part of the tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces: list[bytes] = []
            size, found = 0, []
            for text in texts(batch.column(2)):
                pieces.append(spelled(words(text)))
                size += len(pieces[-1])
                if size >= CHUNK:
                    found.append(tree.value.score(pieces))
                    pieces, size = [], 0
            found.append(tree.value.score(pieces))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found))], ["row", "more"])

    return run


def scores(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = FOLDS) -> DataFrame:
    """One row per document: ``key``, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-tree")
    fold = remainder(key, folds)
    training = docs.where(fold != 0)
    counted = training.select(text).mapInArrow(_count_words, "word binary, n bigint")
    counts = scratch.put(counted.groupBy("word").agg(F.sum("n").alias("n")), "words")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    log = lambda c: np.log10((c + SMOOTHING) / (total + SMOOTHING * (kinds + 1)))
    head = largest(counts, "n", HEAD, "word").toArrow()
    frequent = {w: float(log(c)) for w, c in zip(head.column("word").to_pylist(), head.column("n").to_pylist(), strict=True)}
    least = min(head.column("n").to_pylist(), default=0)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("id"), F.col(text).alias("text"))
    kind = docs.schema[key].dataType.simpleString()
    schema = f"row bigint, id {kind}, n_tokens bigint, score double, base double, n_known bigint, rare array<binary>, n array<bigint>"
    words_known = spark.sparkContext.broadcast(frequent)
    more: list[DataFrame] = []
    grown = Grown(training, text, scratch)
    if not grown.small() and len(grown.ranges()) > 1:  # rows are numbered once
        rows = scratch.put(rows, "rows")
    for i, part in enumerate(grown.parts()):
        tree = spark.sparkContext.broadcast(part)
        if i:
            more.append(scratch.put(rows.mapInArrow(_score_more(tree), "row bigint, more double"), "more"))
        else:
            scored = scratch.put(rows.mapInArrow(_score(tree, words_known), schema), "scored")
        tree.unpersist()
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "n")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.n").alias("times"))
    tail = counts.where(F.col("n") <= least).select("word", F.col("n").alias("c"))
    chance = F.log10((F.coalesce("c", F.lit(0)) + F.lit(SMOOTHING)) / F.lit(total + SMOOTHING * (kinds + 1)))
    sums = (
        rare.join(tail, "word", "left")
        .groupBy("row")
        .agg(F.sum(F.col("times") * chance).alias("rare_base"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    )
    zero = F.lit(0).cast("long")
    if more:
        added = reduce(DataFrame.unionByName, more).groupBy("row").agg(F.sum("more").alias("more"))
        scored = scored.join(added, "row").withColumn("score", F.col("score") + F.col("more"))
    return scored.drop("rare", "n").join(sums, "row", "left").select(
        F.col("id").alias(key),
        F.coalesce(remainder("id", folds) == 0, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", zero)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        "score",
    )
