"""Cheapest repair of a conversation's turn structure with Four-Russians block tables.

The role initials of a repaired conversation have the form ``(s?(ua)+)?``: nothing, or an
optional system turn and then pairs of user and assistant. Each turn is kept (0), given
the role that is due, user or assistant (1), or deleted (2); an empty turn of the role that
is due may be put in anywhere (5). Blank and repeated turns have to be deleted, truncated
ones cost 5 more if they stay. Of the cheapest edits those win whose initials (Delete,
Insert, Keep, Rerole), in order, are least in ASCII.

A turn is one of nine symbols (three roles or another one, whole or truncated; or to be
deleted), and the form has four states, so what the rest of a conversation costs from each
state is a vector of four numbers. They never differ by more than a few edits, so with the
least of them subtracted only some dozens of vectors exist. ``Tables`` finds them all and
works out, for every vector and every block of ``BLOCK`` symbols, the vector before the
block and the cost it adds. A conversation is then read from its end, one look-up for each
block. To trace the edits, each block is expanded backward from the vector at its end, which
gives the cost to go at every turn inside; walking forward with it, the least edit that
stays on a cheapest way is known at once, whatever ties there are.

Nulls and odd input: null roles and texts are one space; turns are ordered by number (nulls
first), then role, then text, so ties and repeated rows have one result; rows with a null
conversation id form one conversation; conversations of which no turn is present cost
nothing and stay empty; an empty table gives an empty result; other columns are not read.
The turns of one conversation are held by the task that repairs it, as the result is one
row; conversations are spread by id and sorted inside the partitions.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Symbols that one look-up takes.
BLOCK = 4
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
ROLES = "sua"
#: States: nothing yet, after system, after user, after assistant. What is due next, and where a kept role leads.
DUE = (1, 1, 2, 1)
NEXT = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
NAMES = {1: "user", 2: "assistant"}
#: Symbol of a turn that has to go; the others are role (0-2, 3 for any other) + 4 if truncated.
GONE = 8
SYMBOLS = 9
SPACE = " \t\n\x0b\x0c\r"
_SCHEMA = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
    "repaired array<struct<role:string,text:string>>"
)


def _inserted(costs: list[int]) -> list[int]:
    """Costs to go if turns may be put in first; two in a row are the most that can help."""
    for _ in range(2):
        costs = [min(c, INSERT + costs[DUE[q] + 1]) for q, c in enumerate(costs)]
    return costs


def _consumed(after: tuple[int, ...], symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(edit, cost to go, next state) of the edits that use up a turn."""
    found = [("D", DELETE + after[state], state)]
    if symbol != GONE:
        extra, due = TRUNCATED * (symbol >= 4), DUE[state] + 1
        if (to := NEXT[state].get(symbol % 4)) is not None:
            found.append(("K", extra + after[to], to))
        found.append(("R", REROLE + extra + after[due], due))
    return found


def step(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Cost to go from each state before a turn, given that after it."""
    return tuple(_inserted([min(c for _, c, _ in _consumed(after, symbol, q)) for q in range(4)]))


LAST = tuple(_inserted([0, 99, 99, 0]))


class Tables:
    """All normalised vectors, their transitions by symbol and by block, and the least edits."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors = [LAST]
        number = {LAST: 0}
        one: list[list[tuple[int, int]]] = []
        while len(one) < len(self.vectors):
            row = []
            for symbol in range(SYMBOLS):
                before = step(self.vectors[len(one)], symbol)
                least = min(before)
                normal = tuple(c - least for c in before)
                if normal not in number:
                    number[normal] = len(self.vectors)
                    self.vectors.append(normal)
                row.append((number[normal], least))
            one.append(row)
        self.to = np.array([[v for v, _ in row] for row in one])
        self.add = np.array([[c for _, c in row] for row in one])
        # A block's number has its first symbol in the highest place; it is read from its last.
        to, add = np.arange(len(one))[:, None], np.zeros((len(one), 1), np.int64)
        for k in range(block):
            to, add = (
                np.concatenate([self.to[to, s] for s in range(SYMBOLS)], axis=1),
                np.concatenate([add + self.add[to, s] for s in range(SYMBOLS)], axis=1),
            )
        self.block_to, self.block_add = to, add
        self.singles = [[(int(v), int(c)) for v, c in row] for row in one]
        self.edits = [[[self._edit(v, s, q) for q in range(4)] for s in range(SYMBOLS)] for v in range(len(one))]

    def _edit(self, vector: int, symbol: int, state: int) -> tuple[str, int, tuple[int, ...]]:
        """(edits up to and including the one of the turn, state after it, states of turns put in)."""
        after = self.vectors[vector]
        before, put, marks = step(after, symbol), (), ""
        while True:
            options = [(e, to) for e, c, to in _consumed(after, symbol, state) if c == before[state]]
            due = DUE[state] + 1
            if INSERT + before[due] == before[state]:
                options.append(("I", due))
            edit, to = min(options)
            marks += edit
            if edit != "I":
                return marks, to, put
            put, state = (*put, due), due

    def borders(self, symbols: bytes) -> tuple[int, list[int]]:
        """(cost of the conversation, vectors at the block borders, from the last to the first)."""
        whole = len(symbols) // self.block
        head = len(symbols) - whole * self.block
        vector, cost, found = 0, 0, [0]
        if whole:
            digits = np.frombuffer(symbols, np.uint8)[head:].reshape(whole, self.block).astype(np.int64)
            codes = digits @ SYMBOLS ** np.arange(self.block - 1, -1, -1)
            for code in codes[::-1].tolist():
                cost += int(self.block_add[vector, code])
                vector = int(self.block_to[vector, code])
                found.append(vector)
        for symbol in symbols[:head][::-1]:
            vector, more = self.singles[vector][symbol]
            cost += more
        return cost + self.vectors[vector][0], found

    def trace(self, symbols: bytes, borders: list[int]) -> Iterator[tuple[str, int, tuple[int, ...]]]:
        """For each turn the entry of ``edits`` on the way from the first state, then one for the end."""
        head, state = len(symbols) % self.block, 0
        starts = [*([0] if head else []), *range(head, len(symbols), self.block)]
        for k, start in enumerate(starts):
            stop = starts[k + 1] if k + 1 < len(starts) else len(symbols)
            inside = [borders[len(starts) - 1 - k]]
            for symbol in symbols[start + 1 : stop][::-1]:
                inside.append(self.singles[inside[-1]][symbol][0])
            for symbol, vector in zip(symbols[start:stop], reversed(inside), strict=True):
                made = self.edits[vector][symbol][state]
                yield made
                state = made[1]
        rest: tuple[int, ...] = ()
        while LAST[state]:
            state = DUE[state] + 1
            rest = (*rest, state)
        yield "I" * len(rest), state, rest


@lru_cache(maxsize=1)
def tables() -> Tables:
    """Built once in each Python process."""
    return Tables()


def _role(name: str) -> int:
    return ROLES.find(name[:1]) if name[:1] and name[:1] in ROLES else 3


def repaired(turns: list[tuple[int | None, str, str]], made: Tables | None = None) -> tuple:
    """The row of one conversation (see ``repair``) of turns (number, role, text) in order."""
    made = made or tables()
    seen: set[tuple[str, str]] = set()
    symbols, faults = bytearray(), [0, 0, 0]
    for _, role, text in turns:
        end = text.rstrip(SPACE)[-1:]
        fault = 0 if not end else 1 if (role, text) in seen else 2 if end not in ".!?" else None
        seen.add((role, text))
        if fault is not None:
            faults[fault] += 1
        symbols.append(GONE if fault in (0, 1) else _role(role) + 4 * (fault == 2))
    initials = [role[:1] for _, role, _ in turns]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    numbers = {n for n, _, _ in turns if n is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    cost, borders = made.borders(bytes(symbols))
    audit, out = [], []
    for (marks, state, put), turn in zip(made.trace(bytes(symbols), borders), [*turns, None], strict=True):
        audit.append(marks)
        out += [(NAMES[q - 1], "") for q in put]
        if turn and marks[-1] != "D":
            out.append((turn[1] if marks[-1] == "K" else NAMES[state - 1], turn[2]))
    return gaps, *faults, illegal, cost, "".join(audit), out


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, present, turn, role, text), sorted -> one row for each key."""
    pair = pa.struct([("role", pa.string()), ("text", pa.string())])
    kinds = [pa.int64()] * 6 + [pa.string(), pa.list_(pair)]
    names = ["key", *[f.split()[0] for f in _SCHEMA.split(", ")]]
    keys: list[pa.Array] = []
    rows: list[tuple] = []
    held: list[tuple[int | None, str, str]] = []
    now = None

    def flush() -> pa.RecordBatch:
        columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        batch = pa.RecordBatch.from_arrays([pa.concat_arrays(keys), *columns], names)
        keys.clear()
        rows.clear()
        return batch

    def close() -> None:
        *numbers, out = repaired(held)
        rows.append((*numbers, [{"role": r, "text": t} for r, t in out]))
        held.clear()

    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for i, (key, present, turn, role, text) in enumerate(zip(*columns, strict=True)):
            if now != (key,):
                if now is not None:
                    close()
                    if len(rows) >= 1000:
                        yield flush()
                keys.append(batch.column(0).slice(i, 1))
                now = (key,)
            if present:
                held.append((turn, role, text))
    if now is not None:
        close()
        yield flush()


def repair(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: Column | None = None
) -> DataFrame:
    """(``key``, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired), one row per conversation.

    ``gaps`` are missing turn numbers, the next three count turns by their first fault,
    ``illegal`` the neighbours whose roles may not follow each other. Rows for which
    ``present`` is false only name their conversation.
    """
    space = F.lit(" ")
    rows = turns.select(
        F.col(key).alias("key"),
        (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(role, space).alias("role"),
        F.coalesce(text, space).alias("text"),
    )
    dealt = rows.repartition("key").sortWithinPartitions("key", F.asc_nulls_first("turn"), "role", "text")
    kind = turns.schema[key].dataType.simpleString()
    return dealt.mapInArrow(_repair, f"key {kind}, {_SCHEMA}").withColumnRenamed("key", key)


def damage(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns with known faults, for measuring repairs: the same columns and ``present``.

    crc32 of ``key:turn`` modulo 20 decides: 0 takes a turn away (``present`` is false),
    1 empties its text, 2 takes ``.!?`` out of it, 3 repeats it, 4 makes it a user's.
    Nulls count as one space.
    """
    space = F.lit(" ")
    named = F.concat(F.coalesce(F.col(key).cast("string"), space), F.lit(":"), F.coalesce(F.col(turn).cast("string"), space))
    kind = F.crc32(named.cast("binary")) % 20
    said = F.coalesce(text, space)
    return turns.select(
        F.col(key),
        F.col(turn),
        F.when(kind == 4, "user").otherwise(F.coalesce(role, space)).alias(role),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said).alias(text),
        (kind != 0).alias("present"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")

