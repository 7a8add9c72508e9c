"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one
bit per failed rule. A policy is a versioned mask over the bits, so a new policy, or
the effect of leaving a rule out, needs no second look at any text.

Nulls and odd input: a null or empty text has no words, fails ``few_words`` and is
rejected; a null id is carried along; repeated rows are judged one by one; texts of
any length are read whole; an empty table gives an empty ledger; input columns that
share a name with a measurement are neither read nor changed.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from foliospark.llm.common import free_name, texts

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_adjacent", "n_upper", "n_letters",
)
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
LETTERS = UPPER + UPPER.lower()


@dataclass(frozen=True)
class Rule:
    """``fails`` is a SQL condition over the measurements, equally valid in Spark and in ANSI SQL."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 20"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 10 * n_words"),
    Rule(3, "word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
    Rule(4, "repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    Rule(5, "stutter", "100 * n_adjacent > 30 * n_words"),
    Rule(6, "shouting", "100 * n_upper > 60 * n_letters"),
)


@dataclass(frozen=True)
class Policy:
    """A document is rejected if it fails any of ``fatal``, or more than ``tolerated`` of ``soft``."""

    version: str
    fatal: tuple[str, ...]
    soft: tuple[str, ...] = ()
    tolerated: int = 0

    def mask(self, names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
        return sum(1 << r.bit for r in rules if r.name in names)


POLICIES = {
    p.version: p
    for p in (
        Policy("base-1", ("few_words", "repeated_windows")),
        Policy("strict-1", tuple(r.name for r in RULES)),
        Policy("lenient-1", ("few_words", "repeated_windows", "symbols"), ("word_length", "repeated_lines", "stutter", "shouting"), 1),
    )
}
DEFAULT_POLICY = "strict-1"


def repeated_words(tokens: list[bytes], halvings: int = 3) -> int:
    """Words inside windows of 2 ** halvings words that occur twice or more, first occurrence included.

    Windows are numbered by doubling: two neighbouring numbers give the number of the
    window twice as long. The comparison is exact and costs a few sorts.
    """
    size = 1 << halvings
    if len(tokens) <= size:
        return 0
    seen: dict[bytes, int] = {}
    codes = np.fromiter((seen.setdefault(t, len(seen)) for t in tokens), np.int64, len(tokens))
    for step in (1 << k for k in range(halvings)):
        pairs = codes[:-step] * (int(codes.max()) + 1) + codes[step:]
        numbers, codes, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        if len(numbers) == len(pairs):
            return 0
    edges = np.zeros(len(tokens) + 1, np.int32)
    starts = np.flatnonzero(counts[codes] > 1)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def measure(text: bytes) -> tuple[int, ...]:
    """The values of ``MEASURES`` for one text."""
    tokens = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return (
        len(tokens),
        len(b"".join(tokens).decode("utf-8", "replace")),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(tokens),
        len(lines),
        sum(map(bytes.__eq__, tokens, tokens[1:])),
        len(text) - len(text.translate(None, UPPER)),
        len(text) - len(text.translate(None, LETTERS)),
    )


@F.arrow_udf(T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))
def _measures(column: pa.Array) -> pa.Array:
    rows = [measure(t) for t in texts(column)]
    return pa.StructArray.from_arrays(
        [pa.array([r[i] for r in rows], pa.int64()) for i in range(len(MEASURES))], list(MEASURES)
    )


def failed_rules(inside: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """One bit for each failed rule; ``inside`` is the struct column that holds the measurements."""
    names = re.compile(r"\b(" + "|".join(MEASURES) + r")\b")
    bits = F.lit(0).cast("long")
    for r in rules:
        fails = F.expr(names.sub(rf"`{inside}`.\1", r.fails))
        bits = bits.bitwiseOR(F.when(fails, F.lit(1 << r.bit)).otherwise(0).cast("long"))
    return bits


def with_ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, str]:
    """``docs`` plus one struct column of measurements and ``failed_rules``; also that column's name.

    The struct gets a name no input column has, so all input columns stay as they are.
    """
    name = free_name(docs, "ledger")
    measured = docs.withColumn(name, _measures(F.col(text)))
    return measured.withColumn(name, F.col(name).withField("failed_rules", failed_rules(name, rules))), name


def ledger(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, all measurements and ``failed_rules``, one row per document."""
    found, name = with_ledger(docs.select(key, text), text)
    return found.select(key, f"{name}.*")


def passes(policy: Policy, bits: Column | str = "failed_rules", rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether the recorded bits satisfy ``policy``."""
    bits = F.col(bits) if isinstance(bits, str) else bits
    fatal = bits.bitwiseAND(F.lit(policy.mask(policy.fatal, rules))) == 0
    soft = F.bit_count(bits.bitwiseAND(F.lit(policy.mask(policy.soft, rules)))) <= policy.tolerated
    return fatal & soft


def ablations(ledger: DataFrame, policies: dict[str, Policy] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """What each rule does in each policy, from the bits alone.

    ``n_failed``: documents failing the rule; ``n_kept``: documents the policy keeps;
    ``n_kept_without``: documents it would keep if the rule were left out. The ledger
    is first counted by bit pattern (at most 2 ** rules rows, combined before the
    shuffle); every figure is then a sum over patterns.
    """
    patterns = ledger.groupBy("failed_rules").agg(F.count(F.lit(1)).alias("n"))
    cases = []
    for p in policies.values():
        for r in rules:
            without = F.col("failed_rules").bitwiseAND(F.lit(~(1 << r.bit)))
            cases.append(
                F.struct(
                    F.lit(p.version).alias("policy"),
                    F.lit(r.name).alias("rule"),
                    (F.col("failed_rules").bitwiseAND(F.lit(1 << r.bit)) != 0).alias("failed"),
                    passes(p, "failed_rules", rules).alias("kept"),
                    passes(p, without, rules).alias("kept_without"),
                )
            )
    rows = patterns.select("n", F.explode(F.array(*cases)).alias("c")).select("n", "c.*")
    total = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    return rows.groupBy("policy", "rule").agg(
        total("failed").alias("n_failed"), total("kept").alias("n_kept"), total("kept_without").alias("n_kept_without")
    )


def keep(docs: DataFrame, text: str = "text", policy: str = DEFAULT_POLICY) -> DataFrame:
    """The rows that satisfy ``policy``, with the columns of ``docs``; one pass, no shuffle."""
    found, name = with_ledger(docs, text)
    return found.where(passes(POLICIES[policy], F.col(name)["failed_rules"])).drop(name)
