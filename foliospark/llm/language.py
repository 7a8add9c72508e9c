"""Language identification by word-first back-off.

A word that the training texts have in any language scores the logarithm of its relative
frequency in each language. An unseen word falls back to its character n-grams, the
longest first: the first length of which any n-gram is known gives the word the mean
over its known n-grams. A language that lacks a known word or n-gram gets a fixed
penalty. A text's score for a language is the mean over its words.

The classifier is fitted on at most about ``SAMPLE`` labelled rows, chosen by a hash of
the id, and keeps the ``ROWS`` words and as many n-grams of each length that are most
frequent in any one language; every text is then classified from all its words.

Nulls and odd input: a null text, or one without a letter, is ``und`` with score 0; rows
with a null label or id are classified but not learned from; repeated rows are learned
from and classified one by one; without any training row every text is ``und``; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from foliospark.llm.common import Scratch, free_name, largest, remainder, texts

FOLDS, HELD_OUT = 4, 2
SAMPLE = 20_000
ROWS = 120_000
LONGEST = 5
UNKNOWN = "und"
#: log10 frequency of what a language lacks.
PENALTY = -7.0
#: Words that count as independent evidence for the confidence of a long text.
EVIDENCE = 20
MIN_SCORE = 0.3
#: Unseen words whose scores a task remembers.
MEMORY = 100_000

_LETTERS = re.compile(r"[^\W\d_]+")


def words(text: bytes) -> list[str]:
    """Runs of letters, lower-cased."""
    return _LETTERS.findall(text.decode("utf-8", "replace").lower())


def grams(word: str, n: int) -> list[str]:
    """n-grams of the word between two spaces."""
    padded = f" {word} "
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (language, text) -> (language, length, entry, n); length 0 stands for whole words."""
    for batch in batches:
        held: dict[str, Counter[str]] = {}
        for language, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            held.setdefault(language, Counter()).update(words(text))
        for language, counts in held.items():
            sums = [counts] + [Counter() for _ in range(LONGEST)]
            for word, n in counts.items():
                for size in range(1, LONGEST + 1):
                    for g in grams(word, size):
                        sums[size][g] += n
            for size, found in enumerate(sums):
                kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
                columns = ([language] * len(found), [size] * len(found), list(found), list(found.values()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["language", "size", "entry", "n"]
                )


class Model:
    """Tables by length: entry -> row of ``logs[length]``, one column per language."""

    def __init__(self, languages: list[str], tables: list[dict[str, int]], logs: list[np.ndarray]):
        self.languages, self.tables, self.logs = languages, tables, logs

    def _unseen(self, word: str) -> np.ndarray:
        for size in range(LONGEST, 0, -1):
            get = self.tables[size].get
            rows = [r for r in map(get, grams(word, size)) if r is not None]
            if rows:
                return self.logs[size][rows].mean(axis=0)
        return np.full(len(self.languages), PENALTY)

    def classify(self, batch: Iterator[bytes]) -> tuple[list[str], list[float]]:
        known, logs = self.tables[0].get, self.logs[0]
        memory: dict[str, np.ndarray] = {}
        names, sure = [], []
        for text in batch:
            counts = Counter(words(text))
            if not counts or not self.languages:
                names.append(UNKNOWN)
                sure.append(0.0)
                continue
            seen, times = [], []
            total = np.zeros(len(self.languages))
            for word, n in counts.items():
                row = known(word)
                if row is not None:
                    seen.append(row)
                    times.append(n)
                    continue
                scores = memory.get(word)
                if scores is None:
                    if len(memory) >= MEMORY:
                        memory.clear()
                    scores = memory[word] = self._unseen(word)
                total += n * scores
            if seen:
                total += np.array(times, float) @ logs[seen]
            size = sum(counts.values())
            scaled = total * (np.log(10) * min(size, EVIDENCE) / size)
            chance = np.exp(scaled - scaled.max())
            best = int(chance.argmax())
            names.append(self.languages[best])
            sure.append(float(chance[best] / chance.sum()))
        return names, sure


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", sample: int = SAMPLE) -> Model:
    """Fit on labelled rows outside the held-out fold."""
    usable = docs.where((remainder(key, FOLDS) != HELD_OUT) & F.col(language).isNotNull())
    share = min(1.0, sample / max(1, usable.select(key).count()))
    place = F.shiftrightunsigned(F.xxhash64(F.col(key).cast("string"), F.lit("language")), 11)  # 53 bits
    chosen = usable.where(place.cast("double") < share * 2.0**53)
    counted = chosen.select(F.col(language).alias("language"), F.col(text).alias("text")).mapInArrow(
        _count, "language string, size int, entry string, n bigint"
    )
    counts = Scratch(docs.sparkSession, "language").put(
        counted.groupBy("language", "size", "entry").agg(F.sum("n").alias("n")), "counts"
    )
    totals = counts.groupBy("language", "size").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), ["language", "size"])  # a row per language and length
    shares = shares.select("language", "size", "entry", (F.col("n") / F.col("total")).alias("share"))
    # Of each length the entries with the largest share in their language.
    rows = pa.concat_tables(
        [largest(shares.where(F.col("size") == n), "share", ROWS, "entry", "language").toArrow() for n in range(LONGEST + 1)]
    )
    languages = sorted(set(rows.column("language").to_pylist()))
    number = {name: i for i, name in enumerate(languages)}
    tables: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
    cells: list[list[tuple[int, int, float]]] = [[] for _ in range(LONGEST + 1)]
    for name, size, entry, share in zip(*(rows.column(c).to_pylist() for c in ("language", "size", "entry", "share")), strict=True):
        row = tables[size].setdefault(entry, len(tables[size]))
        cells[size].append((row, number[name], math.log10(share)))
    logs = [np.full((len(t), len(languages)), PENALTY) for t in tables]
    for size, found in enumerate(cells):
        for row, column, log in found:
            logs[size][row, column] = log
    return Model(languages, tables, logs)


def predicted(model, text: Column) -> Column:
    """struct(lang_pred, score) of a text column; ``model`` is a broadcast ``Model``."""

    @F.arrow_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def classify(column: pa.Array) -> pa.Array:
        names, sure = model.value.classify(texts(column))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(sure, pa.float64())], ["lang_pred", "score"])

    return classify(text)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang") -> DataFrame:
    """(``key``, held_out, lang_pred, score) for every row."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, key, text, language))
    held = F.coalesce(remainder(key, FOLDS) == HELD_OUT, F.lit(False))
    found = docs.select(F.col(key).alias("id"), held.alias("held_out"), predicted(model, F.col(text)).alias("p"))
    return found.select(F.col("id").alias(key), "held_out", "p.lang_pred", "p.score")


def keep(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", least: float = MIN_SCORE) -> DataFrame:
    """The rows whose language is recognised with a score of at least ``least``, with their columns."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, key, text, language))
    name = free_name(docs, "language_found")
    found = docs.withColumn(name, predicted(model, F.col(text)))
    return found.where((F.col(name)["lang_pred"] != UNKNOWN) & (F.col(name)["score"] >= least)).drop(name)
