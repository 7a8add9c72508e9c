"""Toxicity by a weighted finite-state grammar over clauses.

A lexical transducer maps words to classes: insults (whole words, or stems that any
ending may follow, with weights learned from labels), threats, targets, negations and
verbs of reporting. Five small transducers read the classes of a clause; their
composition is one automaton whose final states tell what kind of clause was read:
an insult or threat, aimed at someone or not, negated, reported. Only clauses with an
insult or threat are read, and a document is scored by the weights of its clauses,
never by isolated words.

What is learned comes from at most about ``SAMPLE`` labelled rows outside the held-out
fold, chosen by a hash of the id: the insults by greedy cover (each next entry is the
one that explains most toxic texts not yet explained, so words that merely share texts
with insults are not taken), then the weight of each kind of clause by a ridge
regression towards ``PRIOR``. Every text is then read whole.

Nulls and odd input: null and empty texts match nothing and get the score of a text
without a matched clause; rows with a null id or label are scored but not learned from; a
repeated label row counts once per row it labels; without any usable label no insult is
known and the priors decide; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from foliospark.llm.common import remainder, texts

FOLDS = 5
SAMPLE = 20_000
#: Entries of the learned lexicon at most, and toxic texts each must newly explain.
LEXICON = 300
SUPPORT = 3
#: Entries that should explain a text before it counts as explained.
DEPTH = 2
#: Different preceding words an entry must have been seen after; words of one copied text have few.
DIVERSITY = 5
#: Least log odds of an entry between toxic and other texts, and other texts allowed for each toxic one.
ODDS = 2.5
IMPURITY = 0.02
STEMS = (4, 5, 6)
#: How many words after a negation it still applies to.
REACH = 4
RIDGE = 0.1

# Word classes in English, German, French and Spanish.
THREATS = (
    "kill", "murder", "strangle", "stab", "umbringen", "töten", "erwürgen", "verprügeln", "tuer", "égorger", "étrangler",
    "matar", "matarte", "apuñalar", "estrangular",
)
TARGETS = (
    "you", "your", "you're", "u", "he", "she", "they", "them", "him", "her", "du", "dich", "dir", "ihr", "euch", "sie", "er",
    "tu", "toi", "te", "vous", "il", "elle", "ils", "usted", "ustedes", "tú", "él", "ella", "ellos",
)
NEGATIONS = (
    "not", "no", "never", "isn't", "aren't", "don't", "nicht", "kein", "keine", "niemals", "ne", "pas", "jamais", "non",
    "nunca", "jamás", "ni", "without", "ohne", "sans", "sin",
)
REPORTS = (
    "said", "says", "called", "calls", "quoted", "wrote", "reported", "sagte", "sagt", "schrieb", "nannte", "zitierte",
    "disait", "dit", "écrivit", "appelait", "citait", "dijo", "dice", "escribió", "llamó", "citó",
)

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
CLASSES = 6
FIXED = {w: c for c, listed in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in listed}
CLAUSE_END = ".!?;:"
MARKS = ".,!?;:\"'()[]{}<>*#$%&|-_/\\«»„“”…"

#: What a clause turns out to be, and the weight of one such clause before learning.
KINDS = ("insult", "aimed_insult", "negated_insult", "reported_insult", "threat", "aimed_threat", "negated_threat", "reported_threat")
PRIOR = (2.0, 3.0, 0.5, 0.5, 1.0, 3.0, 0.0, 0.5)
START_BIAS = -2.0


class Transducer:
    """A deterministic transducer over classes: ``arcs`` lead from (state, class) on; other classes keep the state."""

    def __init__(self, arcs: dict[tuple[str, int], str], start: str = "-"):
        self.arcs, self.start = arcs, start

    def step(self, state: str, read: int) -> str:
        return self.arcs.get((state, read), self.arcs.get((state, -1), state))


def _negation() -> Transducer:
    """``-1`` stands for any class without an arc of its own: each word uses up some of the reach."""
    arcs: dict[tuple[str, int], str] = {("-", NEGATION): str(REACH)}
    for left in range(REACH, 0, -1):
        arcs |= {(str(left), NEGATION): str(REACH), (str(left), INSULT): "negated", (str(left), THREAT): "negated"}
        arcs[(str(left), -1)] = str(left - 1) if left > 1 else "-"
    return Transducer(arcs)


PARTS = (
    Transducer({("-", INSULT): "insult"}),
    Transducer({("-", THREAT): "threat"}),
    Transducer({("-", TARGET): "aimed"}),
    _negation(),
    Transducer({("-", REPORT): "said", ("said", INSULT): "reported", ("said", THREAT): "reported"}),
)


def compose(parts: tuple[Transducer, ...] = PARTS) -> tuple[list[list[int]], list[int]]:
    """(next state by state and class, kind by state; -1 for a clause without insult or threat)."""
    start = tuple(p.start for p in parts)
    number, todo, table, kinds = {start: 0}, [start], [], []
    for state in todo:
        row = []
        for read in range(CLASSES):
            to = tuple(p.step(s, read) for p, s in zip(parts, state, strict=True))
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        table.append(row)
        insult, threat, target, negation, report = state
        how = 3 if report == "reported" else 2 if negation == "negated" else 1 if target == "aimed" else 0
        kinds.append(how if insult == "insult" else 4 + how if threat == "threat" else -1)
    return table, kinds


def words(text: bytes) -> list[str]:
    return text.decode("utf-8", "replace").lower().split()


def entries(word: str) -> list[str]:
    """What a lexicon may hold of a word: itself, and its stems with a star."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


class Grammar:
    """Lexicon, composed automaton and weights; ``features`` and ``scores`` read whole texts."""

    def __init__(self, lexicon: dict[str, float], weights: np.ndarray | None = None):
        self.lexicon = lexicon
        self.whole = {w: c for w, c in FIXED.items()} | {w: INSULT for w in lexicon if not w.endswith("*")}
        self.stems = {n: {w[:-1] for w in lexicon if w.endswith("*") and len(w) == n + 1} for n in STEMS}
        self.stems = {n: found for n, found in self.stems.items() if found}
        self.table, self.kinds = compose()
        self.weights = np.array([START_BIAS, *PRIOR]) if weights is None else weights

    def class_of(self, word: str) -> int:
        found = self.whole.get(word)
        if found is None:
            found = OTHER
            for n, stems in self.stems.items():
                if word[:n] in stems:
                    return INSULT
        return found

    def read(self, text: bytes) -> list[int]:
        """The kinds of the matched clauses, in order. Clauses end at punctuation and at line ends."""
        found = []
        memory: dict[str, int] = {}
        for line in text.decode("utf-8", "replace").lower().split("\n"):
            tokens = line.split()
            if not tokens:
                continue
            state, hit = 0, False
            for token in tokens:
                read = memory.get(token)
                if read is None:
                    read = memory[token] = self.class_of(token.strip(MARKS)) | (8 if token[-1] in CLAUSE_END else 0)
                if read:
                    kind = read & 7
                    hit = hit or kind == INSULT or kind == THREAT
                    state = self.table[state][kind]
                    if read & 8:
                        if hit:
                            found.append(self.kinds[state])
                        state, hit = 0, False
                elif state:
                    state = self.table[state][OTHER]
            if hit:
                found.append(self.kinds[state])
        return found

    def features(self, text: bytes) -> np.ndarray:
        """log(1 + clauses) of each kind."""
        return np.log1p(np.bincount(self.read(text), minlength=len(KINDS)).astype(float)) if text else np.zeros(len(KINDS))

    def scores(self, batch: Iterable[bytes]) -> np.ndarray:
        rows = np.array([self.features(t) for t in batch]).reshape(-1, len(KINDS))
        return 1 / (1 + np.exp(-(self.weights[0] + rows @ self.weights[1:])))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (toxic, text) -> (entry, toxic texts, other texts)."""
    held: tuple[Counter[str], Counter[str]] = Counter(), Counter()
    for batch in batches:
        for toxic, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
            held[1 if toxic else 0].update({e for w in {t.strip(MARKS) for t in words(text)} if w for e in entries(w)})
    # An entry that no toxic text of this task has may still be counted elsewhere, so all are sent.
    for side in (1, 0):
        names, counts = list(held[side]), list(held[side].values())
        for at in range(0, len(names), 100_000):
            n = counts[at : at + 100_000]
            zero = [0] * len(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(names[at : at + 100_000]), pa.array(n if side else zero, pa.int64()), pa.array(zero if side else n, pa.int64())],
                ["entry", "toxic", "other"],
            )


def _explained(candidates):
    """Rows (text) of toxic texts -> numbers of the candidate entries, each with a checksum of the word before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = candidates.value
        for batch in batches:
            rows = []
            for text in texts(batch.column(0)):
                tokens = [t.strip(MARKS) for t in words(text)]
                pairs = zip(tokens, ["", *tokens], strict=False)
                rows.append(sorted({(number[e], zlib.crc32(b.encode())) for w, b in pairs if w for e in entries(w) if e in number}))
            lists = [pa.array([[p[i] for p in r] for r in rows], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(lists, ["has", "after"])

    return run


def cover(
    has: list[np.ndarray], odds: np.ndarray, limit: int = LEXICON, support: int = SUPPORT, depth: int = DEPTH
) -> list[int]:
    """Greedy cover: the entry with the largest sum of log odds over texts not yet explained ``depth`` times,
    until no entry has ``support`` such texts."""
    owner = np.repeat(np.arange(len(has)), [len(h) for h in has])
    entry = np.concatenate([*has, np.zeros(0, np.int64)]).astype(np.int64)
    times = np.zeros(len(has), np.int64)
    chosen: list[int] = []
    while len(entry) and len(chosen) < limit:
        news = np.bincount(entry, minlength=len(odds))
        best = int(np.argmax(np.where(news >= support, news * odds, 0)))
        if news[best] < support:
            break
        chosen.append(best)
        times[owner[entry == best]] += 1
        left = (times[owner] < depth) & (entry != best)
        owner, entry = owner[left], entry[left]
    return chosen


def regression(rows: np.ndarray, toxic: np.ndarray, ridge: float = RIDGE, rounds: int = 30) -> np.ndarray:
    """Logistic regression (bias first) by Newton's method, pulled towards the priors; kinds never count against toxicity."""
    prior = np.array([START_BIAS, *PRIOR])
    full = np.hstack([np.ones((len(rows), 1)), rows])
    weights = prior.copy()
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-np.clip(full @ weights, -30, 30)))
        slope = full.T @ (toxic - chance) - ridge * (weights - prior)
        bend = (full * (chance * (1 - chance))[:, None]).T @ full + ridge * np.eye(len(prior))
        step = np.linalg.solve(bend, slope)
        weights = weights + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    weights[1:] = np.maximum(weights[1:], 0)
    return weights


def _labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label_key: str, toxic: str, sample: int) -> DataFrame:
    """(toxic, text) of at most about ``sample`` labelled rows. Only the chosen labels are joined, so no text is shuffled."""
    usable = labels.select(F.col(label_key).alias("label_id"), F.col(toxic).alias("toxic")).where(
        (remainder("label_id", FOLDS) != 0) & F.col("toxic").isNotNull()
    )
    share = min(1.0, sample / max(1, usable.count()))
    place = F.shiftrightunsigned(F.xxhash64(F.col("label_id").cast("string"), F.lit("toxicity")), 11)
    chosen = usable.where(place.cast("double") < share * 2.0**53).groupBy("label_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    return rows.join(F.broadcast(chosen), rows["id"] == chosen["label_id"]).select("toxic", "text")


def learn(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_key: str = "doc_id", toxic: str = "toxic",
    sample: int = SAMPLE,
) -> Grammar:
    context = docs.sparkSession.sparkContext
    rows = _labelled(docs, labels, key, text, label_key, toxic, sample)
    sides = {bool(t): n for t, n in rows.groupBy((F.col("toxic") > 0).alias("t")).count().collect()}
    n_toxic, n_other = sides.get(True, 0), sides.get(False, 0)
    if not n_toxic or not n_other:
        return Grammar({})
    counts = rows.mapInArrow(_count, "entry string, toxic bigint, other bigint").groupBy("entry").agg(
        F.sum("toxic").alias("toxic"), F.sum("other").alias("other")
    )
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1.0)) - F.log((F.col("other") + 0.5) / (n_other + 1.0))
    found = (
        counts.where(F.col("toxic") >= SUPPORT)
        .withColumn("odds", odds)
        .where((F.col("odds") >= ODDS) & (F.col("other") <= IMPURITY * F.col("toxic")))
        .orderBy(F.desc(F.col("odds") * F.col("toxic")), "entry")
        .limit(200 * LEXICON)
        .toArrow()
    )
    names, weights = found.column("entry").to_pylist(), found.column("odds").to_numpy()
    seen = rows.where("toxic > 0").select("text").mapInArrow(
        _explained(context.broadcast({e: i for i, e in enumerate(names)})), "has array<bigint>, after array<bigint>"
    ).toArrow()
    has, after = (seen.column(c).to_pylist() for c in ("has", "after"))
    contexts = np.unique(np.array([p for x, y in zip(has, after, strict=True) for p in zip(x, y, strict=True)]).reshape(-1, 2), axis=0)
    diverse = np.bincount(contexts[:, 0].astype(np.int64), minlength=len(names)) >= DIVERSITY
    # A whole word is preferred to a stem that explains hardly more.
    worth = weights * np.array([1.0 if not e.endswith("*") else 0.85 + 0.02 * len(e) for e in names])
    chosen = cover([np.unique([e for e in h if diverse[e]]) for h in has], worth)
    grammar = Grammar({names[i]: float(weights[i]) for i in chosen})
    sent = context.broadcast(grammar)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.features(t).tolist() for t in texts(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.float64()), pa.array(found, pa.list_(pa.float64()))], ["toxic", "kinds"])

    table = rows.mapInArrow(read, "toxic double, kinds array<double>").toArrow()
    grammar.weights = regression(
        np.array(table.column("kinds").to_pylist()).reshape(-1, len(KINDS)), (table.column("toxic").to_numpy() > 0).astype(float)
    )
    return grammar


def scored(grammar, text: Column) -> Column:
    """The score of a text column; ``grammar`` is a broadcast ``Grammar``."""

    @F.arrow_udf(T.DoubleType())
    def score(column: pa.Array) -> pa.Array:
        return pa.array(grammar.value.scores(texts(column)), pa.float64())

    return score(text)


def scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label_key: str = "doc_id", toxic: str = "toxic") -> DataFrame:
    """(``key``, held_out, score, predicted) for every row."""
    grammar = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, key, text, label_key, toxic))
    held = F.coalesce(remainder(key, FOLDS) == 0, F.lit(False))
    found = docs.select(F.col(key).alias("id"), held.alias("held_out"), scored(grammar, F.col(text)).alias("score"))
    return found.select(F.col("id").alias(key), "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
