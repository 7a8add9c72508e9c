"""Portuguese suffix stripping for a vocabulary: one row per word, ordered rules, no Python per row.

The rules are the published Snowball rules for Portuguese. A word has three regions, given
by where they start: R1 after the first non-vowel that follows a vowel, R2 the same inside
R1, RV after the third letter or a later one. The longest suffix of a group decides; it is
cut only if it lies in its region. Stems are folded (accents, case) afterwards, as queries
are matched without accents.

Meant for the distinct words of a corpus, which are joined back, never for texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliospark.functions import text as tx

# Fixed values. Nasal vowels are written as vowel and tilde while rules apply.
NASAL = (("ã", "a~"), ("õ", "o~"))
VOWELS = "aeiouáéíóúâêô"
V, C = f"[{VOWELS}]", f"[^{VOWELS}]"
REGION_1 = f"^{C}*{V}+{C}"
REGION_2 = f"^{C}*{V}+{C}{C}*{V}+{C}"
REGION_V = f"^(?:.{C}{C}*{V}|{V}{V}+{C}|{C}{V}.)"

# Endings by what happens to them.
CUT = "ezas?|ic[oa]s?|ismos?|ável|ível|istas?|os[oa]s?|[ai]mentos?|ador(?:a|as|es)?|aça~o|aço~es|antes?|ância"
REPLACED = (("logias?", "log"), ("uça~o|uço~es", "u"), ("ências?", "ente"))
#: ending -> endings that may stand before it and go with it.
WITH_INNER = (("mente", "ante|avel|ível"), ("idades?", "abil|ic|iv"), ("iv[oa]s?", "at"))
ADVERB_INNER = "iv|os|ic|ad"
STANDARD = "|".join(["amente", "iras?", CUT, *(p for p, _ in REPLACED), *(p for p, _ in WITH_INNER)])
VERB = (
    "[aei]r(?:ia|á|a|ei|iam|am|em|a~o|ias|ás|as|des|es|íeis|eis|íamos|emos|mos)?|[áéí]r(?:eis|amos)|[aei]ss(?:e|em|es)|[áéí]sseis"
    "|[áêí]ssemos|[aei]stes?|[ai]d[oa]s?|[aei]ndo|ava[ms]?|áveis|ávamos|[áaei]mos|íamos|ia[ms]?|íeis|am|em|as|es|is|ais|eis|ei|eu|iu|ou"
)
RESIDUAL = "os|a|i|o|á|í|ó"


def _ends(word: Column, pattern: str) -> Column:
    """The longest of some endings, empty if none fits (the leftmost match is the longest)."""
    return F.regexp_extract(word, f"(?:{pattern})$", 0)


def _less(word: Column, ending: Column) -> Column:
    return F.left(word, F.length(word) - F.length(ending))


def _inside(word: Column, ending: Column, start: Column) -> Column:
    """A non-empty ending of the word that lies behind ``start`` letters."""
    return (ending != "") & (F.length(word) - F.length(ending) >= start)


def _whole(value: Column, pattern: str) -> Column:
    return value.rlike(f"^(?:{pattern})$")


def stem(word: Column | str) -> Column:
    """The stem of a lower-cased word; null for null."""
    nasal = tx.col(word)
    for letter, spelled in NASAL:
        nasal = F.replace(nasal, F.lit(letter), F.lit(spelled))
    return tx.let(nasal, _stem)


def _stem(w: Column) -> Column:
    start = lambda pattern: F.coalesce(F.nullif(F.length(F.regexp_extract(w, pattern, 0)), F.lit(0)), F.length(w))
    ending = _ends(w, STANDARD)
    parts = F.struct(
        start(REGION_1).alias("r1"), start(REGION_2).alias("r2"), start(REGION_V).alias("rv"), ending.alias("s"), _less(w, ending).alias("b")
    )
    return tx.let(parts, lambda p: tx.let(_standard(w, p), lambda x: tx.let(_verb(w, x, p["rv"]), lambda y: _finish(w, y, p["rv"]))))


def _standard(w: Column, p: Column) -> Column:
    """Derivational endings; the word itself where none applies."""
    s, b, at = p["s"], p["b"], F.length(p["b"])
    inner = F.when(s == "amente", _ends(b, ADVERB_INNER))
    for ending, before in WITH_INNER:
        inner = inner.when(_whole(s, ending), _ends(b, before))

    def choose(i: Column) -> Column:
        cut = F.when(_inside(b, i, p["r2"]), _less(b, i)).otherwise(b)
        short = _less(b, i)
        further = (i == "iv") & _inside(b, i, p["r2"]) & _inside(short, _ends(short, "at"), p["r2"])
        out = (
            F.when(s == "", w)
            .when((s == "amente") & (at < p["r1"]), w)
            .when(s == "amente", F.when(further, _less(short, F.lit("at"))).otherwise(cut))
            .when(_whole(s, "iras?"), F.when((at >= p["rv"]) & b.endswith("e"), F.concat(b, F.lit("ir"))).otherwise(w))
            .when(at < p["r2"], w)
        )
        for ending, put in REPLACED:
            out = out.when(_whole(s, ending), F.concat(b, F.lit(put)))
        return out.otherwise(cut)

    return tx.let(inner.otherwise(""), choose)


def _verb(w: Column, x: Column, rv: Column) -> Column:
    """Verb endings, where nothing was cut so far."""
    return F.when(x != w, x).otherwise(_less(w, _ends(F.substring(w, rv + 1, F.length(w)), VERB)))


def _finish(w: Column, y: Column, rv: Column) -> Column:
    """Last vowels, nasal vowels back, accents folded."""
    rest, short = _ends(y, RESIDUAL), F.left(y, F.length(y) - 1)
    soft = y.endswith("ci") & (F.length(y) - 1 >= rv)
    altered = F.when(soft, short).otherwise(y)
    plain = F.when(_inside(y, rest, rv), _less(y, rest)).otherwise(y)

    def vowel(x: Column) -> Column:
        cut = F.left(x, F.length(x) - 1)
        again = _ends(cut, "gu|ci").isin("gu", "ci") & (F.length(cut) - 1 >= rv)
        ended = F.when(again, F.left(cut, F.length(cut) - 1)).otherwise(F.regexp_replace(cut, "ç$", "c"))
        out = F.when(_inside(x, _ends(x, "[eéê]"), rv), ended).otherwise(F.regexp_replace(x, "ç$", "c"))
        return F.translate(F.replace(out, F.lit("~"), F.lit("")), tx.ACCENTED, tx.UNACCENTED)

    return tx.let(F.when(y != w, altered).otherwise(plain), vowel)


def with_stems(words: DataFrame, word: str = "term", name: str = "stem") -> DataFrame:
    """``words`` with the stems of a column."""
    return words.withColumn(name, stem(word))
