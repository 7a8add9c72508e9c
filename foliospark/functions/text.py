"""Column -> Column text primitives.

Character classes are spelled out instead of using ``\\w``/``\\s``/``\\b``: those
mean ASCII in the JVM but Unicode in most text tools, and the explicit classes
give one meaning everywhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Unicode white space: tab..carriage return, the four separators, space, NEL, all of Z.
WS = r"[\t-\r\x1c- \x{85}\p{Z}]"
# The ASCII ranges are redundant but let the regex engine test common characters first.
WORD = r"[a-z0-9_\p{L}\p{N}]"
NON_WORD = r"[^\p{L}\p{N}_]"
HAS_WORD = r"[a-zA-Z0-9_\p{L}\p{N}]"
LETTER_OR_DIGIT = r"[a-z0-9\p{L}\p{N}]"
# Line ends in the sense of a universal-newline reader.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
# Decimal digits plus the superscript and subscript digits.
ANY_NON_DIGIT = r"[^\p{Nd}²³¹⁰⁴-⁹₀-₉]"
NON_DIGIT = ANY_NON_DIGIT + "+"
NON_LETTER = r"[^\p{L}]+"

# Accented Latin letters and the base letter each one folds to.
ACCENTED = "áàâãäåāéèêëēíìîïīóòôõöōúùûüūçñýÿ"
UNACCENTED = "aaaaaaaeeeeeiiiiioooooouuuuucnyy"


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``.

    A lambda variable is evaluated once per row, whatever the optimizer does with
    projections and filters around it; naming the value with ``withColumn`` gives
    no such guarantee inside higher-order functions.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column | str) -> Column:
    return F.regexp_replace(col(text), f"^{WS}+|{WS}+$", "")


def casefold(text: Column | str) -> Column:
    """Case folding for the alphabets in use: lower case, sharp s, final sigma, long s."""
    return F.replace(F.translate(F.lower(col(text)), "ςſ", "σs"), F.lit("ß"), F.lit("ss"))


def collapse_ws(text: Column | str) -> Column:
    return F.regexp_replace(col(text), f"{WS}+", " ")


def tokens(text: Column | str) -> Column:
    """Lower-cased word tokens, in order, as an array."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(f"{WORD}+"), 0)


def folded_tokens(text: Column | str) -> Column:
    """Word tokens after case folding."""
    return F.regexp_extract_all(casefold(text), F.lit(f"{WORD}+"), 0)


def search_tokens(text: Column | str) -> Column:
    """Full-text-search tokens: accents folded and ``_`` treated as a separator."""
    folded = F.translate(F.lower(col(text)), ACCENTED, UNACCENTED)
    return F.regexp_extract_all(folded, F.lit(f"{LETTER_OR_DIGIT}+"), 0)


def fingerprint(text: Column | str) -> Column:
    """SHA-256 of the text after lower-casing and white-space normalisation."""
    return F.sha2(collapse_ws(strip(F.lower(col(text)))), 256)


def sanitize(text: Column | str) -> Column:
    """Normalise line ends, drop NULs, blank out control characters, squeeze blanks."""
    out = F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\r\n?", "\n")
    out = F.regexp_replace(out, r"\x00", "")
    out = F.regexp_replace(out, r"[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]", " ")
    out = F.regexp_replace(out, r"[ \t]+", " ")
    out = F.regexp_replace(out, r" ?\n ?", "\n")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return strip(out)


def letters(text: Column | str) -> Column:
    return F.length(F.regexp_replace(col(text), NON_LETTER, ""))


def digits(text: Column | str) -> Column:
    return F.length(F.regexp_replace(col(text), NON_DIGIT, ""))


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` with 0.0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def lines(text: Column | str) -> Column:
    """Non-blank lines, trimmed, case-folded, with inner white space squeezed."""
    raw = F.split(col(text), LINE_END)
    return F.filter(F.transform(raw, lambda x: collapse_ws(casefold(strip(x)))), lambda x: x != "")


def preview(text: Column | str, limit: int, ellipsis: str = "...") -> Column:
    c = col(text)
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(ellipsis))).otherwise(c)


def prompt_hash(prompt: Column | str) -> Column:
    """First 16 hex digits of the SHA-256 of a prompt."""
    return F.substring(F.sha2(col(prompt).cast("binary"), 256), 1, 16)


def ask_key(query: Column | str, top_k: Column, mode: Column) -> Column:
    """Cache key of a question with its search settings."""
    return F.concat(F.lit("ask:"), prompt_hash(F.concat_ws(":", col(query), top_k.cast("string"), mode)))


def file_name(path: Column | str) -> Column:
    return F.substring_index(F.replace(col(path), F.lit("\\"), F.lit("/")), "/", -1)


def file_stem(path: Column | str) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def file_extension(path: Column | str) -> Column:
    """Lower-cased suffix including the dot, '' when there is none."""
    return F.lower(F.regexp_extract(file_name(path), r".(\.[^.]+)$", 1))


def portable_path(path: Column | str, base: str = "") -> Column:
    """Path with forward slashes, without a leading ``./``, relative to ``base`` if it lies below it."""
    clean = F.regexp_replace(F.replace(col(path), F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    root = base.replace("\\", "/").rstrip("/") + "/"
    return F.when(clean.startswith(root), F.substr(clean, F.lit(len(root) + 1))).otherwise(clean) if base else clean


def term_counts(tokens_array: Column | str) -> Column:
    """array<struct<term, tf, first>> counted inside each row.

    The tokens are sorted once per row and read as runs, so the cost is n log n
    in the length of the text and no shuffle takes place; ``first`` is the
    position of the first occurrence.
    """
    placed = F.transform(col(tokens_array), lambda t, i: F.struct(t.alias("t"), i.alias("i")))

    def run_starts(ordered: Column) -> Column:
        marks = F.transform(
            ordered, lambda x, i: F.when((i == 0) | (x["t"] != F.get(ordered, i - 1)["t"]), i)
        )
        return F.array_compact(marks)

    def runs(ordered: Column, starts: Column) -> Column:
        return F.transform(
            starts,
            lambda p, j: F.struct(
                F.get(ordered, p)["t"].alias("term"),
                (F.coalesce(F.get(starts, j + 1), F.size(ordered)) - p).alias("tf"),
                F.get(ordered, p)["i"].alias("first"),
            ),
        )

    return let(F.sort_array(placed), lambda ordered: let(run_starts(ordered), lambda starts: runs(ordered, starts)))


def top_terms(counts: Column | str, limit: int) -> Column:
    """The ``limit`` most frequent terms of a term-count array, earliest first on ties."""
    ranked = F.sort_array(
        F.transform(
            col(counts),
            lambda x: F.struct((-x["tf"]).alias("n"), x["first"].alias("p"), x["term"].alias("term")),
        )
    )
    return F.transform(F.slice(ranked, 1, limit), lambda x: x["term"])
