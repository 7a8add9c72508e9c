"""Input and output guardrails, intent routing and text matching as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from foliospark.functions import text as tx

# A word boundary in the ASCII sense, for both sides of a pattern.
ASCII_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
SP = r"[\t-\r \p{Z}\x{feff}]"

# Personal-data patterns, their replacements and the characters one can begin
# with, in the order they apply. EDGE stands for a word boundary and SP for one white-space character.
PII = (
    (r"EDGE\d{3}(?:\.|SP)?\d{3}(?:\.|SP)?\d{3}(?:[.-]|SP)?\d{2}EDGE", "[CPF REDACTED]", "0-9"),
    (r"EDGE[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}EDGE", "[EMAIL REDACTED]", "A-Za-z0-9._%+-"),
    (r"EDGE(?:\+55SP?)?(?:\(?\d{2}\)?SP?)(?:9SP?)?\d{4}(?:[-.]|SP)?\d{4}EDGE", "[TELEFONE REDACTED]", "+(0-9"),
    (r"EDGE(?:\d{4}(?:[-.]|SP)?){3}\d{4}EDGE", "[CARTAO REDACTED]", "0-9"),
)
# Prompt-injection and command patterns (case-insensitive), each with a word it needs.
INJECTION = (
    (r"ignoreSP+(previous|all|your)SP+(instructions?|prompts?|rules?)", "ignore"),
    (r"disregardSP+(all|your)SP+(instructions?|prompts?|rules?)", "disregard"),
    (r"youSP+areSP+nowSP+(a|an)SP+", "you"),
    (r"pretendSP+(you|that)SP+(are|you)", "pretend"),
    (r"systemSP*:SP*override", "system"),
    (r"EDGEdropSP+tableEDGE", "drop"),
    (r"EDGEdeleteSP+fromEDGE", "delete"),
    (r";SP*(rm|del|format|shutdown|reboot)SP", ";"),
    (r"EDGE(exec|eval|spawn)SP*\(", "("),
)
MAX_CHARS = 8000

# Routing keywords in order of precedence.
EXTRACTION_WORDS = (
    "extraia", "extrai", "extrair", "liste", "listar", "tabela", "campos", "dados", "estruturado", "json", "schema",
    "parse", "formato", "preencha", "preencher",
)
TOOL_WORDS = ("execute", "fazer", "realizar", "acao", "ative", "chame", "api", "envie", "calcule")
KNOWLEDGE_WORDS = (
    "quem", "quando", "onde", "como", "por que", "qual", "o que", "explique", "descreva", "resumo", "sobre",
    "informacao", "informações", "documento", "documentos", "contrato", "lei", "artigo",
)


def pattern(spec: str, edge: str = ASCII_EDGE) -> str:
    return spec.replace("EDGE", edge).replace("SP", SP)


def mask_pii(text: Column | str) -> Column:
    """Replace CPF, e-mail, phone and card numbers, in that order.

    Each pattern first looks at the character it would have to begin with, and the
    e-mail pattern only runs on texts holding an ``@``.
    """
    out = tx.col(text)
    for spec, label, lead in PII:
        masked = F.regexp_replace(out, f"(?=[{lead}]){pattern(spec)}", label.replace("[", r"\["))
        out = F.when(F.contains(out, F.lit("@")), masked).otherwise(out) if "@" in spec else masked
    return out


def is_injection(text: Column | str) -> Column:
    """Plain substring search first; a pattern only runs on texts that hold its word."""
    low = F.lower(tx.col(text))
    tests = [F.contains(low, F.lit(cue)) & low.rlike(pattern(spec)) for spec, cue in INJECTION]
    return reduce(lambda a, b: a | b, tests)


def is_too_long(text: Column | str, limit: int = MAX_CHARS) -> Column:
    return F.length(tx.col(text)) > limit


def check_input(text: Column | str) -> Column:
    """struct(passed, reason): the content filter runs before the length guard."""
    t = tx.col(text)
    reason = F.when(is_injection(t), "content_filter").when(is_too_long(t), "max_tokens")
    return F.struct(reason.isNull().alias("passed"), reason.alias("reason"))


def check_output(text: Column | str) -> Column:
    """struct(passed, reason, modified): length guard, then personal data is masked."""
    t = tx.col(text)
    reason = F.when(is_too_long(t), "max_tokens")
    masked = mask_pii(t)
    modified = F.when(reason.isNull() & (masked != t), masked)
    return F.struct(reason.isNull().alias("passed"), reason.alias("reason"), modified.alias("modified"))


def contains_any(text: Column, words) -> Column:
    test = F.lit(False)
    for w in words:
        test = test | F.contains(text, F.lit(w))
    return test


def route_intent(text: Column | str) -> Column:
    """Agent that should answer: extraction beats tool beats knowledge, which is the default."""
    low = F.lower(tx.col(text))
    return (
        F.when(contains_any(low, EXTRACTION_WORDS), "extraction_agent")
        .when(contains_any(low, TOOL_WORDS), "tool_agent")
        .otherwise("knowledge_agent")
    )


def route_reason(text: Column | str) -> Column:
    low = F.lower(tx.col(text))
    return (
        F.when(contains_any(low, EXTRACTION_WORDS), "extraction")
        .when(contains_any(low, TOOL_WORDS), "action")
        .when(contains_any(low, KNOWLEDGE_WORDS), "knowledge")
        .otherwise("default")
    )


def handoff_target(text: Column | str) -> Column:
    found = F.regexp_extract(tx.col(text), r"\[HANDOFF:([a-z_]+)\]", 1)
    return F.when(found != "", found)


def key_fact(text: Column | str) -> Column:
    """First sentence fragment after "fonte(s):", at most 100 characters."""
    found = tx.strip(F.regexp_extract(tx.col(text), r"(?i)fontes?:?\s*([^\n.]+)", 1))
    return F.when(found != "", F.substring(found, 1, 100))


def plain_words(text: Column | str) -> Column:
    """Accent-free lower-case words separated by single blanks."""
    folded = F.translate(F.lower(tx.col(text)), tx.ACCENTED, tx.UNACCENTED)
    return F.trim(F.regexp_replace(folded, r"[^a-z0-9]+", " "))


def action_score(intent: Column, action: Column) -> Column:
    """Match of a named action to an intent; both already reduced to plain words."""
    shared = F.filter(F.split(action, " "), lambda w: (w != "") & F.array_contains(F.split(intent, " "), w))
    return (
        F.when((intent == "") | (action == ""), 0)
        .when(F.contains(intent, action), F.length(action) + 5)
        .otherwise(F.size(shared))
    )


def select_action(intent: Column | str, actions: list[str]) -> Column:
    """Best-scoring allowed action (the earlier one on ties); null when nothing matches."""
    if len(actions) == 1:
        return F.lit(actions[0])
    plain = plain_words(intent)
    scored = F.array(
        *[
            F.struct(
                action_score(plain, plain_words(F.lit(a))).alias("score"), F.lit(-i).alias("order"), F.lit(a).alias("action")
            )
            for i, a in enumerate(actions)
        ]
    )
    return tx.let(F.array_max(scored), lambda best: F.when(best["score"] > 0, best["action"]))
