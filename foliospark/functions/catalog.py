"""Catalogue metadata inferred from a document's path and opening text."""

from __future__ import annotations

from collections.abc import Collection
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from foliospark.functions import text as tx

# How much text the inference looks at: a rule of the catalogue, not a sampling of the data.
INFERENCE_CHARS = 8000
MAX_STACK = 8
MAX_CONCEPTS = 10

# Themes and the substrings that count towards each, in order of precedence.
THEMES: dict[str, tuple[str, ...]] = {
    "ia_aplicada": ("llm", "rag", "agent", "agents", "prompt", "embedding", "vector", "nlp", "machine learning",
                    "deep learning", "artificial intelligence"),
    "arquitetura": ("architecture", "clean architecture", "ddd", "domain-driven", "microservice", "microservices",
                    "distributed systems", "design pattern", "system design", "cqrs", "event sourcing"),
    "backend": ("api", "rest", "grpc", "backend", "server", "nestjs", "node", "django", "flask", "fastapi",
                "spring", "http"),
    "bancos": ("sql", "mongodb", "postgres", "postgresql", "mysql", "redis", "database", "query", "index",
               "transaction"),
    "cloud": ("docker", "kubernetes", "aws", "azure", "gcp", "cloud", "devops", "terraform", "observability", "linux"),
    "debugging": ("debug", "debugging", "troubleshoot", "profiling", "performance", "latency", "trace", "testing"),
}

# Word boundaries with Unicode meaning, spelled out.
EDGE_L = r"(^|[^\p{L}\p{N}_])"
EDGE_R = r"($|[^\p{L}\p{N}_])"
INSIDE = r"[\p{L}\p{N}_]"


class Cue(NamedTuple):
    """What reveals a label: whole words, raw substrings, or (substring, regex) pairs."""

    words: tuple[str, ...] = ()
    phrases: tuple[str, ...] = ()
    patterns: tuple[tuple[str, str], ...] = ()


# Technology labels and what detects each. "c#" only counts with a word
# character after it, ".net" only with one before it.
STACK: dict[str, Cue] = {
    "python": Cue(("python",)),
    "typescript": Cue(("typescript", "ts")),
    "javascript": Cue(("javascript", "node")),
    "java": Cue(("java", "spring")),
    "csharp": Cue(("dotnet",), (), (("c#", f"{EDGE_L}c#{INSIDE}"), (".net", f"{INSIDE}\\.net{EDGE_R}"))),
    "go": Cue(("go", "golang")),
    "rust": Cue(("rust",)),
    "nestjs": Cue(("nestjs", "nest")),
    "django": Cue(("django",)),
    "fastapi": Cue(("fastapi",)),
    "flask": Cue(("flask",)),
    "mongodb": Cue(("mongodb", "atlas")),
    "postgres": Cue(("postgres", "postgresql")),
    "mysql": Cue(("mysql",)),
    "redis": Cue(("redis",)),
    "docker": Cue(("docker",)),
    "kubernetes": Cue(("kubernetes", "k8s")),
    "aws": Cue(("aws",)),
    "azure": Cue(("azure",)),
    "gcp": Cue(("gcp",), (), (("google cloud", f"{EDGE_L}google cloud{EDGE_R}"),)),
    "rag": Cue(("rag",), ("retrieval augmented generation",)),
    "langchain": Cue(("langchain",)),
}

# Concept labels and what detects each.
CONCEPTS: dict[str, Cue] = {
    "clean_architecture": Cue((), ("clean architecture",)),
    "ddd": Cue(("ddd",), ("domain-driven design",)),
    "cqrs": Cue(("cqrs",)),
    "event_sourcing": Cue((), ("event sourcing",)),
    "microservices": Cue((), ("microservice",)),
    "observability": Cue((), ("observability", "metrics", "tracing", "logging")),
    "testing": Cue(("testing", "test"), ("pytest", "jest", "tdd")),
    "debugging": Cue((), ("debugging", "troubleshooting", "profiling")),
    "prompt_engineering": Cue((), ("prompt engineering", "prompting")),
    "embeddings": Cue((), ("embedding",)),
    "vector_search": Cue((), ("vector search", "similarity search")),
    "agents": Cue((), ("agent",)),
    "rag": Cue(("rag",), ("retrieval augmented generation",)),
    "distributed_systems": Cue((), ("distributed system",)),
    "performance": Cue((), ("performance", "latency", "throughput", "optimization")),
}


def spaced_words(text: Column) -> Column:
    """The text with every non-word character blanked and padded, for whole-word look-ups."""
    return F.concat(F.lit(" "), F.regexp_replace(text, tx.NON_WORD, " "), F.lit(" "))


def detects(cue: Cue, text: Column, spaced: Column) -> Column:
    """Plain substring searches; a regular expression only runs after its substring was found."""
    tests = [F.contains(spaced, F.lit(f" {w} ")) for w in cue.words]
    tests += [F.contains(text, F.lit(p)) for p in cue.phrases]
    tests += [F.contains(text, F.lit(hint)) & text.rlike(p) for hint, p in cue.patterns]
    return reduce(lambda a, b: a | b, tests)


def inference_text(path: Column | str, content: Column | str) -> Column:
    """Stem, path parts and opening of the text, white space squeezed and case-folded."""
    p = tx.col(path)
    parts = F.array_join(F.filter(F.split(p, "/"), lambda x: x != ""), " ")
    joined = F.concat_ws("\n", tx.file_stem(p), parts, F.substring(tx.col(content), 1, INFERENCE_CHARS))
    return tx.casefold(tx.collapse_ws(joined))


def theme(text: Column) -> Column:
    """Theme with the most distinct keyword hits; the first theme wins ties, null without a hit."""
    scores = F.array(
        *[
            sum((F.contains(text, F.lit(k)).cast("int") for k in keywords), F.lit(0))
            for keywords in THEMES.values()
        ]
    )
    names = F.array(*[F.lit(n) for n in THEMES])
    best = lambda s: F.when(
        F.array_max(s) > 0, F.get(names, (F.array_position(s, F.array_max(s)) - 1).cast("int"))
    )
    return tx.let(scores, best)


def matches(text: Column, spaced: Column, cues: dict[str, Cue], limit: int) -> Column:
    found = F.array(*[F.when(detects(cue, text, spaced), F.lit(label)) for label, cue in cues.items()])
    return F.slice(F.array_compact(found), 1, limit)


def normalize_list(items: Column) -> Column:
    """Trimmed, non-empty, unique items in first-seen order."""
    return F.array_distinct(F.filter(F.transform(items, tx.strip), lambda x: x != ""))


def split_list(text: Column | str) -> Column:
    return normalize_list(F.split(tx.col(text), "[,;|]"))


def humanized_title(stem: Column) -> Column:
    spaced = tx.collapse_ws(F.regexp_replace(stem, r"[_.]+", " "))
    title = F.regexp_replace(spaced, r"^[ \-_]+|[ \-_]+$", "")
    return F.when(title == "", stem).otherwise(title)


def author_from_stem(stem: Column) -> Column:
    """Last `` - ``/`` — ``/`` _ `` separated part of the stem, if it is at most five words."""
    parts = F.filter(F.transform(F.split(stem, f"{tx.WS}+[-—_]{tx.WS}+"), tx.strip), lambda p: p != "")

    def pick(found: Column) -> Column:
        last = F.try_element_at(found, F.lit(-1))
        words = F.size(F.split(last, f"{tx.WS}+"))
        return F.when((F.size(found) >= 2) & (words <= 5), last)

    return tx.let(parts, pick)


def metadata(path: Column | str, content: Column | str, declared: Column | None = None, fields: Collection[str] = ()) -> Column:
    """Struct with title, author, theme, stack, concepts, file_name and file_extension.

    ``declared`` is a struct of what a file says of itself; ``fields`` are those of the five
    that it has. A declared value, trimmed, goes before the inferred one unless it is null or
    blank; a declared list is an array of strings.
    """
    p = tx.col(path)

    def given(name: str, inferred: Column) -> Column:
        if name not in fields:
            return inferred
        own = declared[name]
        if name in ("stack", "concepts"):
            own = normalize_list(own)
            return F.when(F.size(own) > 0, own).otherwise(inferred)
        return F.coalesce(F.nullif(tx.strip(own), F.lit("")), inferred)

    stem = tx.file_stem(p)
    prepared = tx.let(
        inference_text(p, content), lambda t: F.struct(t.alias("t"), spaced_words(t).alias("w"))
    )
    return tx.let(
        prepared,
        lambda b: F.struct(
            given("title", humanized_title(stem)).alias("title"),
            given("author", author_from_stem(stem)).alias("author"),
            given("theme", theme(b["t"])).alias("theme"),
            given("stack", matches(b["t"], b["w"], STACK, MAX_STACK)).alias("stack"),
            given("concepts", matches(b["t"], b["w"], CONCEPTS, MAX_CONCEPTS)).alias("concepts"),
            tx.file_name(p).alias("file_name"),
            tx.file_extension(p).alias("file_extension"),
        ),
    )


def catalog_text(meta: Column, page_count: Column | None = None) -> Column:
    """Header lines describing the document; absent values give no line."""
    line = lambda label, value: F.when(value.isNotNull() & (value != ""), F.concat(F.lit(f"{label}: "), value))
    pages = F.lit(None) if page_count is None else F.when(page_count > 0, page_count.cast("string"))
    return F.concat_ws(
        "\n",
        line("Titulo", tx.strip(meta["title"])),
        line("Autor", tx.strip(meta["author"])),
        line("Tema", tx.strip(meta["theme"])),
        line("Paginas", pages),
        line("Stack", F.array_join(normalize_list(meta["stack"]), ", ")),
        line("Conceitos", F.array_join(normalize_list(meta["concepts"]), ", ")),
    )


def indexable_text(content: Column, catalog: Column) -> Column:
    clean = tx.strip(F.coalesce(content, F.lit("")))
    framed = F.concat(F.lit("[CATALOGO]\n"), catalog, F.lit("\n[/CATALOGO]\n\n"), clean)
    return F.when(catalog == "", clean).when(clean == "", catalog).otherwise(framed)


def with_catalog(docs: DataFrame) -> DataFrame:
    """Add ``metadata``, ``catalog_text`` and ``indexable`` to (file_path, content) rows.

    A struct column ``declared`` goes before what is inferred (see ``metadata``); a list in it
    may be an array or one string divided by commas, semicolons or bars.
    """
    declared, fields = None, []
    if "declared" in docs.columns:
        kinds = {f.name: f.dataType.simpleString() for f in docs.schema["declared"].dataType.fields}
        fields = [n for n in ("title", "author", "theme", "stack", "concepts") if n in kinds]
        as_list = lambda n, c: split_list(c) if n in ("stack", "concepts") and kinds[n] == "string" else c
        declared = F.struct(*[as_list(n, F.col(f"declared.{n}")).alias(n) for n in fields]) if fields else None
    df = docs.withColumn("metadata", metadata("file_path", "content", declared, fields))
    df = df.withColumn("catalog_text", catalog_text(F.col("metadata")))
    return df.withColumn("indexable", indexable_text(F.col("content"), F.col("catalog_text")))


def catalog_counts(rows: DataFrame, label: Column, limit: int = 10) -> DataFrame:
    """Top labels by number of documents."""
    return (
        rows.groupBy(label.alias("label"))
        .agg(F.count(F.lit(1)).alias("documents"))
        .orderBy(F.desc("documents"), "label")
        .limit(limit)
    )
