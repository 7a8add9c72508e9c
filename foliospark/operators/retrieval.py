"""Ranked retrieval: three BM25 variants, chunk search, rank fusion and confidence.

All functions take a table of queries (query_id, query) and rank for every query
at once. Scores are rounded to six decimals before ranking, so that the order of
floating-point additions can not change a rank; ties go to the smaller path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliospark.functions import catalog, text as tx
from foliospark.operators import chunking
from foliospark.operators.index import BROADCAST_ROWS, TermScan, bounded, phrase_starts, scan_terms, with_content
from foliospark.staging import stage

RRF_K = 60
OVERFETCH = 4
MAX_MATCHED_CHUNKS = 3
FTS_WEIGHT = 1.0
BM25_WEIGHT = 0.4
METADATA_WEIGHT = 1.5
PATH_BOOST = 0.1
SHORT_QUERY_TOKENS = 3
DIGITS = 6

# Phrases that widen a query, and the terms each one adds.
RELATED_TERMS: dict[str, tuple[str, ...]] = {
    "clean architecture": ("clean_architecture", "architecture", "ddd", "cqrs", "event_sourcing"),
    "clean_architecture": ("clean architecture", "architecture", "ddd", "cqrs", "event_sourcing"),
    "ddd": ("domain driven design", "clean_architecture", "clean architecture", "cqrs", "event_sourcing"),
    "mongodb": ("atlas", "index", "indexes", "transaction", "transactions"),
    "transactions": ("transaction", "mongodb", "index", "indexes"),
    "transaction": ("transactions", "mongodb", "index", "indexes"),
    "embeddings": ("embedding", "vector_search", "vector search", "similarity search", "rag"),
    "embedding": ("embeddings", "vector_search", "vector search", "similarity search", "rag"),
    "vector_search": ("vector search", "similarity search", "embeddings", "rag"),
    "rag": ("retrieval augmented generation", "agents", "embeddings", "vector_search"),
    "agents": ("agent", "agentic", "multi-agent", "orchestration", "rag"),
    "performance": ("latency", "throughput", "profiling", "observability"),
}


def expand_query(query: Column | str) -> Column:
    """The query followed by every concept, technology and related term it triggers."""
    q = tx.strip(query)
    low = tx.casefold(q)
    spaced = catalog.spaced_words(low)
    none = F.array().cast("array<string>")
    parts = [F.array(q)]
    for label, cue in catalog.CONCEPTS.items():
        both = F.array(F.lit(label), F.lit(label.replace("_", " ")))
        parts.append(F.when(catalog.detects(cue, low, spaced), both).otherwise(none))
    for label, cue in catalog.STACK.items():
        parts.append(F.when(catalog.detects(cue, low, spaced), F.array(F.lit(label))).otherwise(none))
    for trigger, related in RELATED_TERMS.items():
        added = F.array(*[F.lit(t) for t in (trigger, *related)])
        parts.append(F.when(F.contains(low, F.lit(trigger)), added).otherwise(none))
    return F.array_join(F.array_distinct(F.concat(*parts)), " ")


def query_terms(queries: DataFrame, tokens: Column) -> DataFrame:
    """(query_id, term, qtf): each distinct token with its multiplicity in the query."""
    return queries.select("query_id", F.inline(tx.term_counts(tokens))).select(
        "query_id", "term", F.col("tf").alias("qtf")
    )


def phrase_terms(queries: DataFrame, query: str) -> DataFrame:
    """(query_id, term, qtf=1, words): each distinct query token as a full-text phrase.

    A token holding ``_`` or a folded accent becomes the adjacent full-text tokens it
    is made of. A phrase repeated by different spellings counts once per spelling.
    """
    spelled = queries.select("query_id", F.explode(F.array_distinct(tx.tokens(query))).alias("token"))
    parts = spelled.withColumn("__parts", tx.search_tokens("token")).where(F.size("__parts") > 0)
    return (
        parts.groupBy("query_id", F.array_join("__parts", " ").alias("term"), F.size("__parts").alias("words"))
        .agg(F.count(F.lit(1)).alias("qtf"))
    )


def _weights(scan: TermScan, wanted: DataFrame, idf: Column) -> DataFrame:
    """wanted + idf; at most one row per query term."""
    frequency = scan.hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return wanted.join(frequency, "term").withColumn("idf", idf).select("query_id", "term", "qtf", "idf")


def _score(scan: TermScan, weights: DataFrame, small: bool, k1: float, b: float) -> DataFrame:
    """Sum of per-term BM25 contributions per (query, row)."""
    side = F.broadcast(weights) if small else weights
    norm = 1.0 - b + (b * F.col("dl") / scan.avg_length if scan.avg_length else F.lit(0.0))
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (k1 + 1.0) / (F.col("tf") + k1 * norm)
    return (
        scan.hits.join(side, "term")
        .groupBy("query_id", *scan.keys)
        .agg(F.round(F.sum(part), DIGITS).alias("score"))
    )


def _is_small(wanted: DataFrame) -> bool:
    return wanted.count() <= BROADCAST_ROWS


def bm25_simple(scan: TermScan, wanted: DataFrame) -> DataFrame:
    """idf = ln(1 + (N - df + .5)/(df + .5)), k1 = 1.5, b = .75; repeated tokens add up."""
    df = F.col("df")
    idf = F.log1p((scan.rows - df + 0.5) / (df + 0.5))
    return _score(scan, _weights(scan, wanted, idf), _is_small(wanted), 1.5, 0.75)


def bm25_fts(scan: TermScan, wanted: DataFrame) -> DataFrame:
    """Full-text chunk score: k1 = 1.2, b = .75, idf floored at 1e-6."""
    df = F.col("df")
    idf = F.log((scan.rows - df + 0.5) / (df + 0.5))
    floored = F.when(idf <= 0, 1e-6).otherwise(idf)
    return _score(scan, _weights(scan, wanted, floored), _is_small(wanted), 1.2, 0.75)


def average_idf(frequencies: DataFrame, documents: int) -> float:
    """Mean of ln(N - df + .5) - ln(df + .5) over the whole vocabulary.

    Terms are first reduced to (df, how many terms), which is a narrow table.
    """
    spectrum = frequencies.groupBy("df").agg(F.count(F.lit(1)).alias("terms"))
    idf = F.log(documents - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    row = spectrum.agg((F.sum(idf * F.col("terms")) / F.sum("terms")).alias("mean")).first()
    return float(row["mean"] or 0.0)


def bm25_okapi(scan: TermScan, wanted: DataFrame, vocabulary_df) -> DataFrame:
    """Okapi weights, k1 = 1.5, b = .75; a negative idf becomes a quarter of the mean idf.

    ``vocabulary_df()`` must return (term, df) for the whole corpus. It is only called
    when some wanted term occurs in more than half of the documents.
    """
    df = F.col("df")
    idf = F.log(scan.rows - df + 0.5) - F.log(df + 0.5)
    frequent = scan.hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")).where(df > scan.rows / 2)
    floor = 0.0 if frequent.isEmpty() else 0.25 * average_idf(vocabulary_df(), scan.rows)
    weights = _weights(scan, wanted, F.when(idf < 0, F.lit(floor)).otherwise(idf))
    return _score(scan, weights, _is_small(wanted), 1.5, 0.75)


def top(ranked: DataFrame, limit: int, *ties: str) -> DataFrame:
    """Best ``limit`` rows per query with their ``rank``; pruned map-side before the shuffle."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *ties)
    numbered = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    # The cast comes after the filter, which must see the bare row number to be pushed into the map tasks.
    return numbered.withColumn("rank", F.col("rank").cast("long"))


def search_chunks(chunks: DataFrame, queries: DataFrame, limit: int, query: str = "query") -> DataFrame:
    """Top chunks per query (query_id, file_path, chunk_index, score, rank)."""
    wanted = stage(phrase_terms(queries, query), "query-phrases")
    phrases = phrase_starts(wanted)
    scan = scan_terms(chunks, ["file_path", "chunk_index"], tx.search_tokens("text"), wanted, phrases)
    return top(bm25_fts(scan, wanted), limit, "file_path", "chunk_index")


def chunk_hits_to_documents(hits: DataFrame) -> DataFrame:
    """Best chunk score and best rank per document, re-ranked."""
    per_doc = hits.groupBy("query_id", "file_path").agg(
        F.max("score").alias("score"), F.min("rank").alias("best")
    )
    order = Window.partitionBy("query_id").orderBy("best")
    return per_doc.withColumn("rank", F.row_number().over(order)).drop("best")


def _path_boosts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Documents named by a query of fewer than three tokens, at a small fixed score."""
    short = wanted.groupBy("query_id").agg(F.sum("qtf").alias("n")).where(F.col("n") < SHORT_QUERY_TOKENS)
    terms = wanted.join(short, "query_id", "left_semi").select("query_id", "term")
    if terms.isEmpty():
        return None
    words = tx.tokens(F.concat("file_path", F.lit(" "), tx.file_name("file_path")))
    named = docs.select("file_path", F.explode(F.array_distinct(words)).alias("term"))
    return (
        named.join(bounded(terms), "term")
        .select("query_id", "file_path", F.lit(PATH_BOOST).alias("score"))
        .distinct()
    )


def rank_documents(docs: DataFrame, queries: DataFrame, limit: int, query: str = "query") -> DataFrame:
    """Document BM25 over ``content``: exactly ``limit`` rows per query if there are that many.

    Documents without a hit score zero and fill the list in path order; when no
    document scores at all the list is the last documents in path order.
    """
    wanted = stage(query_terms(queries, tx.tokens(query)), "query-terms")
    valid = docs.where(F.col("content").rlike(tx.HAS_WORD))
    scan = scan_terms(valid, ["file_path"], tx.tokens("content"), wanted)
    vocabulary = lambda: (
        valid.select(F.explode_outer(F.array_distinct(tx.tokens("content"))).alias("term"))
        .where(F.col("term").isNotNull())
        .groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"))
    )
    scored = bm25_okapi(scan, wanted, vocabulary)
    nonzero = scored.where(F.col("score") != 0)
    boosts = _path_boosts(valid, wanted)
    if boosts is not None:
        nonzero = nonzero.unionByName(boosts.join(nonzero, ["query_id", "file_path"], "left_anti"))
    nonzero = stage(nonzero, "bm25-scores")
    return _fill_short_lists(nonzero, valid, queries, limit)


def _fill_short_lists(nonzero: DataFrame, docs: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    best = top(nonzero, limit, "file_path")
    found = nonzero.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") > 0).alias("positive")
    )
    short = queries.select("query_id").join(found, "query_id", "left").where(
        F.coalesce("positive", F.lit(0)) < limit
    )
    if short.isEmpty():
        return best
    paths = docs.select("file_path")
    last = paths.orderBy(F.desc("file_path")).limit(limit).agg(F.array_sort(F.collect_list("file_path"))).scalar()
    taken, total = 2 * limit, docs.count()
    while True:
        first = paths.orderBy("file_path").limit(taken).agg(F.array_sort(F.collect_list("file_path"))).scalar()
        fillers = short.select("query_id", F.explode(F.when(F.col("n").isNull(), last).otherwise(first)).alias("file_path"))
        zeros = fillers.join(nonzero, ["query_id", "file_path"], "left_anti").withColumn("score", F.lit(0.0))
        # Documents that score below zero can fill the head of the list; then more of it is needed.
        lengths = zeros.groupBy("query_id").count().join(short.where("n > 0"), "query_id", "right")
        scant = lengths.where(F.coalesce("count", F.lit(0)) + F.coalesce("positive", F.lit(0)) < min(limit, total))
        if taken >= total or scant.isEmpty():
            break
        taken *= 4
    part = best.join(short, "query_id", "left_semi").drop("rank")
    padded = top(part.unionByName(zeros), limit, "file_path")
    return best.join(short, "query_id", "left_anti").unionByName(padded)


def metadata_terms(meta: Column) -> Column:
    """Everything a query term may match in a document's metadata."""
    words = lambda label: F.array_union(F.array(label), F.split(F.replace(label, F.lit("_"), F.lit(" ")), " +"))
    empty = F.array().cast("array<string>")
    rules = F.create_map(
        *[x for name, kws in catalog.THEMES.items() for x in (F.lit(name), F.array(*[F.lit(k) for k in kws]))]
    )
    theme = tx.casefold(F.coalesce(meta["theme"], F.lit("")))
    themed = F.when(theme != "", F.concat(words(theme), F.coalesce(F.try_element_at(rules, theme), empty)))
    stack = F.transform(F.coalesce(meta["stack"], empty), tx.casefold)
    concepts = F.flatten(F.transform(F.coalesce(meta["concepts"], empty), lambda c: words(tx.casefold(c))))
    return F.array_distinct(F.concat(F.coalesce(themed, empty), stack, concepts))


def metadata_overlap(meta: Column, terms: Column) -> Column:
    """Distinct query terms found in the metadata, sorted."""
    return F.array_sort(F.array_intersect(F.array_distinct(F.transform(terms, tx.casefold)), metadata_terms(meta)))


def metadata_bonus(meta: Column, terms: Column) -> Column:
    lowered = F.array_distinct(F.transform(terms, tx.casefold))
    ratio = F.size(metadata_overlap(meta, terms)) / F.greatest(F.size(lowered), F.lit(1))
    return ratio * METADATA_WEIGHT


def rrf(*ranks: Column) -> Column:
    return sum((F.coalesce(1.0 / (RRF_K + r), F.lit(0.0)) for r in ranks), F.lit(0.0))


def fuse(fts: DataFrame, bm25: DataFrame, docs: DataFrame, queries: DataFrame, limit: int, query: str) -> DataFrame:
    """Weighted scores + reciprocal rank fusion + metadata bonus; component scores kept as a trace."""
    named = lambda df, tag: df.select(
        "query_id", "file_path", F.col("score").alias(f"{tag}_score"), F.col("rank").alias(f"{tag}_rank")
    )
    both = named(fts, "fts").join(named(bm25, "bm25"), ["query_id", "file_path"], "full_outer")
    candidates = bounded(stage(both, "fusion-candidates"))
    # Only candidates are looked up, so the corpus is filtered by path before metadata is read.
    facts = docs.select("file_path", "metadata").join(candidates, "file_path")
    terms = bounded(stage(queries.select("query_id", tx.tokens(query).alias("terms")), "fusion-terms"))
    bonus = metadata_bonus(F.col("metadata"), F.col("terms"))
    fts_s, bm_s = F.coalesce("fts_score", F.lit(0.0)), F.coalesce("bm25_score", F.lit(0.0))
    fused = facts.join(terms, "query_id").select(
        "query_id",
        "file_path",
        fts_s.alias("fts_score"),
        bm_s.alias("bm25_score"),
        F.round(rrf(F.col("fts_rank"), F.col("bm25_rank")), DIGITS).alias("rrf_score"),
        F.round(bonus, DIGITS).alias("metadata_bonus"),
        F.array_join(metadata_overlap(F.col("metadata"), F.col("terms")), " ").alias("matched_metadata"),
        F.round(
            fts_s * FTS_WEIGHT + bm_s * BM25_WEIGHT + rrf(F.col("fts_rank"), F.col("bm25_rank")) + bonus, DIGITS
        ).alias("score"),
    )
    return top(fused, limit, "file_path")


def hybrid(stored: DataFrame, queries: DataFrame, limit: int = 10) -> DataFrame:
    """Hybrid retrieval over stored documents for every query.

    Queries without a full-text hit fall back to the document ranking alone.
    ``stored`` should be a written table (index.stored_documents): it is read twice.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1")
    expanded = stage(
        queries.where(tx.strip("query") != "").select("query_id", expand_query("query").alias("query")), "queries"
    )
    chunks = chunking.explode_chunks(stored, "file_path")
    fetch = limit * OVERFETCH
    fts = stage(chunk_hits_to_documents(search_chunks(chunks, expanded, fetch)), "fts-documents")
    bm25 = stage(rank_documents(with_content(stored), expanded, fetch), "bm25-documents")
    return fused_ranking(fts, bm25, stored, expanded, limit)


def fused_ranking(fts: DataFrame, bm25: DataFrame, docs: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """Chunk search and document ranking as one list per query; without a chunk hit the document ranking alone."""
    with_hits = fts.select("query_id").distinct()
    fused = fuse(
        fts, bm25.join(with_hits, "query_id", "left_semi"), docs, queries, limit, "query"
    )
    alone = (
        bm25.join(with_hits, "query_id", "left_anti")
        .where(F.col("rank") <= limit)
        .select(
            "query_id", "file_path", F.lit(0.0).alias("fts_score"), F.col("score").alias("bm25_score"),
            F.lit(0.0).alias("rrf_score"), F.lit(0.0).alias("metadata_bonus"), F.lit("").alias("matched_metadata"),
            "score", "rank",
        )
    )
    return fused.unionByName(alone)


def matched_chunks(hits: DataFrame, chunks: DataFrame, limit: int = MAX_MATCHED_CHUNKS) -> DataFrame:
    """First distinct matched chunk texts per (query, document), best rank first."""
    wanted = bounded(stage(hits.select("query_id", "file_path", "chunk_index", "rank"), "matched"))
    texts = chunks.join(wanted, ["file_path", "chunk_index"])
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.col("text"))))
    return texts.groupBy("query_id", "file_path").agg(
        F.slice(F.array_distinct(F.transform(ordered, lambda x: x["text"])), 1, limit).alias("matched_chunks")
    )


def search_relevant_documents(chunks: DataFrame, queries: DataFrame, limit: int = 3) -> DataFrame:
    """Chunk BM25 rolled up to documents; token overlap replaces a query's all-zero scores."""
    wanted = stage(query_terms(queries, tx.folded_tokens("query")), "query-terms")
    scan = scan_terms(chunks, ["file_path", "chunk_index"], tx.folded_tokens("text"), wanted)
    scored = bm25_simple(scan, wanted)
    per_doc = scored.groupBy("query_id", "file_path").agg(F.max("score").alias("score"))
    overlap = (
        scan.hits.join(bounded(wanted), "term")
        .groupBy("query_id", "file_path", "chunk_index")
        .agg(F.count(F.lit(1)).cast("double").alias("shared"))
        .groupBy("query_id", "file_path")
        .agg(F.max("shared").alias("shared"))
    )
    positive = per_doc.where(F.col("score") > 0).select("query_id").distinct()
    fallback = overlap.join(positive, "query_id", "left_anti").withColumnRenamed("shared", "score")
    ranked = per_doc.where(F.col("score") > 0).unionByName(fallback)
    # A query that shares no word with any chunk gets the first document, with score zero.
    first = chunks.agg(F.min("file_path").alias("file_path")).where(F.col("file_path").isNotNull())
    missed = queries.select("query_id").distinct().join(ranked.select("query_id").distinct(), "query_id", "left_anti")
    empty = missed.join(F.broadcast(first)).select("query_id", "file_path", F.lit(0.0).alias("score"))  # one row
    return top(ranked.select("query_id", "file_path", "score").unionByName(empty), limit, "file_path")


ABSTAIN_BELOW = 0.5
HIGH_FROM = 5.0
CLEAR_GAP = 1.5
# What the reader of an answer is warned of.
NOTHING_FOUND = "Nenhum documento relevante encontrado."
BELOW_THRESHOLD = "Score máximo abaixo do limiar de confiança."
SINGLE_SOURCE = "Apenas uma fonte relevante encontrada."
RATHER_LOW = "Score máximo relativamente baixo (%.1f)."


def confidence(ranked: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """Evidence level per query from its ranked scores: high, medium, low or abstain.

    With ``queries`` (query_id) a query without any ranked row abstains instead of being left out.
    """
    if queries is not None:
        ranked = queries.select("query_id").distinct().join(ranked, "query_id", "left")
    positive = ranked.groupBy("query_id").agg(
        F.count_if(F.col("score") > 0).alias("relevant_count"),
        F.max(F.when(F.col("score") > 0, F.col("score"))).alias("top"),
        F.max(F.when((F.col("rank") == 2) & (F.col("score") > 0), F.col("score"))).alias("second"),
    )
    top_score = F.coalesce("top", F.lit(0.0))
    many = F.col("relevant_count") >= 2
    high = top_score >= HIGH_FROM
    gap = F.when(F.col("second") > 0, F.col("top") / F.col("second"))
    clear = F.coalesce(gap >= CLEAR_GAP, F.lit(True))
    level = (
        F.when((F.col("relevant_count") == 0) | (top_score < ABSTAIN_BELOW), "abstain")
        .when(high & many, "high")
        .when(high | (many & clear), "medium")
        .otherwise("low")
    )
    return positive.select(
        "query_id",
        level.alias("level"),
        (level != "abstain").alias("should_answer"),
        F.round(top_score, DIGITS).alias("top_score"),
        F.round(gap, DIGITS).alias("gap_ratio"),
        "relevant_count",
        F.when(F.col("relevant_count") == 0, F.array(F.lit(NOTHING_FOUND)))
        .when(level == "abstain", F.array(F.lit(BELOW_THRESHOLD)))
        .otherwise(
            F.array_compact(
                F.array(
                    F.when((level != "high") & ~many, F.lit(SINGLE_SOURCE)),
                    F.when((level == "low") & ~high, F.format_string(RATHER_LOW, top_score)),
                )
            )
        )
        .alias("warnings"),
    )


def answer_context(hits: DataFrame, chunks: DataFrame, docs: DataFrame, documents: int = 3, excerpts: int = 3, chars: int = 500) -> DataFrame:
    """Prompt context per query from chunk hits: its best documents with their first matched excerpts."""
    ranked = stage(chunk_hits_to_documents(hits).where(F.col("rank") <= documents), "context-documents")
    found = matched_chunks(hits.join(ranked.select("query_id", "file_path"), ["query_id", "file_path"], "left_semi"), chunks, excerpts)
    return context_blocks(ranked, found, docs, excerpts, chars)


def context_blocks(ranked: DataFrame, found: DataFrame, docs: DataFrame, excerpts: int = 3, chars: int = 500, whole: int = 1500) -> DataFrame:
    """Numbered sources per query with score, metadata lines and evidence, white space squeezed.

    ``ranked``: query_id, file_path, score, rank, a few rows per query and written before;
    ``found``: query_id, file_path, matched_chunks; ``docs``: file_path, content, and ``declared``
    metadata if there are any. A document without matched text shows its opening. Metadata
    are inferred for the ranked documents only.
    """
    squeeze = lambda text: tx.strip(tx.collapse_ws(text))
    mine = docs.join(bounded(ranked.select("file_path").distinct()), "file_path", "left_semi")
    known = catalog.with_catalog(mine).select("file_path", "metadata", "content")
    rows = ranked.join(known, "file_path").join(found, ["query_id", "file_path"], "left")
    place = F.dense_rank().over(Window.partitionBy("query_id").orderBy("rank", "file_path"))
    full = F.slice(F.filter("matched_chunks", lambda c: squeeze(c) != ""), 1, excerpts)
    shown = F.transform(full, lambda c, i: F.concat(F.lit("Trecho relevante "), i + 1, F.lit(": "), F.substring(squeeze(c), 1, chars)))
    opening = F.concat(F.lit("Conteúdo recuperado: "), F.substring(squeeze(F.coalesce("content", F.lit(""))), 1, whole))
    m = F.col("metadata")
    line = lambda label, value: F.when(value != "", F.concat(F.lit(f"{label}: "), value))
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("[Fonte "), "place", F.lit("]")),
        F.concat(F.lit("Arquivo: "), m["file_name"]),
        F.concat(F.lit("Caminho: "), "file_path"),
        F.format_string("Score: %.6f", F.col("score")),
        line("Tema", m["theme"]),
        line("Stack", F.array_join(m["stack"], ", ")),
        line("Conceitos", F.array_join(m["concepts"], ", ")),
        F.when(F.size(full) > 0, F.array_join(shown, "\n")).otherwise(opening),
    )
    ordered = F.array_sort(F.collect_list(F.struct("place", block.alias("block"))))
    return rows.withColumn("place", place).groupBy("query_id").agg(
        F.array_join(F.transform(ordered, lambda b: b["block"]), "\n\n").alias("context")
    )
