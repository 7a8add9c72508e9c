"""Retrieval queries: catalogue inference, BM25 variants, chunk search, hybrid ranking."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foliospark.functions import catalog, stemming as st, text as tx
from foliospark.operators import chunking, index, retrieval, search_index
from foliospark.plans.corpus import CHUNKS_SQL, FOLD, SQUEEZE, STRIP, TOKENS
from foliospark.plans.registry import CORPUS_SQL, corpus, query, spread, table
from foliospark.staging import checkpoint_root

TOP_K = 5
#: Indexes written by this session: (application, tables, kind) -> path, and their fields: (path, field).
_WRITTEN: dict[tuple[str, str, str], str] = {}
_FIELDS: set[tuple[str, str]] = set()


def _index(spark, sf: str, kind: str, fields, docs, keep=(), derive=None) -> search_index.Index:
    """The index of a corpus; written at its first use, later searches of the session read it. Fields are added when first searched."""
    name = (spark.sparkContext.applicationId, sf, kind)
    if name not in _WRITTEN:
        path = f"{checkpoint_root(spark)}/foliospark/index-{kind}-{uuid.uuid4().hex}"
        search_index.write(docs, path, (), keep, derive=derive)
        _WRITTEN[name] = path
    path = _WRITTEN[name]
    for field in fields:
        if (path, field.name) not in _FIELDS:
            search_index.add_field(spark, path, field)
            _FIELDS.add((path, field.name))
    return search_index.Index(spark, path)


TEXT_FIELDS = (search_index.DOCUMENTS, search_index.FOLDED_DOCUMENTS, search_index.CHUNKS, search_index.FOLDED_CHUNKS)


def text_index(spark, sf, *fields: search_index.Field) -> search_index.Index:
    """Texts and their chunks as they are; all fields if none is named."""
    docs = corpus(spark, sf).select("file_path", "file_extension", "content")
    return _index(spark, sf, "texts", fields or TEXT_FIELDS, docs)


def store_index(spark, sf) -> search_index.Index:
    """Stored documents: chunks with the catalogue header, and the documents they add up to."""
    docs = corpus(spark, sf).select("file_path", "file_extension", "content")
    return _index(spark, sf, "store", (search_index.DOCUMENTS, search_index.CHUNKS), docs, ("metadata",), index.stored_documents)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def cue_regex(cue: catalog.Cue) -> str:
    """One regular expression with the meaning of a cue."""
    parts = [f"{catalog.EDGE_L}({'|'.join(cue.words)}){catalog.EDGE_R}"] if cue.words else []
    return "|".join([*parts, *cue.phrases, *(p for _, p in cue.patterns)])


def label_list_sql(text: str, cues: dict[str, catalog.Cue], limit: int) -> str:
    patterns = {n: cue_regex(c) for n, c in cues.items()}
    cases = ", ".join(f"CASE WHEN regexp_matches({text}, {quoted(p)}) THEN {quoted(n)} END" for n, p in patterns.items())
    return f"(list_filter([{cases}], lambda x: x IS NOT NULL))[1:{limit}]"


THEME_SCORES = "[" + ", ".join(
    "(" + " + ".join(f"CAST(contains(t, {quoted(k)}) AS INTEGER)" for k in kws) + ")" for kws in catalog.THEMES.values()
) + "]"
THEME_NAMES = "[" + ", ".join(quoted(n) for n in catalog.THEMES) + "]"
META_SQL = rf"""opening AS (
  SELECT *, regexp_replace(regexp_extract(file_path, '[^/]*$'), '\.[^.]*$', '') AS stem FROM corpus),
inferred AS (
  SELECT *, {FOLD(SQUEEZE("concat_ws(chr(10), stem, replace(file_path, '/', ' '), substring(content, 1, 8000))"))} AS t FROM opening),
scored AS (SELECT *, {THEME_SCORES} AS theme_scores FROM inferred),
meta AS (
  SELECT doc_id, file_path, source, content,
         regexp_replace({SQUEEZE("regexp_replace(stem, '[_.]+', ' ', 'g')")}, '^[ \-_]+|[ \-_]+$', '', 'g') AS title,
         CASE WHEN list_max(theme_scores) > 0
              THEN ({THEME_NAMES})[list_position(theme_scores, list_max(theme_scores))] END AS theme,
         {label_list_sql('t', catalog.STACK, 8)} AS stack,
         {label_list_sql('t', catalog.CONCEPTS, 10)} AS concepts
  FROM scored)"""
CATALOG_SQL = f"""{META_SQL},
headed AS (
  SELECT *, concat_ws(chr(10), 'Titulo: ' || title, 'Tema: ' || theme,
      CASE WHEN len(stack) > 0 THEN 'Stack: ' || array_to_string(stack, ', ') END,
      CASE WHEN len(concepts) > 0 THEN 'Conceitos: ' || array_to_string(concepts, ', ') END) AS catalog_text
  FROM meta),
indexable AS (
  SELECT *, CASE WHEN catalog_text = '' THEN {STRIP('content')}
                 WHEN {STRIP('content')} = '' THEN catalog_text
                 ELSE '[CATALOGO]' || chr(10) || catalog_text || chr(10) || '[/CATALOGO]' || chr(10) || chr(10)
                      || {STRIP('content')} END AS indexable
  FROM headed)"""


@query("catalog_metadata", f"""WITH {CORPUS_SQL}, {CATALOG_SQL}
SELECT file_path, title, theme, array_to_string(stack, ',') AS stack, array_to_string(concepts, ',') AS concepts,
       sha256(catalog_text) AS catalog_sha, sha256(indexable) AS indexable_sha FROM indexable""")
def catalog_metadata(spark, sf):
    m = F.col("metadata")
    return catalog.with_catalog(corpus(spark, sf)).select(
        "file_path",
        m["title"].alias("title"),
        m["theme"].alias("theme"),
        F.array_join(m["stack"], ",").alias("stack"),
        F.array_join(m["concepts"], ",").alias("concepts"),
        F.sha2("catalog_text", 256).alias("catalog_sha"),
        F.sha2("indexable", 256).alias("indexable_sha"),
    )


@query("catalog_declared", f"""WITH {CORPUS_SQL}, {META_SQL}
SELECT m.file_path, CASE WHEN doc_id % 3 = 0 THEN 'Manual ' || doc_id ELSE title END AS title,
  CASE WHEN doc_id % 5 = 0 THEN m.source ELSE theme END AS theme,
  CASE WHEN doc_id % 4 = 0 THEN 'spark,' || lang ELSE array_to_string(stack, ',') END AS stack
FROM meta m JOIN (SELECT doc_id, lang FROM corpus) USING (doc_id)""")
def catalog_declared(spark, sf):
    """What a file declares goes before what is inferred; blank declarations do not."""
    number = F.col("doc_id")
    declared = F.struct(
        F.when(number % 3 == 0, F.concat(F.lit("  Manual "), number, F.lit(" "))).alias("title"),
        F.when(number % 5 == 0, F.col("source")).otherwise(" ").alias("theme"),
        F.when(number % 4 == 0, F.concat(F.lit("spark; "), "lang", F.lit(" |spark,"))).otherwise(" ,").alias("stack"),
    )
    m = F.col("metadata")
    return catalog.with_catalog(corpus(spark, sf).withColumn("declared", declared)).select(
        "file_path", m["title"].alias("title"), m["theme"].alias("theme"), F.array_join(m["stack"], ",").alias("stack")
    )


@query("catalog_theme", f"""WITH {CORPUS_SQL}, {META_SQL}
SELECT coalesce(theme, 'sem_tema') AS label, count(*) AS documents FROM meta GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def catalog_theme(spark, sf):
    rows = corpus(spark, sf).select(catalog.metadata("file_path", "content").alias("m"))
    return catalog.catalog_counts(rows, F.coalesce(F.col("m")["theme"], F.lit("sem_tema")))


@query("catalog_stack", f"""WITH {CORPUS_SQL}, {META_SQL}
SELECT label, count(*) AS documents FROM (SELECT unnest(stack) AS label FROM meta)
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""")
def catalog_stack(spark, sf):
    rows = corpus(spark, sf).select(catalog.metadata("file_path", "content").alias("m"))
    return catalog.catalog_counts(rows.select(F.explode("m.stack").alias("s")), F.col("s"))


@query("catalog_json_rollup", f"""WITH {CORPUS_SQL}, {META_SQL}
SELECT coalesce(theme, 'sem_tema') AS theme, s AS stack, count(*) AS documents
FROM (SELECT theme, unnest(stack) AS s FROM meta) GROUP BY ALL""")
def catalog_json_rollup(spark, sf):
    """Metadata kept as JSON text, then theme and stack extracted from it and unnested."""
    stored = corpus(spark, sf).select(F.to_json(catalog.metadata("file_path", "content")).alias("metadata_json"))
    stack = F.from_json(F.get_json_object("metadata_json", "$.stack"), "array<string>")
    theme = F.coalesce(F.get_json_object("metadata_json", "$.theme"), F.lit("sem_tema"))
    return (
        stored.select(theme.alias("theme"), F.explode(stack).alias("stack"))
        .groupBy("theme", "stack")
        .agg(F.count(F.lit(1)).alias("documents"))
    )


@query("term_stats", f"""WITH {CORPUS_SQL}, o AS (
  SELECT doc_id, unnest({TOKENS('lower(content)')}) AS term FROM corpus)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS occurrences FROM o GROUP BY 1""")
def term_stats(spark, sf):
    return index.term_stats(index.postings(corpus(spark, sf), ["file_path"], tx.tokens("content")))


@query("corpus_stats", f"""WITH {CORPUS_SQL}
SELECT count(*) AS documents, round(avg(len({TOKENS('lower(content)')})), 6) AS avg_length FROM corpus""")
def corpus_stats(spark, sf):
    stats = index.corpus_stats(corpus(spark, sf), tx.tokens("content"))
    return stats.withColumn("avg_length", F.round("avg_length", 6))


def benchmark_queries(spark, sf):
    """Every benchmark passage as a query."""
    return spread(table(spark, sf, "benchmark")).select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def expansion_parts_sql(q: str) -> str:
    """All terms a query expands to, in order and with repeats, as one list expression."""
    low = FOLD(q)
    parts = [f"[{q}]"]
    for n, cue in catalog.CONCEPTS.items():
        both = f"[{quoted(n)}, {quoted(n.replace('_', ' '))}]"
        parts.append(f"CASE WHEN regexp_matches({low}, {quoted(cue_regex(cue))}) THEN {both} ELSE [] END")
    for n, cue in catalog.STACK.items():
        parts.append(f"CASE WHEN regexp_matches({low}, {quoted(cue_regex(cue))}) THEN [{quoted(n)}] ELSE [] END")
    for n, related in retrieval.RELATED_TERMS.items():
        terms = ", ".join(quoted(x) for x in (n, *related))
        parts.append(f"CASE WHEN contains({low}, {quoted(n)}) THEN [{terms}] ELSE [] END")
    return " || ".join(parts)


EXPANDED_SQL = f"""stripped AS (SELECT item_id AS query_id, {STRIP('text')} AS q FROM benchmark),
lists AS (SELECT query_id, {expansion_parts_sql('q')} AS parts FROM stripped),
expanded AS (
  SELECT query_id, array_to_string(list_filter(parts, lambda x, i: list_position(parts, x) = i), ' ') AS q FROM lists)"""


@query("query_expand", f"""WITH {EXPANDED_SQL} SELECT query_id, q AS query FROM expanded""")
def query_expand(spark, sf):
    return benchmark_queries(spark, sf).select("query_id", retrieval.expand_query("query").alias("query"))


def bm25_sql(scores: str, idf: str, k1: str, rows: str, hits: str, keys: str, terms: str) -> str:
    """CTEs scoring ``hits`` (keys, term, tf, dl) for ``terms`` (query_id, term, qtf)."""
    return f"""{scores}_n AS ({rows}),
{scores}_df AS (SELECT term, count(*) AS df FROM {hits} GROUP BY 1),
{scores}_idf AS (SELECT term, df, {idf} AS idf FROM {scores}_df, {scores}_n),
{scores} AS (
  SELECT query_id, {keys},
         round(sum(qtf * idf * tf * ({k1} + 1) / (tf + {k1} * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM {hits} JOIN {terms} USING (term) JOIN {scores}_idf USING (term), {scores}_n GROUP BY ALL)"""


DOC_HITS_SQL = f"""doc_tokens AS (
  SELECT file_path, {TOKENS('lower(content)')} AS tk FROM docs),
doc_hits AS (
  SELECT file_path, term, count(*) AS tf, any_value(dl) AS dl
  FROM (SELECT file_path, len(tk) AS dl, unnest(tk) AS term FROM doc_tokens) GROUP BY file_path, term)"""


def query_terms_sql(source: str, column: str) -> str:
    return f"""qterms AS (
  SELECT query_id, term, count(*) AS qtf
  FROM (SELECT query_id, unnest({TOKENS(f'lower({column})')}) AS term FROM {source}) GROUP BY ALL)"""


OKAPI_IDF = "ln(n - df + 0.5) - ln(df + 0.5)"
DOC_N = "SELECT count(*) AS n, avg(len(tk)) AS avgdl FROM doc_tokens WHERE len(tk) > 0"


def okapi_sql() -> str:
    floor = f"0.25 * (SELECT avg({OKAPI_IDF}) FROM bm_df, bm_n)"
    idf = f"CASE WHEN {OKAPI_IDF} < 0 THEN {floor} ELSE {OKAPI_IDF} END"
    return bm25_sql("bm", idf, "1.5", DOC_N, "doc_hits", "file_path", "qterms")


@query("bm25_documents", f"""WITH {CORPUS_SQL}, docs AS (SELECT file_path, content FROM corpus), {DOC_HITS_SQL},
stripped AS (SELECT item_id AS query_id, text AS q FROM benchmark), {query_terms_sql('stripped', 'q')}, {okapi_sql()}
SELECT query_id, file_path, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_path) AS rank FROM bm WHERE score <> 0)
WHERE rank <= {TOP_K}""")
def bm25_documents(spark, sf):
    return search_index.rank_documents(text_index(spark, sf, search_index.DOCUMENTS), benchmark_queries(spark, sf), TOP_K)


@query("bm25_simple_documents", f"""WITH {CORPUS_SQL}, docs AS (SELECT file_path, content FROM corpus),
doc_tokens AS (SELECT file_path, {TOKENS(FOLD('content'))} AS tk FROM docs),
doc_hits AS (
  SELECT file_path, term, count(*) AS tf, any_value(dl) AS dl
  FROM (SELECT file_path, len(tk) AS dl, unnest(tk) AS term FROM doc_tokens) GROUP BY file_path, term),
qterms AS (SELECT query_id, term, count(*) AS qtf FROM (
  SELECT item_id AS query_id, unnest({TOKENS(FOLD('text'))}) AS term FROM benchmark) GROUP BY ALL),
{bm25_sql('bm', 'ln(1 + (n - df + 0.5) / (df + 0.5))', '1.5', 'SELECT count(*) AS n, avg(len(tk)) AS avgdl FROM doc_tokens', 'doc_hits', 'file_path', 'qterms')}
SELECT query_id, file_path, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_path) AS rank FROM bm)
WHERE rank <= {TOP_K}""")
def bm25_simple_documents(spark, sf):
    return search_index.rank_simple(text_index(spark, sf, search_index.FOLDED_DOCUMENTS), benchmark_queries(spark, sf), TOP_K)


def stems_sql(source: str) -> str:
    """CTE ``stems`` (term, stem) of the distinct terms of ``source``, rule by rule."""
    ends = lambda x, p: f"regexp_extract({x}, '(?:{p})$')"
    cut = lambda x, p, start: f"CASE WHEN {ends(x, p)} <> '' AND length({x}) - length({ends(x, p)}) >= {start} THEN left({x}, length({x}) - length({ends(x, p)})) ELSE {x} END"
    region = lambda p: f"coalesce(nullif(length(regexp_extract(w, '{p}')), 0), length(w))"
    is_ = lambda p: f"regexp_full_match(s, '{p}')"
    inner = " ".join(f"WHEN {is_(p)} THEN {cut('b', before, 'r2')}" for p, before in st.WITH_INNER)
    replaced = " ".join(f"WHEN {is_(p)} THEN b || '{put}'" for p, put in st.REPLACED)
    return f"""stem0 AS (SELECT DISTINCT term, replace(replace(term, 'ã', 'a~'), 'õ', 'o~') AS w FROM {source}),
stem1 AS (SELECT *, {region(st.REGION_1)} AS r1, {region(st.REGION_2)} AS r2, {region(st.REGION_V)} AS rv, {ends('w', st.STANDARD)} AS s FROM stem0),
stem2 AS (SELECT *, left(w, length(w) - length(s)) AS b FROM stem1),
stem3 AS (SELECT *, {cut('b', st.ADVERB_INNER, 'r2')} AS adverb FROM stem2),
stem4 AS (SELECT *, CASE WHEN s = '' THEN w
    WHEN s = 'amente' THEN CASE WHEN length(b) < r1 THEN w WHEN adverb <> b AND b LIKE '%iv' THEN {cut('adverb', 'at', 'r2')} ELSE adverb END
    WHEN {is_('iras?')} THEN CASE WHEN length(b) >= rv AND b LIKE '%e' THEN b || 'ir' ELSE w END
    WHEN length(b) < r2 THEN w {inner} {replaced} ELSE b END AS x1 FROM stem3),
stem5 AS (SELECT *, CASE WHEN x1 <> w THEN x1 ELSE left(w, rv) || regexp_replace(substring(w, rv + 1), '(?:{st.VERB})$', '') END AS x2 FROM stem4),
stem6 AS (SELECT *, CASE WHEN x2 = w THEN {cut('x2', st.RESIDUAL, 'rv')}
    WHEN x2 LIKE '%ci' AND length(x2) > rv THEN left(x2, length(x2) - 1) ELSE x2 END AS x3 FROM stem5),
stem7 AS (SELECT *, {cut('x3', '[eéê]', 'rv')} AS x4 FROM stem6),
stems AS (SELECT term, translate(replace(CASE WHEN x4 <> x3 AND regexp_matches(x4, '(?:gu|ci)$') AND length(x4) > rv THEN left(x4, length(x4) - 1)
    ELSE regexp_replace(x4, 'ç$', 'c') END, '~', ''), '{tx.ACCENTED}', '{tx.UNACCENTED}') AS stem FROM stem7)"""


@query("fts_stemmed", f"""WITH {CORPUS_SQL}, docs AS (SELECT file_path, content FROM corpus), {DOC_HITS_SQL},
asked AS (SELECT item_id AS query_id, unnest({TOKENS('lower(text)')}) AS term FROM benchmark),
vocabulary AS (SELECT term FROM doc_hits UNION SELECT term FROM asked), {stems_sql('vocabulary')},
stem_hits AS (SELECT file_path, stem AS term, sum(tf) AS tf, any_value(dl) AS dl FROM doc_hits JOIN stems USING (term) GROUP BY ALL),
qterms AS (SELECT query_id, stem AS term, count(*) AS qtf FROM asked JOIN stems USING (term) GROUP BY ALL),
{bm25_sql('bm', 'ln(1 + (n - df + 0.5) / (df + 0.5))', '1.5', DOC_N, 'stem_hits', 'file_path', 'qterms')}
SELECT query_id, file_path, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_path) AS rank FROM bm)
WHERE rank <= {TOP_K}""")
def fts_stemmed(spark, sf):
    """Text search by Portuguese stems over the stored index; the vocabulary is stemmed once."""
    opened = text_index(spark, sf, search_index.DOCUMENTS)
    name = (spark.sparkContext.applicationId, sf, "stems")
    if name not in _WRITTEN:
        search_index.write_stems(opened, search_index.DOCUMENTS)
        _WRITTEN[name] = opened.path
    return search_index.search_stemmed(opened, benchmark_queries(spark, sf), TOP_K)


@query("bm25_chunks", f"""WITH {CORPUS_SQL}, {CHUNKS_SQL},
ctok AS (SELECT file_path, chunk_index, {TOKENS(FOLD('text'))} AS tk FROM chunks),
chits AS (
  SELECT file_path, chunk_index, term, count(*) AS tf, any_value(dl) AS dl
  FROM (SELECT file_path, chunk_index, len(tk) AS dl, unnest(tk) AS term FROM ctok) GROUP BY file_path, chunk_index, term),
qterms AS (SELECT query_id, term, count(*) AS qtf FROM (
  SELECT item_id AS query_id, unnest({TOKENS(FOLD('text'))}) AS term FROM benchmark) GROUP BY ALL),
{bm25_sql('bm', 'ln(1 + (n - df + 0.5) / (df + 0.5))', '1.5', 'SELECT count(*) AS n, avg(len(tk)) AS avgdl FROM ctok', 'chits', 'file_path, chunk_index', 'qterms')},
best AS (SELECT query_id, file_path, max(score) AS score FROM bm GROUP BY ALL HAVING max(score) > 0)
SELECT query_id, file_path, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_path) AS rank FROM best)
WHERE rank <= 3""")
def bm25_chunks(spark, sf):
    return search_index.search_relevant_documents(text_index(spark, sf, search_index.FOLDED_CHUNKS), benchmark_queries(spark, sf), 3)


FTS_TOKENS = lambda x: (
    f"regexp_extract_all(translate(lower({x}), '{tx.ACCENTED}', '{tx.UNACCENTED}'), '[\\p{{L}}\\p{{N}}]+')"
)
STORE_SQL = CHUNKS_SQL.replace("FROM corpus", "FROM store")


def fts_sql(source: str, column: str) -> str:
    return f"""ftok AS (SELECT file_path, chunk_index, {FTS_TOKENS('text')} AS tk FROM chunk_rows),
fpos AS (SELECT file_path, chunk_index, len(tk) AS dl, unnest(tk) AS tok, generate_subscripts(tk, 1) AS pos FROM ftok),
fseq AS (SELECT *, lead(tok, 1) OVER w AS t2, lead(tok, 2) OVER w AS t3 FROM fpos
         WINDOW w AS (PARTITION BY file_path, chunk_index ORDER BY pos)),
fgram AS (SELECT file_path, chunk_index, dl, tok AS term FROM fseq
          UNION ALL SELECT file_path, chunk_index, dl, tok || ' ' || t2 FROM fseq WHERE t2 IS NOT NULL
          UNION ALL SELECT file_path, chunk_index, dl, tok || ' ' || t2 || ' ' || t3 FROM fseq WHERE t3 IS NOT NULL),
fterms AS (
  SELECT query_id, term, count(*) AS qtf FROM (
    SELECT query_id, array_to_string({FTS_TOKENS('token')}, ' ') AS term FROM (
      SELECT DISTINCT query_id, unnest({TOKENS(f'lower({column})')}) AS token FROM {source}))
  WHERE term <> '' GROUP BY ALL),
fhits AS (
  SELECT file_path, chunk_index, term, count(*) AS tf, any_value(dl) AS dl FROM fgram
  WHERE term IN (SELECT term FROM fterms) GROUP BY file_path, chunk_index, term),
{bm25_sql('fts', 'CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END', '1.2', 'SELECT count(*) AS n, avg(len(tk)) AS avgdl FROM ftok', 'fhits', 'file_path, chunk_index', 'fterms')},
fts_top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_path, chunk_index) AS rank FROM fts)
  WHERE rank <= {TOP_K * retrieval.OVERFETCH})"""


@query("fts_chunks", f"""WITH {CORPUS_SQL}, {CHUNKS_SQL}, chunk_rows AS (SELECT * FROM chunks),
stripped AS (SELECT item_id AS query_id, text AS q FROM benchmark), {fts_sql('stripped', 'q')}
SELECT query_id, file_path, chunk_index, score, rank FROM fts_top""")
def fts_chunks(spark, sf):
    hits = search_index.search_chunks(text_index(spark, sf, search_index.CHUNKS), benchmark_queries(spark, sf), TOP_K * retrieval.OVERFETCH)
    return hits.select(
        "query_id", "file_path", F.col("chunk_index").cast("long").alias("chunk_index"), "score", "rank"
    )


def meta_terms_sql() -> str:
    rules = "MAP {" + ", ".join(
        f"{quoted(n)}: [{', '.join(quoted(k) for k in kws)}]" for n, kws in catalog.THEMES.items()
    ) + "}"
    return f"""list_distinct(
      CASE WHEN theme IS NULL THEN [] ELSE [theme] || string_split(replace(theme, '_', ' '), ' ') || {rules}[theme] END
      || stack || flatten(list_transform(concepts, lambda c: [c] || string_split(replace(c, '_', ' '), ' '))))"""


HYBRID_SQL = f"""WITH {CORPUS_SQL}, {CATALOG_SQL},
store AS (SELECT doc_id, file_path, indexable AS content FROM indexable), {STORE_SQL},
chunk_rows AS (
  SELECT s.file_path, coalesce(c.chunk_index, 0) AS chunk_index, coalesce(c.text, '') AS text
  FROM store s LEFT JOIN chunks c USING (file_path)),
docs AS (SELECT file_path, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS content FROM chunk_rows GROUP BY 1),
{EXPANDED_SQL}, {fts_sql('expanded', 'q')}, {DOC_HITS_SQL}, {query_terms_sql('expanded', 'q')}, {okapi_sql()},
fts_docs AS (
  SELECT query_id, file_path, score, row_number() OVER (PARTITION BY query_id ORDER BY best) AS rank FROM (
    SELECT query_id, file_path, max(score) AS score, min(rank) AS best FROM fts_top GROUP BY ALL)),
bm_docs AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_path) AS rank FROM bm WHERE score <> 0)
  WHERE rank <= {TOP_K * retrieval.OVERFETCH}),
tset AS (SELECT query_id, list_distinct({TOKENS('lower(q)')}) AS terms FROM expanded),
joined AS (
  SELECT coalesce(f.query_id, b.query_id) AS query_id, coalesce(f.file_path, b.file_path) AS file_path,
         coalesce(f.score, 0) AS fts_score, coalesce(b.score, 0) AS bm25_score,
         coalesce(1.0 / (60 + f.rank), 0) + coalesce(1.0 / (60 + b.rank), 0) AS rrf
  FROM fts_docs f FULL OUTER JOIN bm_docs b ON f.query_id = b.query_id AND f.file_path = b.file_path),
bonus AS (
  SELECT j.*, 1.5 * len(list_intersect(terms, {meta_terms_sql()})) / greatest(len(terms), 1) AS meta_bonus
  FROM joined j JOIN meta USING (file_path) JOIN tset USING (query_id)),
fused AS (
  SELECT query_id, file_path, fts_score, bm25_score, round(rrf, 6) AS rrf_score, round(meta_bonus, 6) AS metadata_bonus,
         round(fts_score + 0.4 * bm25_score + rrf + meta_bonus, 6) AS score FROM bonus),
ranked AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_path) AS rank FROM fused)
  WHERE rank <= {TOP_K})"""


def hybrid_ranking(spark, sf, limit=TOP_K):
    return search_index.hybrid(store_index(spark, sf), benchmark_queries(spark, sf), limit)


@query("hybrid_search", f"""{HYBRID_SQL}
SELECT query_id, file_path, fts_score, bm25_score, rrf_score, metadata_bonus, score, rank FROM ranked""")
def hybrid_search(spark, sf):
    return hybrid_ranking(spark, sf).drop("matched_metadata")


@query("answer_confidence", f"""{HYBRID_SQL}, c AS (
  SELECT query_id, count(*) FILTER (score > 0) AS relevant_count, coalesce(max(score), 0) AS top_score,
         max(CASE WHEN rank = 1 THEN score END) / max(CASE WHEN rank = 2 AND score > 0 THEN score END) AS gap
  FROM ranked GROUP BY 1)
SELECT query_id, CASE WHEN relevant_count = 0 OR top_score < 0.5 THEN 'abstain'
    WHEN top_score >= 5 AND relevant_count >= 2 THEN 'high'
    WHEN top_score >= 5 OR (relevant_count >= 2 AND coalesce(gap >= 1.5, TRUE)) THEN 'medium' ELSE 'low' END AS level,
  NOT (relevant_count = 0 OR top_score < 0.5) AS should_answer, round(top_score, 6) AS top_score,
  round(gap, 6) AS gap_ratio, relevant_count FROM c""")
def answer_confidence(spark, sf):
    return retrieval.confidence(hybrid_ranking(spark, sf)).drop("warnings")
