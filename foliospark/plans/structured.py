"""Structured-text queries: Markdown sections, JSON flattening and validation, prompt context."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import json_schema
from foliospark.operators import chunking, retrieval, search_index
from foliospark.plans.corpus import CHUNKS_SQL, SQUEEZE, STRIP
from foliospark.plans.registry import CORPUS_SQL, corpus, query, spread, table
from foliospark.plans.search import META_SQL, TOP_K, benchmark_queries, fts_sql, text_index
from foliospark.sources.documents import flattened_json
from foliospark.staging import stage


@query("markdown_sections", f"""WITH {CORPUS_SQL}, l AS (
  SELECT file_path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM corpus),
s AS (SELECT file_path, {STRIP("CASE WHEN n > 1 THEN '## ' ELSE '' END || line")} AS section FROM l)
SELECT file_path, count(*) AS sections, sum(length(section))::BIGINT AS chars FROM s WHERE section <> '' GROUP BY 1""")
def markdown_sections(spark, sf):
    """Every line after the first is made a heading, then the text is cut at its headings."""
    marked = F.regexp_replace("content", "\n", "\n## ")
    cut = corpus(spark, sf).select("file_path", chunking.markdown_sections(marked).alias("s")).where(F.size("s") > 0)
    total = F.aggregate("s", F.lit(0).cast("long"), lambda acc, x: acc + F.length(x))
    return cut.select("file_path", F.size("s").cast("long").alias("sections"), total.alias("chars"))


@query("json_flatten", "SELECT event_id, 'k: ' || json_extract_string(props, '$.k') AS flat FROM events")
def json_flatten(spark, sf):
    return spread(table(spark, sf, "events")).select("event_id", flattened_json("props").alias("flat"))


PROPS_SCHEMA = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 90}}}


@query("json_schema_check", """SELECT event_id, (k < 10 OR k > 90)::BIGINT AS violations
FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)""")
def json_schema_check(spark, sf):
    rows = spread(table(spark, sf, "events"))
    return rows.select("event_id", F.size(json_schema.check("props", PROPS_SCHEMA)).cast("long").alias("violations"))


HITS_SQL = f"""WITH {CORPUS_SQL}, {CHUNKS_SQL}, chunk_rows AS (SELECT * FROM chunks),
stripped AS (SELECT item_id AS query_id, text AS q FROM benchmark), {fts_sql('stripped', 'q')},
texts AS (SELECT query_id, t.file_path, t.rank, c.text FROM fts_top t JOIN chunk_rows c USING (file_path, chunk_index)),
firsts AS (SELECT query_id, file_path, text, min(rank) AS rank FROM texts GROUP BY ALL),
kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file_path ORDER BY rank) AS rn FROM firsts) WHERE rn <= 3)"""


def chunk_hits(spark, sf):
    """Best chunks per query from the stored index, and the files that have them; only those are chunked again."""
    opened = text_index(spark, sf, search_index.CHUNKS)
    found = search_index.search_chunks(opened, benchmark_queries(spark, sf), TOP_K * retrieval.OVERFETCH, merged=True)
    hits = stage(found, "hits")
    return hits, search_index.hit_files(opened, hits)


def chunk_texts(files):
    return chunking.explode_chunks(chunking.with_chunks(files), "file_path")


@query("matched_chunks", f"""{HITS_SQL}
SELECT query_id, file_path, count(*) AS excerpts, sha256(string_agg(text, '|' ORDER BY rank)) AS text_sha FROM kept GROUP BY ALL""")
def matched_chunks(spark, sf):
    hits, files = chunk_hits(spark, sf)
    found = retrieval.matched_chunks(hits, chunk_texts(files))
    return found.select(
        "query_id", "file_path", F.size("matched_chunks").cast("long").alias("excerpts"),
        F.sha2(F.array_join("matched_chunks", "|"), 256).alias("text_sha"),
    )


LINE_SQL = "CASE WHEN {1} <> '' THEN '{0}: ' || {1} END"


@query("prompt_context", f"""{HITS_SQL}, {META_SQL},
d AS (SELECT query_id, file_path, max(abs(score)) AS score, row_number() OVER (PARTITION BY query_id ORDER BY min(rank)) AS pos FROM fts_top GROUP BY query_id, file_path),
x AS (SELECT query_id, file_path, string_agg('Trecho relevante ' || rn || ': ' || substring({STRIP(SQUEEZE('text'))}, 1, 500), chr(10) ORDER BY rn) AS lines FROM kept GROUP BY ALL),
b AS (SELECT query_id, pos, concat_ws(chr(10), '[Fonte ' || pos || ']', 'Arquivo: ' || regexp_extract(file_path, '[^/]*$'), 'Caminho: ' || file_path,
        'Score: ' || printf('%.6f', score), {LINE_SQL.format('Tema', 'theme')}, {LINE_SQL.format('Stack', "array_to_string(stack, ', ')")},
        {LINE_SQL.format('Conceitos', "array_to_string(concepts, ', ')")}, lines) AS block
      FROM d JOIN x USING (query_id, file_path) JOIN meta USING (file_path) WHERE pos <= 3)
SELECT query_id, sha256(string_agg(block, chr(10) || chr(10) ORDER BY pos)) AS context_sha FROM b GROUP BY 1""")
def prompt_context(spark, sf):
    hits, files = chunk_hits(spark, sf)
    return retrieval.answer_context(hits, chunk_texts(files), files).select("query_id", F.sha2("context", 256).alias("context_sha"))
