"""Retrieval-quality and vector-search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.operators import evaluation, search_index, vector
from foliospark.plans.registry import query, table
from foliospark.plans.search import HYBRID_SQL, TOP_K, benchmark_queries, hybrid_ranking, text_index
from foliospark.staging import stage

# The expected files of benchmark item n are those of source n mod 20 (a path pattern).
METRICS_SQL = """judged AS (
  SELECT query_id, rank, contains(lower(file_path), 'src' || (query_id % 20) || '/')::INT AS rel FROM {ranked}),
per AS (
  SELECT query_id, min(rank) FILTER (rel = 1) AS first, sum(rel) AS hits, count(*) AS n, sum(rel / log2(rank + 1)) AS dcg,
         max(rel) FILTER (rank = 1) AS top FROM judged GROUP BY 1),
metrics AS (
  SELECT item_id AS query_id, round(coalesce(1.0 / first, 0), 4) AS reciprocal_rank, round(coalesce(hits / n, 0), 4) AS precision_at_k,
    round(coalesce(dcg / (SELECT sum(1 / log2(i + 1)) FROM (SELECT unnest(range(1, hits::INT + 1)) AS i)), 0), 4) AS ndcg_at_k,
    coalesce(top, 0) = 1 AS top_hit_correct FROM benchmark LEFT JOIN per ON item_id = query_id),
totals AS (SELECT count(*) AS total_queries, round(avg(reciprocal_rank), 4) AS mrr, round(avg(precision_at_k), 4) AS mean_precision_at_k,
   round(avg(ndcg_at_k), 4) AS mean_ndcg_at_k, round(avg(top_hit_correct::INT), 4) AS top1_accuracy FROM metrics)"""


def expected_files(spark, sf):
    pattern = F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"), F.lit("/"))
    return benchmark_queries(spark, sf).select("query_id", F.array(pattern).alias("expected_files"))


@query("ir_metrics", f"""{HYBRID_SQL}, {METRICS_SQL.format(ranked='ranked')} SELECT * FROM metrics""")
def ir_metrics(spark, sf):
    return evaluation.query_metrics(hybrid_ranking(spark, sf), expected_files(spark, sf))


@query("ir_summary", f"""{HYBRID_SQL}, {METRICS_SQL.format(ranked='ranked')} SELECT * FROM totals""")
def ir_summary(spark, sf):
    return evaluation.aggregate_metrics(ir_metrics(spark, sf))


# Baseline: hybrid ranking. Current: the document ranking alone.
BM_ONLY_SQL = METRICS_SQL.replace("judged", "bjudged").replace("per AS", "bper AS").replace("JOIN per ", "JOIN bper ").replace(
    "metrics", "bmetrics").replace("totals", "btotals")


def both_reports(spark, sf):
    docs = search_index.rank_documents(text_index(spark, sf, search_index.DOCUMENTS), benchmark_queries(spark, sf), TOP_K)
    current = stage(evaluation.query_metrics(docs, expected_files(spark, sf)), "metrics-now")
    return current, stage(ir_metrics(spark, sf), "metrics-before")


@query("ir_query_regressions", f"""{HYBRID_SQL}, {METRICS_SQL.format(ranked='ranked')},
plain AS (SELECT file_path, text AS content FROM (SELECT source || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.txt' AS file_path, text FROM documents)),
ptok AS (SELECT file_path, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}_]+') AS tk FROM plain),
pn AS (SELECT count(*) AS n, avg(len(tk)) AS avgdl FROM ptok WHERE len(tk) > 0),
phits AS (SELECT file_path, term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT file_path, len(tk) AS dl, unnest(tk) AS term FROM ptok) GROUP BY file_path, term),
pdf AS (SELECT term, count(*) AS df FROM phits GROUP BY 1),
pidf AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM pdf, pn),
pq AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM benchmark) GROUP BY ALL),
pscore AS (SELECT query_id, file_path, round(sum(qtf * (CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM pidf) ELSE idf END) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM phits JOIN pq USING (term) JOIN pidf USING (term), pn GROUP BY ALL),
pranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, file_path) AS rank FROM pscore) WHERE rank <= {TOP_K}),
{BM_ONLY_SQL.format(ranked='pranked')}
SELECT m.query_id, b.reciprocal_rank AS current, m.reciprocal_rank AS baseline FROM metrics m JOIN bmetrics b USING (query_id)
WHERE m.reciprocal_rank > 0 AND m.reciprocal_rank - b.reciprocal_rank > 0.05""")
def ir_query_regressions(spark, sf):
    return evaluation.query_regressions(*both_reports(spark, sf))


CENTROID_SQL = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
c AS (SELECT list(m ORDER BY d) AS q FROM (
  SELECT d, round(avg(x), 6) AS m FROM (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS d FROM e) GROUP BY d))"""


@query("vector_topk", f"""WITH {CENTROID_SQL}
SELECT vec_id, round(list_cosine_similarity(v, q), 6) AS similarity FROM e, c ORDER BY 2 DESC, 1 LIMIT 10""")
def vector_topk(spark, sf):
    rows = table(spark, sf, "embeddings")
    return vector.nearest(rows, vector.centroid(rows).scalar(), 10)


@query("vector_topk_filtered", f"""WITH {CENTROID_SQL}
SELECT vec_id, round(list_cosine_similarity(v, q), 6) AS similarity FROM e, c WHERE label > 0 ORDER BY 2 DESC, 1 LIMIT 10""")
def vector_topk_filtered(spark, sf):
    """Only active vectors take part; a positive label marks an active one."""
    rows = table(spark, sf, "embeddings")
    return vector.nearest(rows, vector.centroid(rows).scalar(), 10, active=F.col("label") > 0)


@query("vector_similarity", f"""WITH {CENTROID_SQL}
SELECT label, count(*) AS vectors, round(avg(round(list_cosine_similarity(v, q), 6)), 6) AS mean_similarity,
       round((1 + max(round(list_cosine_similarity(v, q), 6))) / 2, 6) AS best_score FROM e, c GROUP BY 1""")
def vector_similarity(spark, sf):
    rows = table(spark, sf, "embeddings")
    aimed = rows.withColumn("q", vector.centroid(rows).scalar())
    scored = aimed.select("label", F.round(vector.cosine(F.col("embedding"), F.col("q")), 6).alias("s"))
    return scored.groupBy("label").agg(
        F.count(F.lit(1)).alias("vectors"),
        F.round(F.avg("s"), 6).alias("mean_similarity"),
        F.round(vector.unit_score(F.max("s")), 6).alias("best_score"),
    )


@query("vector_topk_batch", """WITH s AS (
  SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS similarity
  FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, similarity, rank FROM r WHERE rank <= 10""")
def vector_topk_batch(spark, sf):
    """Ten nearest rows of every query vector: those whose id is divisible by 50."""
    rows = table(spark, sf, "embeddings")
    return vector.nearest_batch(rows, rows.where(F.col("vec_id") % 50 == 0), 10).drop("cells_read")
