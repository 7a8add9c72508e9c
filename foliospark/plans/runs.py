"""Cache keys, latencies, versions, caches and incremental indexing, each with its SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from foliospark.functions import text as tx
from foliospark.operators import control, retrieval, store
from foliospark.plans.registry import CORPUS_SQL, corpus, query, table
from foliospark.staging import checkpoint_root


@query("prompt_keys", """SELECT conv_id, turn, left(sha256(text), 16) AS prompt_hash,
       'ask:' || left(sha256(text || ':' || turn || ':strict'), 16) AS ask_key FROM conversations WHERE role = 'user'""")
def prompt_keys(spark, sf):
    asked = table(spark, sf, "conversations").where("role = 'user'")
    return asked.select("conv_id", "turn", tx.prompt_hash("text").alias("prompt_hash"), tx.ask_key("text", F.col("turn"), F.lit("strict")).alias("ask_key"))


@query("run_latency", """SELECT user_id, epoch_us(max(ts)) // 1000 - epoch_us(min(ts)) // 1000 AS latency_ms FROM events GROUP BY user_id""")
def run_latency(spark, sf):
    runs = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("started"), F.max("ts").alias("finished"))
    return runs.select("user_id", control.latency_ms("started", "finished").alias("latency_ms"))


@query("version_bumps", """WITH v AS (SELECT p_partkey, [p_size, p_partkey % 7, p_partkey % 3] AS new, [p_size, p_partkey % 5, 1] AS old FROM part)
SELECT p_partkey, new > old AS greater FROM v""")
def version_bumps(spark, sf):
    key = F.col("p_partkey")
    version = lambda *parts: F.concat_ws(".", *[p.cast("string") for p in parts])
    new, old = version(F.col("p_size"), key % 7, key % 3), version(F.col("p_size"), key % 5, F.lit(1))
    return table(spark, sf, "part").select("p_partkey", control.version_greater(new, old).alias("greater"))


@query("file_names", """SELECT doc_id, doc_id || '.v' || doc_id % 3 || '.TXT' AS name, doc_id || '.v' || doc_id % 3 AS stem, '.txt' AS extension,
       source || '/sub/' || doc_id || '.v' || doc_id % 3 || '.TXT' AS portable FROM documents""")
def file_names(spark, sf):
    given = F.concat(F.lit(".\\"), F.col("source"), F.lit("/sub\\"), F.col("doc_id"), F.lit(".v"), F.col("doc_id") % 3, F.lit(".TXT"))
    return table(spark, sf, "documents").select(
        "doc_id", tx.file_name(given).alias("name"), tx.file_stem(given).alias("stem"), tx.file_extension(given).alias("extension"),
        tx.portable_path(given).alias("portable"),
    )


CACHE_SQL = """cache AS (SELECT event_id AS k, ts AS inserted, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS v, NULL::BIGINT AS access_count FROM events),
top AS (SELECT count(*) AS n FROM cache)"""


def _cache(spark, sf):
    value = F.when(F.col("event_id") % 3 != 0, F.col("event_type"))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("k"), F.col("ts").alias("inserted"), value.alias("v"), F.lit(None).cast("long").alias("access_count")
    )


@query("cache_evict", f"""WITH {CACHE_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY inserted, k) AS place FROM cache)
SELECT k, v FROM r WHERE place > (SELECT greatest(n - 600, 60) FROM top)""")
def cache_evict(spark, sf):
    return store.evict_oldest(_cache(spark, sf), 600, "k", "inserted").select("k", "v")


@query("cache_touch", f"""WITH {CACHE_SQL}, used AS (SELECT user_id AS k, count(*) AS n FROM events GROUP BY user_id)
SELECT k, coalesce(used.n, 0) AS access_count FROM cache LEFT JOIN used USING (k)""")
def cache_touch(spark, sf):
    used = table(spark, sf, "events").select(F.col("user_id").alias("k"))
    return store.touch(_cache(spark, sf), used, "k").select("k", "access_count")


@query("confidence_all_queries", """WITH q AS (SELECT item_id AS query_id FROM benchmark),
s AS (SELECT query_id, CAST(query_id % 7 AS DOUBLE) AS score FROM q WHERE query_id % 4 <> 0)
SELECT query_id, CASE WHEN coalesce(score, 0) < 0.5 THEN 'abstain' WHEN score >= 5 THEN 'medium' ELSE 'low' END AS level,
       (CASE WHEN score > 0 THEN 1 ELSE 0 END)::BIGINT AS relevant_count,
       CASE WHEN coalesce(score, 0) = 0 THEN 'Nenhum documento relevante encontrado.' ELSE 'Apenas uma fonte relevante encontrada.'
         || CASE WHEN score < 5 THEN '|Score máximo relativamente baixo (' || printf('%.1f', score) || ').' ELSE '' END END AS warnings
FROM q LEFT JOIN s USING (query_id)""")
def confidence_all_queries(spark, sf):
    """One ranked document at most per query; every fourth query has none."""
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    ranked = queries.where("query_id % 4 <> 0").select("query_id", (F.col("query_id") % 7).cast("double").alias("score"), F.lit(1).alias("rank"))
    return retrieval.confidence(ranked, queries).select(
        "query_id", "level", F.col("relevant_count").cast("long").alias("relevant_count"), F.array_join("warnings", "|").alias("warnings")
    )


@query("incremental_index", f"""WITH {CORPUS_SQL} SELECT file_path, length(content) AS n FROM corpus WHERE doc_id % 5 <> 0
UNION ALL SELECT file_path, length(content) + 6 AS n FROM corpus WHERE doc_id % 10 = 0""")
def incremental_index(spark, sf):
    """A table of every document takes a batch of changed ones and a list of removed paths; the others stay."""
    docs = corpus(spark, sf).select("file_path", "doc_id", F.length("content").cast("long").alias("n"))
    schema = StructType([StructField("file_path", StringType()), StructField("n", LongType())])
    indexed = store.KeyedTable(spark, f"{checkpoint_root(spark)}/foliospark/index-{uuid.uuid4().hex}", "file_path", schema)
    indexed.upsert(docs.select("file_path", "n"))
    indexed.upsert(docs.where("doc_id % 10 = 0").select("file_path", (F.col("n") + 6).alias("n")))
    indexed.delete(docs.where("doc_id % 10 = 5").select("file_path"))
    return indexed.read()


@query("keyed_versions", """WITH e AS (SELECT *, event_id % 4 + 1 AS batch FROM events), v AS (SELECT unnest([1, 2, 3, 4, 5]) AS version),
w AS (SELECT user_id AS k, batch, max(event_id) AS last, count(*) AS n FROM e GROUP BY ALL),
s AS (SELECT version, k, arg_max(last, batch) AS last, arg_max(n, batch) AS n, max(batch) AS batch FROM v JOIN w ON batch <= version GROUP BY ALL)
SELECT version, count(*) AS keys, sum(last)::BIGINT AS last, sum(n)::BIGINT AS n FROM s WHERE NOT (version = 5 AND k % 3 = 0) GROUP BY version""")
def keyed_versions(spark, sf):
    """Events of a user by batch, upserted in four writes, then a deletion; every version is read back."""
    rows = table(spark, sf, "events").select("event_id", F.col("user_id").alias("k"))
    batch = (F.col("event_id") % 4 + 1).cast("int")
    batches = rows.withColumn("batch", batch).groupBy("batch", "k").agg(F.max("event_id").alias("last"), F.count(F.lit(1)).alias("n"))
    schema = StructType([StructField(c, LongType()) for c in ("k", "last", "n")])
    kept = store.KeyedTable(spark, f"{checkpoint_root(spark)}/foliospark/versions-{uuid.uuid4().hex}", "k", schema)
    for b in range(1, 5):
        kept.upsert(batches.where(F.col("batch") == b).select("k", "last", "n"))
    kept.delete(rows.where("k % 3 = 0").select("k"))
    sums = lambda v: kept.read(v).agg(F.count(F.lit(1)).alias("keys"), F.sum("last").alias("last"), F.sum("n").alias("n"))
    return reduce(DataFrame.unionByName, [sums(v).select(F.lit(v).alias("version"), "*") for v in kept.versions()])
