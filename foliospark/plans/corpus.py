"""Text, chunking, duplicate, audit and remediation queries over ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import text as tx
from foliospark.operators import audit, chunking, dedup, remediation, similarity
from foliospark.plans.registry import CORPUS_SQL, corpus, query
from foliospark.staging import stage

# Regular-expression pieces shared by the SQL twins (RE2 spelling of the classes in functions.text).
WS = r"[\t-\r\x1c- \x{85}\p{Z}]"
STRIP = lambda x: f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"
SQUEEZE = lambda x: f"regexp_replace({x}, '{WS}+', ' ', 'g')"
FOLD = lambda x: f"replace(translate(lower({x}), 'ςſ', 'σs'), 'ß', 'ss')"
TOKENS = lambda x: f"regexp_extract_all({x}, '[\\p{{L}}\\p{{N}}_]+')"
PRINT = lambda x: f"sha256({SQUEEZE(STRIP(f'lower({x})'))})"
NON_DIGIT = r"[^\p{Nd}²³¹⁰⁴-⁹₀-₉]+"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
BOILERPLATE = chunking.BOILERPLATE

SEGMENTS_SQL = rf"""segments AS (
  SELECT doc_id, file_path, seg_index, seg FROM (
    SELECT doc_id, file_path,
           unnest(list_filter(list_transform(string_split_regex(content, '\n{WS}*\n+'), lambda p: {STRIP('p')}), lambda p: p <> '')) AS seg,
           generate_subscripts(list_filter(list_transform(string_split_regex(content, '\n{WS}*\n+'), lambda p: {STRIP('p')}), lambda p: p <> ''), 1) AS seg_index
    FROM corpus))"""
WINDOWS_SQL = rf"""{SEGMENTS_SQL},
windows AS (
  SELECT doc_id, file_path, row_number() OVER (PARTITION BY doc_id ORDER BY seg_index, w) - 1 AS chunk_index, chunk
  FROM (
    SELECT doc_id, file_path, seg_index, w, {STRIP('substring(seg, w * 880 + 1, 1000)')} AS chunk
    FROM (
      SELECT *, unnest(range(CASE WHEN length(seg) <= 1000 THEN 1
                             ELSE 1 + CAST(ceil((length(seg) - 1000) / 880.0) AS INTEGER) END)) AS w
      FROM segments))
  WHERE chunk <> '')"""
REASON_SQL = rf"""CASE
    WHEN length(chunk) < 60 THEN 'too_short'
    WHEN length(regexp_replace(chunk, '[^\p{{L}}]+', '', 'g')) / length(chunk) < 0.30 THEN 'low_alpha_ratio'
    WHEN length(regexp_replace(chunk, '{NON_DIGIT}', '', 'g')) / length(chunk) > 0.60 THEN 'high_numeric_ratio'
    WHEN len(list_distinct(list_filter(string_split_regex(lower(chunk), '{WS}+'), lambda w: w <> ''))) < 5 THEN 'low_vocabulary'
    WHEN regexp_matches(substring(lower(chunk), 1, 200), '{BOILERPLATE}') THEN 'boilerplate'
  END"""
CHUNKS_SQL = rf"""{WINDOWS_SQL},
accepted AS (SELECT *, {REASON_SQL} AS reason FROM windows),
first_seen AS (
  SELECT doc_id, file_path, chunk, min(chunk_index) AS seen FROM accepted WHERE reason IS NULL GROUP BY ALL),
chunks AS (
  SELECT doc_id, file_path, row_number() OVER (PARTITION BY doc_id ORDER BY seen) - 1 AS chunk_index, chunk AS text
  FROM first_seen)"""


@query("doc_tokens", rf"""WITH {CORPUS_SQL}
SELECT file_path, len({TOKENS('lower(content)')}) AS tokens,
       len(list_distinct({TOKENS('lower(content)')})) AS distinct_tokens,
       sha256(array_to_string({TOKENS('lower(content)')}, ' ')) AS tokens_sha
FROM corpus""")
def doc_tokens(spark, sf):
    t = corpus(spark, sf).select("file_path", tx.tokens("content").alias("t"))
    return t.select(
        "file_path",
        F.size("t").cast("long").alias("tokens"),
        F.size(F.array_distinct("t")).cast("long").alias("distinct_tokens"),
        F.sha2(F.array_join("t", " "), 256).alias("tokens_sha"),
    )


@query("doc_casefold_tokens", rf"""WITH {CORPUS_SQL}
SELECT file_path, sha256(array_to_string({TOKENS(FOLD('content'))}, ' ')) AS tokens_sha FROM corpus""")
def doc_casefold_tokens(spark, sf):
    return corpus(spark, sf).select(
        "file_path", F.sha2(F.array_join(tx.folded_tokens("content"), " "), 256).alias("tokens_sha")
    )


@query("doc_fingerprint", f"""WITH {CORPUS_SQL}
SELECT file_path, {PRINT('content')} AS fingerprint FROM corpus""")
def doc_fingerprint(spark, sf):
    return dedup.with_fingerprint(corpus(spark, sf)).select("file_path", "fingerprint")


SANITIZED_SQL = (
    r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content,
      '\r\n?', chr(10), 'g'), '\x00', '', 'g'), '[\x01-\x08\x0b\x0c\x0e-\x1f\x7f]', ' ', 'g'), '[ \t]+', ' ', 'g'),
      ' ?\n ?', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')"""
)


@query("doc_sanitize", f"""WITH {CORPUS_SQL}, s AS (
  SELECT file_path, content, {STRIP(SANITIZED_SQL)} AS clean FROM corpus)
SELECT file_path, sha256(clean) AS clean_sha, length(clean) AS clean_chars, clean <> content AS changed FROM s""")
def doc_sanitize(spark, sf):
    s = corpus(spark, sf).withColumn("clean", tx.sanitize("content"))
    return s.select(
        "file_path",
        F.sha2("clean", 256).alias("clean_sha"),
        F.length("clean").cast("long").alias("clean_chars"),
        (F.col("clean") != F.col("content")).alias("changed"),
    )


@query("sanitize_stats", f"""WITH {CORPUS_SQL}, s AS (SELECT content, {STRIP(SANITIZED_SQL)} AS clean FROM corpus)
SELECT count(*) FILTER (clean <> content) AS documents,
       CAST(sum(CASE WHEN clean <> content THEN abs(length(content) - length(clean)) ELSE 0 END) AS BIGINT) AS changed_characters
FROM s""")
def sanitize_stats(spark, sf):
    s = corpus(spark, sf).select("content", tx.sanitize("content").alias("clean"))
    changed = F.col("clean") != F.col("content")
    delta = F.abs(F.length("content") - F.length("clean"))
    return s.agg(
        F.count_if(changed).alias("documents"),
        F.sum(F.when(changed, delta).otherwise(0)).alias("changed_characters"),
    )


@query("chunk_windows", f"""WITH {CORPUS_SQL}, {WINDOWS_SQL}
SELECT file_path, chunk_index, length(chunk) AS chars, sha256(chunk) AS chunk_sha FROM windows""")
def chunk_windows(spark, sf):
    df = chunking.with_windows(corpus(spark, sf), "content", "file_extension", "chunks")
    return chunking.explode_chunks(df, "file_path").select(
        "file_path",
        F.col("chunk_index").cast("long").alias("chunk_index"),
        F.length("text").cast("long").alias("chars"),
        F.sha2("text", 256).alias("chunk_sha"),
    )


@query("chunk_quality", f"""WITH {CORPUS_SQL}, {WINDOWS_SQL}
SELECT coalesce(reason, 'accepted') AS reason, count(*) AS chunks
FROM (SELECT {REASON_SQL} AS reason FROM windows) GROUP BY 1""")
def chunk_quality(spark, sf):
    df = chunking.with_windows(corpus(spark, sf), "content", "file_extension", "chunks")
    reason = F.coalesce(chunking.quality_reason("text"), F.lit("accepted"))
    return (
        chunking.explode_chunks(df, "file_path")
        .groupBy(reason.alias("reason"))
        .agg(F.count(F.lit(1)).alias("chunks"))
    )


@query("doc_chunks", f"""WITH {CORPUS_SQL}, {CHUNKS_SQL}
SELECT file_path, chunk_index, sha256(text) AS chunk_sha FROM chunks""")
def doc_chunks(spark, sf):
    df = chunking.with_chunks(corpus(spark, sf))
    return chunking.explode_chunks(df, "file_path").select(
        "file_path", F.col("chunk_index").cast("long").alias("chunk_index"), F.sha2("text", 256).alias("chunk_sha")
    )


@query("chunk_dedup", f"""WITH {CORPUS_SQL}, {CHUNKS_SQL}
SELECT a.file_path, a.n AS accepted, coalesce(u.n, 0) AS kept, a.n - coalesce(u.n, 0) AS removed
FROM (SELECT file_path, count(*) FILTER (reason IS NULL) AS n FROM accepted GROUP BY 1) a
LEFT JOIN (SELECT file_path, count(*) AS n FROM chunks GROUP BY 1) u USING (file_path)""")
def chunk_dedup(spark, sf):
    df = chunking.with_windows(corpus(spark, sf), "content", "file_extension", "w")
    df = df.where(F.size("w") > 0).withColumn("a", F.filter("w", lambda c: chunking.quality_reason(c).isNull()))
    n, u = F.size("a").cast("long"), F.size(F.array_distinct("a")).cast("long")
    return df.select("file_path", n.alias("accepted"), u.alias("kept"), (n - u).alias("removed"))


@query("doc_from_chunks", rf"""WITH {CORPUS_SQL}, {CHUNKS_SQL}
SELECT file_path, sha256(string_agg(text, chr(10) || chr(10) ORDER BY chunk_index)) AS content_sha,
       strlen(string_agg(text, chr(10) || chr(10) ORDER BY chunk_index)) AS size_bytes,
       substring({STRIP("replace(min_by(text, chunk_index), chr(10), ' ')")}, 1, 220) AS preview
FROM chunks GROUP BY file_path""")
def doc_from_chunks(spark, sf):
    rows = chunking.explode_chunks(chunking.with_chunks(corpus(spark, sf)), "file_path")
    return chunking.join_chunks(rows, "file_path").select(
        "file_path",
        F.sha2("content", 256).alias("content_sha"),
        F.col("size_bytes").cast("long").alias("size_bytes"),
        "preview",
    )


@query("doc_duplicates", f"""WITH {CORPUS_SQL}, p AS (SELECT file_path, {PRINT('content')} AS fingerprint FROM corpus)
SELECT file_path, fingerprint, first AS duplicate_of
FROM (SELECT *, min(file_path) OVER (PARTITION BY fingerprint) AS first FROM p) WHERE file_path <> first""")
def doc_duplicates(spark, sf):
    return dedup.detect_duplicates(dedup.with_fingerprint(corpus(spark, sf)).select("file_path", "fingerprint"))


@query("duplicate_groups", f"""WITH {CORPUS_SQL}
SELECT {PRINT('content')} AS fingerprint, min(file_path) AS kept_path, count(*) AS copies
FROM corpus GROUP BY 1 HAVING count(*) > 1""")
def duplicate_groups(spark, sf):
    return dedup.duplicate_groups(dedup.with_fingerprint(corpus(spark, sf)).select("file_path", "fingerprint"))


FEATURES_SQL = rf"""{CHUNKS_SQL},
base AS (
  SELECT file_path, strlen(content) AS size_bytes, {PRINT('content')} AS fingerprint, {STRIP('content')} AS body FROM corpus),
tok AS (SELECT file_path, {TOKENS(FOLD('body'))} AS t FROM base),
line AS (
  SELECT file_path, unnest(list_filter(list_transform(string_split_regex(body, '{LINE_END}'),
           lambda x: {SQUEEZE(FOLD(STRIP('x')))}), lambda x: x <> '')) AS l FROM base),
line_counts AS (SELECT file_path, l, count(*) AS n FROM line GROUP BY ALL),
rep AS (
  SELECT file_path, CASE WHEN sum(n) > 1 THEN coalesce(sum(n) FILTER (n > 1), 0) / sum(n) ELSE 0 END AS repetition_ratio
  FROM line_counts GROUP BY 1),
usable AS (SELECT file_path, count(*) AS n FROM chunks GROUP BY 1),
term_pos AS (SELECT file_path, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM tok),
term_n AS (
  SELECT file_path, term, count(*) AS tf, min(pos) AS first FROM term_pos
  WHERE length(term) >= 4 AND regexp_replace(term, '{NON_DIGIT}', '', 'g') <> term GROUP BY ALL),
sig AS (
  SELECT file_path, term, rk FROM (
    SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY tf DESC, first) AS rk FROM term_n) WHERE rk <= 24),
features AS (
  SELECT b.file_path, b.size_bytes, b.fingerprint, length(body) AS char_count, len(t) AS token_count,
         CASE WHEN len(t) > 0 THEN len(list_distinct(t)) / len(t) ELSE 0 END AS unique_token_ratio,
         CASE WHEN length(body) > 0 THEN length(regexp_replace(body, '{NON_DIGIT}', '', 'g')) / length(body) ELSE 0 END AS numeric_ratio,
         coalesce(repetition_ratio, 0) AS repetition_ratio, coalesce(usable.n, 0) AS usable_chunk_count
  FROM base b JOIN tok USING (file_path) LEFT JOIN rep USING (file_path) LEFT JOIN usable USING (file_path))"""
AUDIT_SQL = rf"""{FEATURES_SQL},
batched AS (
  SELECT *, (row_number() OVER (ORDER BY size_bytes, lower(file_path), file_path) - 1) // 200 AS batch_id FROM features),
med AS (SELECT *, median(char_count) OVER b AS cm, median(token_count) OVER b AS tm FROM batched
        WINDOW b AS (PARTITION BY batch_id)),
mad AS (SELECT *, median(abs(char_count - cm)) OVER b AS ca, median(abs(token_count - tm)) OVER b AS ta,
               min(file_path) OVER (PARTITION BY batch_id, fingerprint) AS kept FROM med
        WINDOW b AS (PARTITION BY batch_id)),
judged AS (
  SELECT *,
    CASE WHEN ca = 0 THEN CASE WHEN cm = 0 THEN char_count > 0 ELSE char_count >= cm * 3 OR char_count <= cm / 3 END
         ELSE abs((char_count - cm) * 0.6745 / ca) > 3.5 END AS char_out,
    CASE WHEN ta = 0 THEN CASE WHEN tm = 0 THEN token_count > 0 ELSE token_count >= tm * 3 OR token_count <= tm / 3 END
         ELSE abs((token_count - tm) * 0.6745 / ta) > 3.5 END AS token_out FROM mad),
flagged AS (
  SELECT batch_id, file_path, CASE WHEN file_path <> kept THEN kept END AS duplicate_of,
    list_filter([
      CASE WHEN char_out THEN 'char_count_outlier' END,
      CASE WHEN token_count >= 20 AND unique_token_ratio < 0.2 THEN 'low_vocabulary_document' END,
      CASE WHEN usable_chunk_count = 0 THEN 'no_usable_chunks' END,
      CASE WHEN numeric_ratio > 0.35 THEN 'numeric_heavy' END,
      CASE WHEN repetition_ratio > 0.4 THEN 'repetitive_content' END,
      CASE WHEN token_out THEN 'token_count_outlier' END,
      CASE WHEN char_count > 0 AND char_count < 200 THEN 'very_short_document' END], lambda f: f IS NOT NULL) AS flags
  FROM judged)"""
CLUSTER_SQL = f"""{AUDIT_SQL},
batch_sig AS (SELECT batch_id, s.file_path, term FROM sig s JOIN batched USING (file_path)),
sig_size AS (SELECT batch_id, file_path, count(*) AS n FROM batch_sig GROUP BY ALL),
pair AS (
  SELECT a.batch_id, a.file_path AS pa, b.file_path AS pb, count(*) AS shared
  FROM batch_sig a JOIN batch_sig b ON a.batch_id = b.batch_id AND a.term = b.term AND a.file_path < b.file_path GROUP BY ALL),
jac AS (
  SELECT p.batch_id, pa, pb, shared / (x.n + y.n - shared) AS j
  FROM pair p JOIN sig_size x ON x.file_path = pa JOIN sig_size y ON y.file_path = pb),
edge AS (SELECT pa AS u, pb AS v FROM jac WHERE j >= 0.3 UNION ALL SELECT pb, pa FROM jac WHERE j >= 0.3),
reach AS (
  SELECT u, v FROM edge UNION SELECT r.u, e.v FROM reach r JOIN edge e ON r.v = e.u),
member AS (SELECT u AS file_path, least(u, min(v)) AS cluster_id FROM reach GROUP BY u),
size_of AS (SELECT cluster_id, count(*) AS n FROM member GROUP BY 1)"""


@query("doc_text_features", f"""WITH {CORPUS_SQL}, {FEATURES_SQL}
SELECT file_path, char_count, token_count, round(unique_token_ratio, 6) AS unique_token_ratio,
       round(numeric_ratio, 6) AS numeric_ratio, round(repetition_ratio, 6) AS repetition_ratio, usable_chunk_count
FROM features""")
def doc_text_features(spark, sf):
    return audit.document_features(corpus(spark, sf)).select(
        "file_path",
        *[F.col(c).cast("long").alias(c) for c in ("char_count", "token_count", "usable_chunk_count")],
        *[F.round(c, 6).alias(c) for c in ("unique_token_ratio", "numeric_ratio", "repetition_ratio")],
    )


@query("signature_terms", f"""WITH {CORPUS_SQL}, {FEATURES_SQL}
SELECT file_path, string_agg(term, ' ' ORDER BY rk) AS terms FROM sig GROUP BY 1""")
def signature_terms(spark, sf):
    f = audit.document_features(corpus(spark, sf)).where(F.size("signature_terms") > 0)
    return f.select("file_path", F.array_join("signature_terms", " ").alias("terms"))


@query("robust_stats", f"""WITH {CORPUS_SQL}, v AS (SELECT length({STRIP('content')}) AS x FROM corpus),
m AS (SELECT median(x) AS median FROM v)
SELECT any_value(median) AS median, median(abs(x - median)) AS mad FROM v, m""")
def robust_stats(spark, sf):
    return audit.robust_stats(corpus(spark, sf).select(F.length(tx.strip("content")).alias("x")), "x")


@query("audit_batches", f"""WITH {CORPUS_SQL}, b AS (
  SELECT file_path, strlen(content) AS size_bytes,
         (row_number() OVER (ORDER BY strlen(content), lower(file_path), file_path) - 1) // 200 AS batch_id FROM corpus)
SELECT batch_id, count(*) AS documents, min(size_bytes) AS smallest, max(size_bytes) AS largest FROM b GROUP BY 1""")
def audit_batches(spark, sf):
    docs = corpus(spark, sf).select(
        "file_path", F.octet_length("content").cast("long").alias("size_bytes"), F.lit(0).alias("scan_priority")
    )
    return audit.assign_batches(docs).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("documents"),
        F.min("size_bytes").alias("smallest"),
        F.max("size_bytes").alias("largest"),
    )


@query("doc_outliers", f"""WITH {CORPUS_SQL}, {AUDIT_SQL}
SELECT batch_id, file_path, array_to_string(flags, ',') AS reasons FROM flagged WHERE len(flags) > 0""")
def doc_outliers(spark, sf):
    batched = audit.assign_batches(audit.document_features(corpus(spark, sf)))
    flagged = audit.with_outlier_flags(batched).where(F.size("flags") > 0)
    return flagged.select("batch_id", "file_path", F.array_join("flags", ",").alias("reasons"))


@query("corpus_flag_counts", f"""WITH {CORPUS_SQL}, {AUDIT_SQL}
SELECT flag, count(*) AS documents FROM (SELECT unnest(flags) AS flag FROM flagged) GROUP BY 1""")
def corpus_flag_counts(spark, sf):
    batched = audit.assign_batches(audit.document_features(corpus(spark, sf)))
    return audit.flag_counts(audit.with_outlier_flags(batched))


@query("doc_clusters", f"""WITH RECURSIVE {CORPUS_SQL}, {CLUSTER_SQL},
mean AS (
  SELECT a.cluster_id, sum(coalesce(j, 0)) / count(*) AS m
  FROM member a JOIN member b ON a.cluster_id = b.cluster_id AND a.file_path < b.file_path
  LEFT JOIN jac ON pa = a.file_path AND pb = b.file_path GROUP BY 1),
common AS (
  SELECT cluster_id, list_sort(list(term)) AS terms FROM (
    SELECT cluster_id, term FROM member JOIN batch_sig USING (file_path) JOIN size_of USING (cluster_id)
    GROUP BY cluster_id, term, size_of.n HAVING count(*) = size_of.n) GROUP BY 1)
SELECT cluster_id, n AS members, round(m, 3) AS average_similarity,
       coalesce(array_to_string(terms[1:8], ' '), '') AS shared_terms,
       (SELECT string_agg(file_path, ',' ORDER BY file_path) FROM member x WHERE x.cluster_id = size_of.cluster_id) AS member_paths
FROM size_of JOIN mean USING (cluster_id) LEFT JOIN common USING (cluster_id)""")
def doc_clusters(spark, sf):
    found = audit.clusters(audit.audit_documents(corpus(spark, sf)))
    return found.select(
        "cluster_id",
        F.size("member_paths").cast("long").alias("members"),
        "average_similarity",
        F.array_join("shared_terms", " ").alias("shared_terms"),
        F.array_join("member_paths", ",").alias("member_paths"),
    )


@query("similarity_links", f"""WITH {CORPUS_SQL}, {CLUSTER_SQL.split('edge AS')[0].rstrip().rstrip(',')}
SELECT batch_id, count(DISTINCT file_path) AS documents,
       coalesce(any_value(l.n), 0) AS linked_pairs
FROM batched b LEFT JOIN (SELECT batch_id, count(*) AS n FROM jac WHERE j >= 0.3 GROUP BY 1) l USING (batch_id)
GROUP BY batch_id""")
def similarity_links(spark, sf):
    return audit.audit_documents(corpus(spark, sf)).groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("documents"), (F.sum("links") / 2).cast("long").alias("linked_pairs")
    )


CORPUS_LINK_SQL = f"""{FEATURES_SQL},
sized AS (SELECT file_path, count(*) AS n FROM sig GROUP BY 1),
pair AS (SELECT a.file_path AS pa, b.file_path AS pb, count(*) AS shared FROM sig a JOIN sig b ON a.term = b.term AND a.file_path < b.file_path GROUP BY ALL),
link AS (
  SELECT pa, pb, shared / (x.n + y.n - shared) AS j FROM pair JOIN sized x ON x.file_path = pa JOIN sized y ON y.file_path = pb
  WHERE shared >= 0.3 * (x.n + y.n - shared) - 1e-9),
edge AS (SELECT pa AS u, pb AS v, j FROM link UNION ALL SELECT pb, pa, j FROM link),
near AS (SELECT u, count(*) AS links, sum(j) / count(*) AS mean_similarity FROM edge GROUP BY 1),
step AS (
  SELECT 0 AS i, u, u AS label FROM near
  UNION ALL
  SELECT i, u, least(label, m) FROM (
    SELECT s.i + 1 AS i, s.u, any_value(s.label) AS label, min(o.label) AS m
    FROM step s JOIN edge e ON e.u = s.u JOIN step o ON o.u = e.v AND o.i = s.i WHERE s.i < 25 GROUP BY s.i, s.u)),
corpus_member AS (SELECT u AS file_path, label AS cluster_id, count(*) OVER (PARTITION BY label) AS cluster_size FROM step WHERE i = 25)"""


@query("corpus_clusters", f"""WITH RECURSIVE {CORPUS_SQL}, {CORPUS_LINK_SQL}
SELECT file_path, cluster_id, coalesce(cluster_size, 1) AS cluster_size, coalesce(links, 0) AS links,
       round(mean_similarity, 6) AS mean_similarity
FROM features LEFT JOIN corpus_member USING (file_path) LEFT JOIN near ON near.u = file_path""")
def corpus_clusters(spark, sf):
    """Similarity clusters over all documents, not only inside an ingestion batch."""
    features = audit.document_features(corpus(spark, sf))
    return similarity.clusters(features).withColumn("mean_similarity", F.round("mean_similarity", 6))


@query("corpus_cluster_terms", f"""WITH RECURSIVE {CORPUS_SQL}, {CORPUS_LINK_SQL},
everywhere AS (
  SELECT cluster_id, term FROM corpus_member JOIN sig USING (file_path) GROUP BY cluster_id, cluster_size, term HAVING count(*) = cluster_size)
SELECT DISTINCT m.cluster_id, cluster_size,
       coalesce((SELECT array_to_string(list_sort(list(term))[1:8], ' ') FROM everywhere e WHERE e.cluster_id = m.cluster_id), '') AS shared_terms
FROM corpus_member m""")
def corpus_cluster_terms(spark, sf):
    features = stage(audit.document_features(corpus(spark, sf)).select("file_path", "signature_terms"), "signatures")
    found = similarity.shared_terms(similarity.clusters(features), features)
    return found.withColumn("shared_terms", F.array_join("shared_terms", " "))


PLAN_SQL = f"""{CLUSTER_SQL},
decided AS (
  SELECT file_path, duplicate_of, list_sort(flags
      || CASE WHEN duplicate_of IS NOT NULL THEN ['duplicate_document'] ELSE [] END
      || CASE WHEN cluster_id IS NOT NULL THEN ['cluster_similar_document'] ELSE [] END) AS flags
  FROM flagged LEFT JOIN member USING (file_path)),
plan AS (
  SELECT *, CASE
      WHEN list_contains(flags, 'duplicate_document') THEN 'ignore_duplicate'
      WHEN list_has_any(flags, ['low_vocabulary_document', 'no_usable_chunks', 'numeric_heavy', 'repetitive_content',
                                'very_short_document']) THEN 'isolate'
      WHEN len(flags) > 0 THEN 'index_with_review' ELSE 'index' END AS action
  FROM decided)"""


@query("remediation_plan", f"""WITH RECURSIVE {CORPUS_SQL}, {PLAN_SQL}
SELECT file_path, array_to_string(flags, ',') AS flags, action,
       action IN ('index', 'index_with_review') AS should_index, duplicate_of FROM plan""")
def remediation_plan(spark, sf):
    decisions = remediation.plan(audit.audit_documents(corpus(spark, sf)))
    return decisions.withColumn("flags", F.array_join("flags", ","))


@query("remediation_counts", f"""WITH RECURSIVE {CORPUS_SQL}, {PLAN_SQL}
SELECT action, count(*) AS documents FROM plan GROUP BY 1""")
def remediation_counts(spark, sf):
    return remediation.action_counts(remediation.plan(audit.audit_documents(corpus(spark, sf))))


@query("audit_summary", f"""WITH RECURSIVE {CORPUS_SQL}, {CLUSTER_SQL}
SELECT (SELECT count(*) FROM flagged) AS total_documents,
       (SELECT count(duplicate_of) FROM flagged) AS duplicates,
       (SELECT count(*) FROM flagged WHERE len(flags) > 0) AS outliers,
       (SELECT count(*) FROM size_of) AS clusters""")
def audit_summary(spark, sf):
    return audit.summary(audit.audit_documents(corpus(spark, sf)))
