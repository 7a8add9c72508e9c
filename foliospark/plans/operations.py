"""Audit history, report, dashboard, alert and retention queries.

The driver tables hold no audit or run logs, so both sides derive them from
``events`` in the same way: an event is one audit decision, one agent run and
one tool execution.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import catalog
from foliospark.operators import control, history, store
from foliospark.plans.corpus import STRIP
from foliospark.plans.registry import CORPUS_SQL, corpus, query, table
from foliospark.plans.search import META_SQL

# How an event type reads as a decision, its flags and a run status.
ACTIONS = {
    "view": "index", "click": "index_with_review", "purchase": "isolate", "signup": "ignore_duplicate",
    "error": "ocr_required",
}
FLAGS = {
    "click": ["cluster_similar_document"], "purchase": ["numeric_heavy", "repetitive_content"],
    "signup": ["duplicate_document"], "error": ["ocr_required"],
}
STATUSES = {
    "view": "completed", "click": "completed", "purchase": "completed", "signup": "running", "error": "failed",
}


def case_sql(column: str, mapping: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


def case_col(column: str, mapping: dict[str, str]):
    out = F.when(F.lit(False), F.lit(""))
    for k, v in mapping.items():
        out = out.when(F.col(column) == k, v)
    return out


FLAGS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in FLAGS.items()) + " ELSE [] END"
EVENTS_SQL = f"""ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
history AS (
  SELECT event_id AS id, ts AS audit_timestamp,
         'src' || CAST(user_id % 20 AS VARCHAR) || '/' || lpad(CAST(user_id AS VARCHAR), 12, '0') || '.txt' AS file_path,
         {case_sql('event_type', ACTIONS)} AS remediation_action, {FLAGS_SQL} AS flags,
         event_type IN ('view', 'click') AS should_index, CASE WHEN k < 50 THEN 'index' ELSE 'audit' END AS source_command
  FROM ev),
runs AS (
  SELECT event_id AS run_id, ts AS created_at, {case_sql('event_type', STATUSES)} AS status,
         CAST(floor(value * 100) AS BIGINT) AS latency_ms, k AS tokens,
         CASE WHEN k > 80 THEN NULL ELSE 'agent' || CAST(user_id % 4 AS VARCHAR) END AS triggered_by,
         k > 90 AS guardrail_blocked
  FROM ev),
tools AS (
  SELECT event_id AS execution_id, ts AS executed_at, 'tool' || CAST(k % 12 AS VARCHAR) AS tool_name,
         CASE WHEN event_type = 'error' THEN 'error' WHEN k > 95 THEN 'timeout' ELSE 'success' END AS status
  FROM ev),
clock AS (SELECT max(ts) AS now FROM events)"""


def events(spark, sf):
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").withColumn("k", k)


def audit_history(spark, sf):
    path = F.concat(
        F.lit("src"), (F.col("user_id") % 20).cast("string"), F.lit("/"),
        F.lpad(F.col("user_id").cast("string"), 12, "0"), F.lit(".txt"),
    )
    flags = F.array().cast("array<string>")
    for k, v in FLAGS.items():
        flags = F.when(F.col("event_type") == k, F.array(*[F.lit(x) for x in v])).otherwise(flags)
    return events(spark, sf).select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("audit_timestamp"),
        path.alias("file_path"),
        case_col("event_type", ACTIONS).alias("remediation_action"),
        flags.alias("flags"),
        F.col("event_type").isin("view", "click").alias("should_index"),
        F.when(F.col("k") < 50, "index").otherwise("audit").alias("source_command"),
    )


def agent_runs(spark, sf):
    return events(spark, sf).select(
        F.col("event_id").alias("run_id"),
        F.col("ts").alias("created_at"),
        case_col("event_type", STATUSES).alias("status"),
        F.floor(F.col("value") * 100).cast("long").alias("latency_ms"),
        F.col("k").alias("tokens"),
        F.when(F.col("k") <= 80, F.concat(F.lit("agent"), (F.col("user_id") % 4).cast("string"))).alias("triggered_by"),
        (F.col("k") > 90).alias("guardrail_blocked"),
    )


def tool_executions(spark, sf):
    status = F.when(F.col("event_type") == "error", "error").when(F.col("k") > 95, "timeout").otherwise("success")
    return events(spark, sf).select(
        F.col("event_id").alias("execution_id"),
        F.col("ts").alias("executed_at"),
        F.concat(F.lit("tool"), (F.col("k") % 12).cast("string")).alias("tool_name"),
        status.alias("status"),
    )


def clock(spark, sf):
    """The newest event time as a scalar; reports never read the wall clock."""
    return table(spark, sf, "events").agg(F.max("ts")).scalar()


@query("latest_decision", f"""WITH {EVENTS_SQL}
SELECT file_path, id, remediation_action, should_index, source_command, array_to_string(flags, ',') AS flags FROM (
  SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY audit_timestamp DESC, id DESC) AS rn FROM history) WHERE rn = 1""")
def latest_decision(spark, sf):
    return history.latest_decisions(audit_history(spark, sf)).select(
        "file_path", "id", "remediation_action", "should_index", "source_command",
        F.array_join("flags", ",").alias("flags"),
    )


@query("history_page", f"""WITH {EVENTS_SQL}
SELECT id, file_path, remediation_action FROM history WHERE source_command = 'audit' AND remediation_action = 'isolate'
ORDER BY audit_timestamp DESC, id DESC LIMIT 20 OFFSET 20""")
def history_page(spark, sf):
    rows = history.filter_history(audit_history(spark, sf), source_command="audit", action="isolate")
    return history.page(rows, 20, 20).select("id", "file_path", "remediation_action")


@query("history_summary", f"""WITH {EVENTS_SQL}
SELECT remediation_action, count(*) AS events FROM history WHERE source_command = 'audit' GROUP BY 1""")
def history_summary(spark, sf):
    return history.action_summary(history.filter_history(audit_history(spark, sf), source_command="audit"))


@query("history_counts", f"""WITH {EVENTS_SQL} SELECT file_path, count(*) AS events,
  count(*) FILTER (should_index) AS indexable FROM history GROUP BY 1""")
def history_counts(spark, sf):
    return audit_history(spark, sf).groupBy("file_path").agg(
        F.count(F.lit(1)).alias("events"), F.count_if("should_index").alias("indexable")
    )


@query("schedule_status", f"""WITH {EVENTS_SQL}
SELECT status, count(*) AS runs, strftime(max(created_at), '%Y-%m-%d %H:%M:%S') AS latest
FROM (SELECT * FROM runs ORDER BY created_at DESC, run_id DESC LIMIT 20) GROUP BY 1""")
def schedule_status(spark, sf):
    runs = agent_runs(spark, sf).select(F.col("run_id").alias("id"), F.col("created_at").alias("run_timestamp"), "status")
    return history.recent_status_counts(runs).withColumn("latest", F.date_format("latest", "yyyy-MM-dd HH:mm:ss"))


REPORT_SQL = f"""{EVENTS_SQL}, {CORPUS_SQL}, {META_SQL},
latest AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY file_path ORDER BY audit_timestamp DESC, id DESC) AS rn FROM history) WHERE rn = 1),
report AS (
  SELECT coalesce(d.file_path, l.file_path) AS file_path, d.file_path IS NOT NULL AS indexed,
         CASE WHEN d.file_path IS NULL THEN '' ELSE '.txt' END AS file_extension, coalesce(d.theme, '') AS theme,
         coalesce(length(d.content), 0) AS content_length, coalesce(l.remediation_action, '') AS latest_action,
         l.should_index AS latest_should_index, coalesce(l.source_command, '') AS latest_source_command,
         coalesce(l.flags, []) AS latest_flags
  FROM meta d FULL OUTER JOIN latest l ON d.file_path = l.file_path)"""


def report(spark, sf):
    meta = catalog.metadata("file_path", "content")
    documents = corpus(spark, sf).select(
        "file_path", "file_extension", meta["theme"].alias("theme"), F.length("content").alias("content_length")
    )
    return history.report_rows(documents, history.latest_decisions(audit_history(spark, sf)))


@query("report_full_outer", f"""WITH {REPORT_SQL}
SELECT file_path, indexed, file_extension, theme, content_length, latest_action, latest_should_index,
       latest_source_command, array_to_string(latest_flags, ',') AS latest_flags FROM report""")
def report_full_outer(spark, sf):
    return report(spark, sf).withColumn("latest_flags", F.array_join("latest_flags", ",")).drop("audit_timestamp")


@query("report_summary", f"""WITH {REPORT_SQL}
SELECT count(*) FILTER (indexed) AS indexed_documents, count(*) FILTER (latest_action <> '') AS documents_with_history,
  count(*) AS rows_total, count(*) FILTER (latest_action = 'ocr_required') AS pending_ocr_documents,
  count(*) FILTER (latest_action = 'index_with_review') AS review_documents,
  count(*) FILTER (latest_action = 'isolate') AS isolated_documents,
  count(*) FILTER (latest_action = 'ignore_duplicate') AS duplicate_documents,
  count(*) FILTER (indexed AND latest_action = '') AS indexed_without_history FROM report""")
def report_summary(spark, sf):
    return history.report_summary(report(spark, sf))


@query("report_counts", f"""WITH {REPORT_SQL}, u AS (
  SELECT 'extension' AS dimension, file_extension AS value FROM report UNION ALL SELECT 'theme', theme FROM report
  UNION ALL SELECT 'action', latest_action FROM report UNION ALL SELECT 'source', latest_source_command FROM report
  UNION ALL SELECT 'flag', unnest(latest_flags) FROM report)
SELECT dimension, value, count(*) AS files FROM u WHERE value <> '' GROUP BY ALL""")
def report_counts(spark, sf):
    return history.report_counts(report(spark, sf))


@query("orphans_anti", f"""WITH {EVENTS_SQL}, {CORPUS_SQL}
SELECT file_path FROM corpus WHERE file_path NOT IN (SELECT file_path FROM history)""")
def orphans_anti(spark, sf):
    """Stored documents that the current listing (paths with history) no longer has."""
    return store.orphans(corpus(spark, sf).select("file_path"), audit_history(spark, sf))


# Two snapshots of the same folder: before and after half of it changed.
SNAPSHOT_SQL = f"""{CORPUS_SQL},
previous AS (SELECT file_path, length(content) AS size, 100 AS mtime FROM corpus WHERE lang <> 'de'),
current AS (SELECT file_path, length(content) AS size, CASE WHEN lang = 'fr' THEN 200 ELSE 100 END AS mtime
            FROM corpus WHERE lang <> 'es')"""


@query("snapshot_diff", f"""WITH {SNAPSHOT_SQL}
SELECT coalesce(c.file_path, p.file_path) AS file_path,
  CASE WHEN p.file_path IS NULL THEN 'added' WHEN c.file_path IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM current c FULL OUTER JOIN previous p ON c.file_path = p.file_path
WHERE p.file_path IS NULL OR c.file_path IS NULL OR p.size <> c.size OR p.mtime <> c.mtime""")
def snapshot_diff(spark, sf):
    docs = corpus(spark, sf)
    base = lambda mtime: [F.col("file_path"), F.length("content").alias("size"), mtime.alias("mtime")]
    previous = docs.where(F.col("lang") != "de").select(*base(F.lit(100)))
    current = docs.where(F.col("lang") != "es").select(*base(F.when(F.col("lang") == "fr", 200).otherwise(100)))
    return store.snapshot_changes(previous, current)


@query("upsert_actions", f"""WITH {CORPUS_SQL},
stored AS (SELECT file_path, sha256(content) AS h FROM corpus WHERE lang <> 'de'),
incoming AS (SELECT file_path, sha256(CASE WHEN lang = 'fr' THEN content || '!' ELSE content END) AS h FROM corpus)
SELECT action, count(*) AS documents FROM (
  SELECT CASE WHEN s.file_path IS NULL THEN 'inserted' WHEN s.h = i.h THEN 'unchanged' ELSE 'updated' END AS action
  FROM incoming i LEFT JOIN stored s USING (file_path)) GROUP BY 1""")
def upsert_actions(spark, sf):
    docs = corpus(spark, sf)
    stored = docs.where(F.col("lang") != "de").select("file_path", F.sha2("content", 256).alias("content_hash"))
    text = F.when(F.col("lang") == "fr", F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    incoming = docs.select("file_path", F.sha2(text, 256).alias("content_hash"))
    return control.count_by(store.upsert_actions(stored, incoming), "action", "action").withColumnRenamed("n", "documents")


@query("allowed_documents", f"""WITH {EVENTS_SQL}, {CORPUS_SQL}
SELECT file_path, length(content) AS chars FROM corpus WHERE file_path IN (
  SELECT file_path FROM history WHERE should_index)""")
def allowed_documents(spark, sf):
    wanted = audit_history(spark, sf).where("should_index").select("file_path")
    return corpus(spark, sf).join(wanted, "file_path", "left_semi").select("file_path", F.length("content").cast("long").alias("chars"))


for _period, _hours in control.PERIOD_HOURS.items():

    @query(f"dash_status_{_period}", f"""WITH {EVENTS_SQL}
SELECT status, count(*) AS n FROM runs, clock WHERE created_at >= now - INTERVAL {_hours} HOUR GROUP BY 1""")
    def dash_status(spark, sf, period=_period):
        rows = control.in_period(agent_runs(spark, sf), "created_at", clock(spark, sf), period)
        return control.count_by(rows, "status", "status")


@query("dash_by_agent", f"""WITH {EVENTS_SQL}
SELECT coalesce(triggered_by, 'unknown') AS agent, count(*) AS n FROM runs GROUP BY 1""")
def dash_by_agent(spark, sf):
    return control.count_by(agent_runs(spark, sf), F.coalesce("triggered_by", F.lit("unknown")), "agent")


@query("dash_latency_p95", f"""WITH {EVENTS_SQL}
SELECT quantile_disc(latency_ms, 0.95) AS p FROM runs WHERE status = 'completed'""")
def dash_latency_p95(spark, sf):
    return control.nearest_rank(agent_runs(spark, sf).where(F.col("status") == "completed"), "latency_ms", 95)


@query("dash_tool_status", f"""WITH {EVENTS_SQL} SELECT status AS label, count(*) AS n FROM tools GROUP BY 1""")
def dash_tool_status(spark, sf):
    return control.count_by(tool_executions(spark, sf), "status")


@query("dash_top_tools", f"""WITH {EVENTS_SQL}
SELECT tool_name AS label, count(*) AS n FROM tools GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def dash_top_tools(spark, sf):
    return control.top_n(tool_executions(spark, sf), "tool_name", 5)


@query("recent_tool_executions", f"""WITH {EVENTS_SQL}
SELECT execution_id, tool_name, status FROM tools ORDER BY executed_at DESC, execution_id DESC LIMIT 50""")
def recent_tool_executions(spark, sf):
    rows = history.page(tool_executions(spark, sf), 50, 0, F.desc("executed_at"), F.desc("execution_id"))
    return rows.select("execution_id", "tool_name", "status")


DASH_SQL = f"""{EVENTS_SQL},
r AS (SELECT runs.* FROM runs, clock WHERE created_at >= now - INTERVAL 168 HOUR),
t AS (SELECT tools.* FROM tools, clock WHERE executed_at >= now - INTERVAL 168 HOUR),
board AS (
  SELECT count(*) AS total_runs, count(*) FILTER (status = 'failed') AS failed_runs,
    CAST(round(avg(latency_ms) FILTER (status = 'completed')) AS BIGINT) AS avg_latency_ms,
    CAST(sum(tokens) FILTER (status = 'completed') AS BIGINT) AS total_tokens,
    count(*) FILTER (guardrail_blocked) AS guardrail_blocks,
    quantile_disc(latency_ms, 0.95) FILTER (status = 'completed') AS p95_latency_ms,
    (SELECT count(*) FROM t) AS total_tool_executions,
    (SELECT count(*) FROM t WHERE status = 'error') AS tool_errors
  FROM r),
eval AS (SELECT round(avg(quality), 6) AS score FROM labels),
metrics AS (
  SELECT unnest(['avg_latency_ms', 'p95_latency_ms', 'guardrail_block_rate', 'error_rate', 'tool_error_rate', 'eval_overall_score']) AS metric,
         unnest([avg_latency_ms, p95_latency_ms, guardrail_blocks / total_runs, failed_runs / total_runs,
                 tool_errors / total_tool_executions, score]) AS value FROM board, eval),
rules AS (SELECT * FROM (VALUES ('avg-latency-warning', 'avg_latency_ms', 'gt', 2000.0), ('p95-latency-critical', 'p95_latency_ms', 'gt', 3000.0),
    ('error-rate-warning', 'error_rate', 'gte', 0.05), ('tool-error-rate', 'tool_error_rate', 'gt', 0.9),
    ('guardrail-rate', 'guardrail_block_rate', 'lte', 0.5), ('eval-score-critical', 'eval_overall_score', 'lt', 0.99)) x(rule_id, metric, operator, threshold)),
fired AS (
  SELECT rule_id, metric, value, threshold,
    CASE WHEN metric = 'eval_overall_score' AND value < 0.3 THEN 'critical'
         WHEN metric = 'p95_latency_ms' AND value > threshold * 1.5 THEN 'critical'
         WHEN metric = 'error_rate' AND value > 0.4 THEN 'critical'
         WHEN value > threshold * 2 THEN 'critical' WHEN value > threshold * 1.2 THEN 'warning' ELSE 'info' END AS severity
  FROM rules JOIN metrics USING (metric)
  WHERE CASE operator WHEN 'gt' THEN value > threshold WHEN 'gte' THEN value >= threshold
                      WHEN 'lt' THEN value < threshold ELSE value <= threshold END)"""
RULES = (
    ("avg-latency-warning", "", "avg_latency_ms", "gt", 2000.0),
    ("p95-latency-critical", "", "p95_latency_ms", "gt", 3000.0),
    ("error-rate-warning", "", "error_rate", "gte", 0.05),
    ("tool-error-rate", "", "tool_error_rate", "gt", 0.9),
    ("guardrail-rate", "", "guardrail_block_rate", "lte", 0.5),
    ("eval-score-critical", "", "eval_overall_score", "lt", 0.99),
)


def week_board(spark, sf):
    now = clock(spark, sf)
    return control.dashboard(
        control.in_period(agent_runs(spark, sf), "created_at", now, "last_7d"),
        control.in_period(tool_executions(spark, sf), "executed_at", now, "last_7d"),
    )


def fired_alerts(spark, sf):
    score = table(spark, sf, "labels").agg(F.round(F.avg("quality"), 6)).scalar()
    return control.alerts(control.metrics(week_board(spark, sf), score), control.rules_table(spark, RULES))


@query("dashboard", f"WITH {DASH_SQL} SELECT * FROM board")
def dashboard(spark, sf):
    return week_board(spark, sf)


@query("alerts", f"WITH {DASH_SQL} SELECT rule_id, metric, round(value, 6) AS value, CAST(threshold AS DOUBLE) AS threshold, severity FROM fired")
def alerts(spark, sf):
    return fired_alerts(spark, sf).withColumn("value", F.round("value", 6)).drop("rule_name")


@query("health", f"""WITH {DASH_SQL}
SELECT CASE WHEN bool_or(severity = 'critical') THEN 'critical' WHEN count(*) > 0 THEN 'degraded' ELSE 'healthy' END AS status FROM fired""")
def health(spark, sf):
    return control.health(fired_alerts(spark, sf))


@query("run_status_rollup", f"""WITH {EVENTS_SQL}, s AS (
  SELECT triggered_by, CASE status WHEN 'failed' THEN 'error' WHEN 'running' THEN 'partial' ELSE 'ok' END AS status FROM runs)
SELECT CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(status = 'partial') THEN 'partial' ELSE 'ok' END AS status FROM s""")
def run_status_rollup(spark, sf):
    status = F.when(F.col("status") == "failed", "error").when(F.col("status") == "running", "partial").otherwise("ok")
    return history.overall_status(agent_runs(spark, sf).select(status.alias("status")))


@query("latency_histogram", f"""WITH {EVENTS_SQL}
SELECT le, count(*) FILTER (CASE WHEN le = '+Inf' THEN TRUE ELSE latency_ms <= TRY_CAST(le AS BIGINT) END) AS observations
FROM runs, (SELECT unnest(['10','50','100','250','500','1000','2000','5000','+Inf']) AS le) GROUP BY 1""")
def latency_histogram(spark, sf):
    return control.latency_histogram(agent_runs(spark, sf), "latency_ms")


@query("operation_timings", f"""WITH {EVENTS_SQL}
SELECT status, count(*) AS n, CAST(sum(latency_ms) AS BIGINT) AS total, round(avg(latency_ms), 6) AS mean,
       min(latency_ms) AS shortest, max(latency_ms) AS longest FROM runs GROUP BY 1""")
def operation_timings(spark, sf):
    return control.duration_summary(agent_runs(spark, sf), "status", "latency_ms").withColumn("mean", F.round("mean", 6))


@query("cache_hit_rate", f"""WITH {EVENTS_SQL}, c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT CAST(sum(n - 1) AS BIGINT) AS hits, CAST(sum(n) AS BIGINT) AS requests, round(100 * sum(n - 1) / sum(n), 2) AS hit_rate FROM c""")
def cache_hit_rate(spark, sf):
    per_key = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return control.hit_rate(per_key.withColumn("h", F.col("n") - 1), "h", "n")


@query("retention_expired", """SELECT event_type, count(*) AS n FROM events
WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1""")
def retention_expired(spark, sf):
    rows = control.expired(table(spark, sf, "events"), "ts", clock(spark, sf), "7 DAYS")
    return control.count_by(rows, "event_type", "event_type")


@query("cache_ttl_fresh", """SELECT user_id, count(*) AS n FROM events
WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY 1""")
def cache_ttl_fresh(spark, sf):
    rows = control.fresh(table(spark, sf, "events"), "ts", clock(spark, sf), "24 HOURS")
    return control.count_by(rows, "user_id", "user_id")


@query("json_extract_agg", """SELECT event_type, count(*) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS largest
FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""")
def json_extract_agg(spark, sf):
    return events(spark, sf).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"), F.max("k").alias("largest")
    )


@query("stream_hourly", """SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS hour, event_type,
  count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def stream_hourly(spark, sf):
    """Batch twin of the rolling hourly stream in streaming.rolling."""
    from foliospark.streaming.rolling import hourly

    return hourly(table(spark, sf, "events")).select(
        F.date_format("hour", "yyyy-MM-dd HH:mm:ss").alias("hour"), "event_type", "n", F.round("total", 4).alias("total")
    )


@query("source_list", "SELECT DISTINCT source FROM documents")
def source_list(spark, sf):
    return table(spark, sf, "documents").select("source").distinct()


@query("source_preview", f"""WITH {CORPUS_SQL}
SELECT file_path, CASE WHEN length(content) > 3000 THEN substring(content, 1, 3000) || '...' ELSE content END AS preview FROM corpus""")
def source_preview(spark, sf):
    from foliospark.functions import text as tx

    return corpus(spark, sf).select("file_path", tx.preview("content", 3000).alias("preview"))


@query("document_point_lookup", f"""WITH {CORPUS_SQL}
SELECT file_path, lang, length(content) AS chars FROM corpus
WHERE file_path = (SELECT max(file_path) FROM corpus)""")
def document_point_lookup(spark, sf):
    docs = corpus(spark, sf)
    wanted = docs.agg(F.max("file_path")).scalar()
    return docs.where(F.col("file_path") == wanted).select("file_path", "lang", F.length("content").cast("long").alias("chars"))


@query("label_quality_agg", """SELECT source, lang, count(*) AS documents, CAST(sum(quality) AS BIGINT) AS good,
  CAST(sum(toxic) AS BIGINT) AS toxic, round(avg(n_chars), 6) AS mean_chars
FROM documents JOIN labels USING (doc_id) GROUP BY ALL""")
def label_quality_agg(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    return (
        docs.join(table(spark, sf, "labels"), "doc_id")
        .groupBy("source", "lang")
        .agg(
            F.count(F.lit(1)).alias("documents"),
            F.sum("quality").alias("good"),
            F.sum("toxic").alias("toxic"),
            F.round(F.avg("n_chars"), 6).alias("mean_chars"),
        )
    )
