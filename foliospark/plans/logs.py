"""Run logs, rules and soft deletion as change logs; trace trees. All from ``events``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from foliospark.operators import changelog as cl, control, store, traces
from foliospark.plans.operations import EVENTS_SQL, agent_runs, events
from foliospark.plans.registry import query
from foliospark.staging import checkpoint_root, stage

K_SQL = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


def _replayed(spark, log: DataFrame, key: str, rules: cl.Rules, deleted: str | None = None) -> DataFrame:
    """Two batches of a log (earlier and later ids) through a stored table."""
    fields = cl.fold(log.limit(0), key, "event_id", rules, deleted).select(key, *rules).schema
    table = store.KeyedTable(spark, f"{checkpoint_root(spark)}/foliospark/log-{uuid.uuid4().hex}", key, StructType(fields.fields))
    middle = log.agg(F.avg("event_id")).first()[0] or 0
    for batch in (log.where(F.col("event_id") < middle), log.where(F.col("event_id") >= middle)):
        cl.apply(table, batch, "event_id", rules, deleted)
    return table.read()


@query("run_finalize", f"""WITH {K_SQL}, l AS (
  SELECT *, event_id // 7 AS run_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE CASE WHEN event_id % 7 = 0 THEN 'running' END END AS status
  FROM ev)
SELECT run_id, arg_min(user_id, event_id) AS conversation, arg_max(status, event_id) FILTER (status IS NOT NULL) AS status, sum(k)::BIGINT AS tokens, count(*) AS steps,
  epoch_us(arg_max(ts, event_id) FILTER (event_type IN ('error', 'purchase'))) // 1000 - epoch_us(arg_min(ts, event_id)) // 1000 AS latency_ms,
  array_to_string(list_reverse((list_reverse(list(event_type ORDER BY event_id)))[1:3]), ',') AS last_steps
FROM l GROUP BY run_id""")
def run_finalize(spark, sf):
    """Runs are started, take steps and finish in a later batch: set, set once, add and append."""
    kind, place = F.col("event_type"), F.col("event_id") % 7
    ended = F.when(kind == "error", "failed").when(kind == "purchase", "completed")
    log = events(spark, sf).select(
        "event_id", F.floor(F.col("event_id") / 7).alias("run_id"), F.col("user_id").alias("conversation"), F.col("ts").alias("started"),
        F.when(ended.isNotNull(), F.col("ts")).alias("finished"), F.coalesce(ended, F.when(place == 0, "running")).alias("status"),
        F.col("k").alias("tokens"), F.lit(1).cast("long").alias("steps"), kind.alias("last_steps"),
    )
    rules = {
        "conversation": cl.SetOnce(), "started": cl.SetOnce(), "finished": cl.Set(), "status": cl.Set(),
        "tokens": cl.Add(), "steps": cl.Add(), "last_steps": cl.Append(last=3),
    }
    return _replayed(spark, log, "run_id", rules).select(
        "run_id", "conversation", "status", "tokens", "steps", control.latency_ms("started", "finished").alias("latency_ms"),
        F.array_join("last_steps", ",").alias("last_steps"),
    )


@query("rule_upsert", f"""WITH {K_SQL}, l AS (SELECT *, 'rule' || user_id % 40 AS rule_id, CASE event_type WHEN 'signup' THEN false WHEN 'error' THEN NULL ELSE true END AS active FROM ev),
r AS (SELECT rule_id, arg_max(event_type, event_id) AS metric, arg_max(value, event_id) AS threshold, arg_min(event_id, event_id) AS created, count(*) AS revision,
  arg_max(active, event_id) FILTER (active IS NOT NULL) AS active FROM l GROUP BY rule_id)
SELECT rule_id, metric, threshold, created, revision FROM r WHERE active""")
def rule_upsert(spark, sf):
    """Alert rules upserted and deactivated; the active ones are listed."""
    kind = F.col("event_type")
    log = events(spark, sf).select(
        "event_id", F.concat(F.lit("rule"), F.col("user_id") % 40).alias("rule_id"), kind.alias("metric"), F.col("value").alias("threshold"),
        F.col("event_id").alias("created"), F.lit(1).cast("long").alias("revision"),
        F.when(kind == "signup", False).when(kind != "error", True).alias("active"),
    )
    rules = {"metric": cl.Set(), "threshold": cl.Set(), "created": cl.SetOnce(), "revision": cl.Add(), "active": cl.Set()}
    return _replayed(spark, log, "rule_id", rules).where("active").drop("active")


@query("soft_delete", f"""WITH {K_SQL}, l AS (SELECT *, event_type = 'error' AND k < 30 AS deleted,
    CASE event_type WHEN 'signup' THEN false WHEN 'view' THEN true END AS active FROM ev),
c AS (SELECT user_id, max(event_id) FILTER (deleted) AS cut FROM l GROUP BY user_id)
SELECT user_id, sum(k)::BIGINT AS total, min(event_id) AS first, arg_max(active, event_id) FILTER (active IS NOT NULL) AS active
FROM l JOIN c USING (user_id) WHERE event_id > coalesce(cut, -1) GROUP BY user_id""")
def soft_delete(spark, sf):
    """Keys are switched off (the row stays) or deleted (what follows starts anew)."""
    kind = F.col("event_type")
    log = events(spark, sf).select(
        "event_id", "user_id", F.col("k").alias("total"), F.col("event_id").alias("first"),
        F.when(kind == "signup", False).when(kind == "view", True).alias("active"), ((kind == "error") & (F.col("k") < 30)).alias("deleted"),
    )
    rules = {"total": cl.Add(), "first": cl.SetOnce(), "active": cl.Set()}
    return _replayed(spark, log, "user_id", rules, "deleted")


@query("trace_tree", f"""WITH {K_SQL}, e AS (SELECT *, event_id // 12 AS run_id, event_id % 12 // 3 + 1 AS step, event_id % 3 AS call FROM ev),
r AS (SELECT run_id, user_id AS conversation FROM e WHERE event_id % 12 = 0 AND k % 7 <> 0),
s AS (SELECT run_id, step, event_type AS kind FROM e WHERE call = 0 AND k % 5 <> 0),
c AS (SELECT run_id, step, list('tool' || k % 12 ORDER BY call) AS tools, max(call) - count(*) AS holes FROM e WHERE call > 0 AND k % 4 <> 1 GROUP BY ALL),
n AS (SELECT run_id, step, kind, coalesce(tools, []) AS tools, coalesce(holes, 0) AS holes, kind IS NOT NULL AS logged FROM s FULL JOIN c USING (run_id, step)),
g AS (SELECT run_id, string_agg(step || ':' || coalesce(kind, '?') || '(' || array_to_string(tools, ',') || ')', '|' ORDER BY step) AS tree,
  sum(holes)::BIGINT AS missing_calls, max(step) AS top, list(step) FILTER (logged) AS seen FROM n GROUP BY run_id)
SELECT run_id, conversation, r.run_id IS NOT NULL AS started, coalesce(tree, '') AS tree, coalesce(missing_calls, 0) AS missing_calls,
  coalesce(array_to_string(list_filter(range(1, top + 1), lambda x: NOT list_contains(coalesce(seen, []), x)), ','), '') AS missing_steps
FROM r FULL JOIN g USING (run_id)""")
def trace_tree(spark, sf):
    """Run, steps and tool calls from three flat logs with lost rows."""
    e = events(spark, sf).withColumns({
        "run_id": F.floor(F.col("event_id") / 12), "step": (F.floor(F.col("event_id") % 12 / 3) + 1).cast("int"), "call": (F.col("event_id") % 3).cast("int"),
    })
    runs = e.where("event_id % 12 = 0 AND k % 7 <> 0").select("run_id", F.col("user_id").alias("conversation"))
    steps = e.where("call = 0 AND k % 5 <> 0").select("run_id", "step", F.col("event_type").alias("kind"))
    calls = e.where("call > 0 AND k % 4 <> 1").select("run_id", "step", "call", F.concat(F.lit("tool"), F.col("k") % 12).alias("tool"))
    tools = lambda s: F.array_join(F.transform(s["calls"], lambda c: c["tool"]), ",")
    line = lambda s: F.concat(s["step"], F.lit(":"), F.coalesce(s["kind"], F.lit("?")), F.lit("("), tools(s), F.lit(")"))
    return traces.trees(runs, steps, calls).select(
        "run_id", "conversation", "started", F.coalesce(F.array_join(F.transform("steps", line), "|"), F.lit("")).alias("tree"),
        F.col("missing_calls").cast("long").alias("missing_calls"), F.array_join("missing_steps", ",").alias("missing_steps"),
    )


# rule, name, metric, operator, threshold, window in minutes, active: the second is switched off, the fourth looks back further.
ACTIVE_RULES = (
    ("latency", "Latência média", "avg_latency_ms", "gt", 3000.0, 120, True),
    ("quiet", "Erros", "error_rate", "gt", 0.0, 120, False),
    ("errors", "Taxa de erro", "error_rate", "gte", 0.25, 120, True),
    ("slow", "P95 latência", "p95_latency_ms", "gt", 9000.0, 360, True),
    ("blocks", "Bloqueios", "guardrail_block_rate", "lt", 0.05, 360, True),
)
RULES_SQL = ", ".join(str(r).replace("True", "true").replace("False", "false") for r in ACTIVE_RULES)


@query("alerts_active", f"""WITH RECURSIVE {EVENTS_SQL}, rules(rule_id, rule_name, metric, operator, threshold, minutes, is_active) AS (VALUES {RULES_SQL}),
slots AS (SELECT DISTINCT minutes FROM rules WHERE is_active),
spread AS (
  SELECT minutes, status, latency_ms, guardrail_blocked, unnest(range(1, minutes // 60 + 1)) AS h, created_at FROM runs, slots),
placed AS (SELECT *, date_trunc('hour', created_at) + h * INTERVAL 1 HOUR AS tick FROM spread),
m AS (SELECT minutes, tick, avg(latency_ms) FILTER (status = 'completed') AS avg_latency_ms,
  CAST(quantile_disc(latency_ms, 0.95) FILTER (status = 'completed') AS DOUBLE) AS p95_latency_ms,
  count(*) FILTER (status = 'failed') / count(*) AS error_rate, count(*) FILTER (guardrail_blocked) / count(*) AS guardrail_block_rate
  FROM placed GROUP BY ALL),
u AS (UNPIVOT m ON avg_latency_ms, p95_latency_ms, error_rate, guardrail_block_rate INTO NAME metric VALUE value),
f AS (SELECT rule_id, tick, metric, value, threshold, operator, rule_name,
  CASE WHEN metric = 'p95_latency_ms' AND value > threshold * 1.5 THEN 'critical' WHEN metric = 'error_rate' AND value > 0.4 THEN 'critical'
    WHEN value > threshold * 2 THEN 'critical' WHEN value > threshold * 1.2 THEN 'warning' ELSE 'info' END AS severity
  FROM u JOIN rules USING (metric, minutes) WHERE is_active
    AND CASE operator WHEN 'gt' THEN value > threshold WHEN 'gte' THEN value >= threshold ELSE value < threshold END),
sent AS (SELECT rule_id, min(tick) AS tick FROM f GROUP BY rule_id
  UNION ALL SELECT s.rule_id, (SELECT min(f.tick) FROM f WHERE f.rule_id = s.rule_id AND f.tick >= s.tick + INTERVAL 3 HOUR) AS tick FROM sent s WHERE s.tick IS NOT NULL)
SELECT rule_id, epoch(tick)::BIGINT AS at, round(value, 6) AS value, severity,
  '[' || upper(severity) || '] ' || rule_name || ': ' || printf('%.2f', round(value, 2)) || ' ' || operator || ' ' || CAST(CAST(threshold AS DOUBLE) AS VARCHAR) AS message
FROM f JOIN sent USING (rule_id, tick)""")
def alerts_active(spark, sf):
    """Active rules over their own windows at every full hour, at most one alert in three hours for each rule."""
    rules = spark.createDataFrame(
        list(ACTIVE_RULES),
        "rule_id string, rule_name string, metric string, operator string, threshold double, window_minutes int, is_active boolean",
    )
    fired = stage(control.active_alerts(agent_runs(spark, sf), rules), "fired")
    return control.outside_cooldown(fired, 180).select(
        "rule_id", F.unix_seconds(F.col("tick").cast("timestamp")).alias("at"), F.round("value", 6).alias("value"), "severity", "message"
    )
