"""Operational dashboards, alerts and health over run and tool logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliospark.operators import quantiles

# Reporting periods in hours.
PERIOD_HOURS = {"last_1h": 1, "last_24h": 24, "last_7d": 168, "last_30d": 720}

# Default alert rules (id, name, metric, operator, threshold).
DEFAULT_RULES = (
    ("avg-latency-warning", "Latência média > 10s", "avg_latency_ms", "gt", 10000.0),
    ("p95-latency-critical", "P95 latência > 30s", "p95_latency_ms", "gt", 30000.0),
    ("error-rate-warning", "Taxa de erro > 20%", "error_rate", "gt", 0.20),
    ("eval-score-critical", "Eval score < 0.5", "eval_overall_score", "lt", 0.5),
)
# Latency histogram upper bounds in milliseconds.
LATENCY_BUCKETS = (10, 50, 100, 250, 500, 1000, 2000, 5000)


def in_period(rows: DataFrame, ts: str, now: Column, period: str) -> DataFrame:
    """Rows newer than ``now`` minus the period; ``now`` is always passed in."""
    return rows.where(F.col(ts) >= now - F.expr(f"INTERVAL {PERIOD_HOURS[period]} HOURS"))


def count_by(rows: DataFrame, label: Column | str, name: str = "label") -> DataFrame:
    c = F.col(label) if isinstance(label, str) else label
    return rows.groupBy(c.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def top_n(rows: DataFrame, label: str, limit: int = 5) -> DataFrame:
    return count_by(rows, label).orderBy(F.desc("n"), "label").limit(limit)


def nearest_rank(values: DataFrame, value: str, percent: float) -> DataFrame:
    """The ceil(p/100 * n)-th smallest value, one row; found by ``quantiles``, at any number of distinct values."""
    found = quantiles.nearest_rank(values, value, percent)
    kind = values.select(value).schema[0].dataType.simpleString()
    return values.sparkSession.createDataFrame([(found,)], f"p {kind}")


def dashboard(runs: DataFrame, tools: DataFrame) -> DataFrame:
    """Headline numbers of a period, one row. Both inputs are already cut to the period."""
    completed = F.col("status") == "completed"
    p95 = nearest_rank(runs.where(completed), "latency_ms", 95).scalar()
    tool = tools.agg(
        F.count(F.lit(1)).alias("total_tool_executions"),
        F.count_if(F.col("status") == "error").alias("tool_errors"),
    )
    tool_total = tool.select("total_tool_executions").scalar()
    tool_errors = tool.select("tool_errors").scalar()
    return runs.agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(F.col("status") == "failed").alias("failed_runs"),
        F.round(F.coalesce(F.avg(F.when(completed, F.col("latency_ms"))), F.lit(0.0)), 0).cast("long").alias("avg_latency_ms"),
        F.coalesce(F.sum(F.when(completed, F.col("tokens"))), F.lit(0)).cast("long").alias("total_tokens"),
        F.count_if(F.col("guardrail_blocked")).alias("guardrail_blocks"),
    ).select(
        "*",
        F.coalesce(p95, F.lit(0)).cast("long").alias("p95_latency_ms"),
        tool_total.alias("total_tool_executions"),
        tool_errors.alias("tool_errors"),
    )


def metrics(board: DataFrame, eval_score: Column | None = None) -> DataFrame:
    """Dashboard row as (metric, value); a metric without a value gives no row."""
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    values = {
        "avg_latency_ms": F.col("avg_latency_ms").cast("double"),
        "p95_latency_ms": F.col("p95_latency_ms").cast("double"),
        "guardrail_block_rate": ratio("guardrail_blocks", "total_runs"),
        "error_rate": ratio("failed_runs", "total_runs"),
        "tool_error_rate": ratio("tool_errors", "total_tool_executions"),
        "eval_overall_score": F.lit(None).cast("double") if eval_score is None else eval_score.cast("double"),
    }
    pairs = [F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in values.items()]
    return board.select(F.inline(F.array(*pairs))).where(F.col("value").isNotNull())


def rules_table(spark: SparkSession, rules=DEFAULT_RULES) -> DataFrame:
    return spark.createDataFrame(
        list(rules), "rule_id string, rule_name string, metric string, operator string, threshold double"
    )


def severity(metric: Column, value: Column, threshold: Column) -> Column:
    return (
        F.when((metric == "eval_overall_score") & (value < 0.3), "critical")
        .when((metric == "p95_latency_ms") & (value > threshold * 1.5), "critical")
        .when((metric == "error_rate") & (value > 0.4), "critical")
        .when(value > threshold * 2, "critical")
        .when(value > threshold * 1.2, "warning")
        .otherwise("info")
    )


def violated(operator: Column, value: Column, threshold: Column) -> Column:
    return (
        F.when(operator == "gt", value > threshold)
        .when(operator == "gte", value >= threshold)
        .when(operator == "lt", value < threshold)
        .when(operator == "lte", value <= threshold)
    )


def alerts(metric_rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules whose metric violates its threshold. Rules meet metrics by name (an equi-join)."""
    m, v, t = F.col("metric"), F.col("value"), F.col("threshold")
    return (
        rules.join(metric_rows, "metric")
        .where(violated(F.col("operator"), v, t))
        .select("rule_id", "rule_name", "metric", "value", "threshold", severity(m, v, t).alias("severity"))
    )


def health(active: DataFrame) -> DataFrame:
    return active.agg(
        F.when(F.bool_or(F.col("severity") == "critical"), "critical")
        .when(F.count(F.lit(1)) > 0, "degraded")
        .otherwise("healthy")
        .alias("status")
    )


def latency_histogram(rows: DataFrame, latency: str) -> DataFrame:
    """Cumulative bucket counts in one pass: (le, observations)."""
    bounds = [*LATENCY_BUCKETS, None]
    hit = lambda b: F.lit(True) if b is None else F.col(latency) <= b
    totals = rows.agg(*[F.count_if(hit(b)).alias(f"b{i}") for i, b in enumerate(bounds)])
    pairs = [
        F.struct(F.lit("+Inf" if b is None else str(b)).alias("le"), F.col(f"b{i}").alias("observations"))
        for i, b in enumerate(bounds)
    ]
    return totals.select(F.inline(F.array(*pairs)))


def duration_summary(rows: DataFrame, name: str, duration: str) -> DataFrame:
    return rows.groupBy(name).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(duration).alias("total"),
        F.avg(duration).alias("mean"),
        F.min(duration).alias("shortest"),
        F.max(duration).alias("longest"),
    )


def hit_rate(cache: DataFrame, hits: str, total: str) -> DataFrame:
    rate = F.when(F.sum(total) > 0, F.round(100 * F.sum(hits) / F.sum(total), 2)).otherwise(F.lit(0.0))
    return cache.agg(F.sum(hits).alias("hits"), F.sum(total).alias("requests"), rate.alias("hit_rate"))


def expired(rows: DataFrame, ts: str, now: Column, ttl: str) -> DataFrame:
    """Rows strictly older than the time-to-live."""
    return rows.where(F.col(ts) < now - F.expr(f"INTERVAL {ttl}"))


def fresh(rows: DataFrame, ts: str, now: Column, ttl: str) -> DataFrame:
    return rows.where(F.col(ts) >= now - F.expr(f"INTERVAL {ttl}"))


def latency_ms(started: Column | str, finished: Column | str) -> Column:
    """Whole milliseconds between two timestamps; null while either is missing."""
    c = lambda x: (F.col(x) if isinstance(x, str) else x).cast("timestamp")
    return F.unix_millis(c(finished)) - F.unix_millis(c(started))


def version_greater(new: Column, current: Column) -> Column:
    """major.minor.patch comparison, by number."""
    parts = lambda v: F.transform(F.split(v, r"\."), lambda x: x.try_cast("int"))
    return parts(new) > parts(current)


def changed_fields(previous: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Fields of two definitions with the same key that differ: (key, field, before, after)."""
    fields = [c for c in current.columns if c != key]
    as_text = lambda c: F.to_json(F.struct(F.col(c).alias("v")))
    p = previous.select(key, *[as_text(c).alias(f"p_{c}") for c in fields])
    n = current.select(key, *[as_text(c).alias(f"n_{c}") for c in fields])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("field"), F.col(f"p_{c}").alias("before"), F.col(f"n_{c}").alias("after"))
            for c in fields
        ]
    )
    return p.join(n, key).select(key, F.inline(rows)).where(~F.col("before").eqNullSafe(F.col("after")))


# Minutes that a default rule looks back.
RULE_WINDOWS = {"avg-latency-warning": 60, "p95-latency-critical": 60, "error-rate-warning": 60, "eval-score-critical": 1440}


def windowed_metrics(runs: DataFrame, minutes: int, every: int) -> DataFrame:
    """(tick, metric, value) of the runs of the last ``minutes`` before each tick; ticks come every ``every`` minutes.

    A window holds runs from its start up to, not including, its tick. Latencies are those of
    completed runs. Each run falls into minutes / every windows, whatever the table's size; the
    rank is taken from the distinct latencies of one window. Windows without runs give no row.
    """
    completed = F.col("status") == "completed"
    latency = F.when(completed, F.col("latency_ms"))
    timed = runs.groupBy(F.window("created_at", f"{minutes} minutes", f"{every} minutes").alias("w")).agg(
        F.avg(latency).alias("avg_latency_ms"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY CASE WHEN status = 'completed' THEN latency_ms END)").alias("p95_latency_ms"),
        (F.count_if(F.col("status") == "failed") / F.count(F.lit(1))).alias("error_rate"),
        (F.count_if(F.col("guardrail_blocked")) / F.count(F.lit(1))).alias("guardrail_block_rate"),
    )
    names = ("avg_latency_ms", "p95_latency_ms", "error_rate", "guardrail_block_rate")
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return timed.select(F.col("w.end").alias("tick"), F.inline(pairs)).where(F.col("value").isNotNull())


def message(severity_name: Column, name: Column, value: Column, operator: Column, threshold: Column) -> Column:
    """[SEVERITY] rule: value operator threshold."""
    return F.format_string("[%s] %s: %.2f %s %s", F.upper(severity_name), name, value, operator, threshold.cast("string"))


def active_alerts(runs: DataFrame, rules: DataFrame, every: int = 60) -> DataFrame:
    """Violations of the active rules at every tick, each over its own window, with severity and message.

    ``rules`` also has ``is_active`` and ``window_minutes``; only the distinct window lengths are
    brought to the driver, and the runs are read once for each.
    """
    live = rules.where("is_active")
    lengths = [r[0] for r in live.select("window_minutes").distinct().orderBy("window_minutes").collect()]
    parts = [windowed_metrics(runs, m, every).withColumn("window_minutes", F.lit(m)) for m in lengths]
    if not parts:
        parts = [windowed_metrics(runs.limit(0), every, every).withColumn("window_minutes", F.lit(0))]
    met = reduce(DataFrame.unionByName, parts).join(live, ["metric", "window_minutes"])
    m, v, t, op = F.col("metric"), F.col("value"), F.col("threshold"), F.col("operator")
    level = severity(m, v, t)
    return met.where(violated(op, v, t)).select(
        "rule_id", "tick", "metric", "value", level.alias("severity"), message(level, F.col("rule_name"), v, op, t).alias("message")
    )


def outside_cooldown(fired: DataFrame, minutes: int) -> DataFrame:
    """The alerts of a rule that are sent: the first, then each at least ``minutes`` after the last one sent.

    Which one is sent depends on all before it, so a rule's ticks are walked in order inside
    one row; a tick is eight bytes there, a year of hours 70 KB.
    """
    gap = minutes * 60_000_000
    ticks = F.array_sort(F.collect_set(F.unix_micros(F.col("tick").cast("timestamp"))))
    empty = F.array().cast("array<bigint>")
    start = F.struct(empty.alias("sent"), F.lit(None).cast("bigint").alias("last"))
    step = lambda s, at: F.when(
        s["last"].isNull() | (at - s["last"] >= gap), F.struct(F.array_append(s["sent"], at).alias("sent"), at.alias("last"))
    ).otherwise(s)
    sent = fired.groupBy("rule_id").agg(ticks.alias("t")).select("rule_id", F.explode(F.aggregate("t", start, step)["sent"]).alias("at"))
    timed = fired.withColumn("at", F.unix_micros(F.col("tick").cast("timestamp")))
    return timed.join(sent, ["rule_id", "at"]).drop("at")
