"""Context windows, token budgets and paging over conversation messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_MESSAGES = 40
MAX_TOKENS = 6000
MAX_TOOL_CHARS = 2000
MESSAGE_OVERHEAD = 10
CHARS_PER_TOKEN = 4
MIN_KEPT = 2
TOOL_NOTE = "\n[...output truncado]"
# Fixed value: what the system prompt is told when messages were cut; %d stand for the counts before and after.
CONTEXT_NOTE = (
    "\n\n[Nota: mensagens anteriores foram resumidas para caber no contexto. Originalmente %d mensagens, agora %d.]"
)


def trim_tool_output(role: Column | str, text: Column | str) -> Column:
    r = F.col(role) if isinstance(role, str) else role
    t = F.col(text) if isinstance(text, str) else text
    too_long = (r == "tool") & (F.length(t) > MAX_TOOL_CHARS)
    return F.when(too_long, F.concat(F.substring(t, 1, MAX_TOOL_CHARS), F.lit(TOOL_NOTE))).otherwise(t)


def estimate_tokens(chars: Column) -> Column:
    return F.ceil(chars / CHARS_PER_TOKEN).cast("long")


def last_messages(messages: DataFrame, limit: int = MAX_MESSAGES) -> DataFrame:
    """The newest ``limit`` messages of each conversation, ``age`` 1 being the newest.

    The row-number filter is pruned inside every map task before the shuffle, so
    a conversation with a third of all messages sends at most ``limit`` rows per task.
    """
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return messages.withColumn("age", F.row_number().over(newest)).where(F.col("age") <= limit)


def prepare_context(
    messages: DataFrame, system_chars: int = 0, max_messages: int = MAX_MESSAGES, max_tokens: int = MAX_TOKENS
) -> DataFrame:
    """Messages that fit the context: trim tools, slide the window, drop the oldest over budget.

    At least two messages survive. Each row carries ``chars_from_newest`` and
    ``tokens_from_newest``, sum and estimate for the prompt plus this and all newer messages.
    """
    trimmed = messages.withColumn("text", trim_tool_output("role", "text"))
    window = last_messages(trimmed, max_messages)
    newer = Window.partitionBy("conv_id").orderBy("age").rowsBetween(Window.unboundedPreceding, 0)
    # Calls of tools count with the length of their JSON, where the messages have them.
    calls = F.coalesce(F.length(F.col("tool_calls").cast("string")), F.lit(0)) if "tool_calls" in messages.columns else F.lit(0)
    cost = F.coalesce(F.length("text"), F.lit(0)) + MESSAGE_OVERHEAD + calls
    budgeted = window.withColumn("chars_from_newest", F.sum(cost).over(newer) + system_chars)
    budgeted = budgeted.withColumn("tokens_from_newest", estimate_tokens(F.col("chars_from_newest")))
    return budgeted.where((F.col("tokens_from_newest") <= max_tokens) | (F.col("age") <= MIN_KEPT))


def context_summary(messages: DataFrame, **limits: int) -> DataFrame:
    """Per conversation: messages before and after preparation and the estimated tokens, with the note on what was cut."""
    trimmed = (F.col("role") == "tool") & (F.length("text") > MAX_TOOL_CHARS)
    before = messages.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("original_messages"), F.bool_or(trimmed).alias("__trimmed")
    )
    after = prepare_context(messages, **limits).groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("final_messages"), F.max("chars_from_newest").alias("__chars")
    )
    truncated = F.col("__trimmed") | (F.col("original_messages") > F.col("final_messages"))
    note = F.length(F.format_string(CONTEXT_NOTE, "original_messages", "final_messages"))
    return before.join(after, "conv_id").select(
        "conv_id",
        "original_messages",
        "final_messages",
        estimate_tokens(F.col("__chars") + F.when(truncated, note).otherwise(0)).alias("estimated_tokens"),
        truncated.alias("truncated"),
    )


def paginate(rows: DataFrame, page: int, size: int, *order: Column) -> DataFrame:
    """Page ``page`` (from 1) of at most 100 rows, in a total order."""
    size = max(1, min(size, 100))
    return rows.orderBy(*order).offset((max(page, 1) - 1) * size).limit(size)


def page_info(rows: DataFrame, size: int) -> DataFrame:
    size = max(1, min(size, 100))
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.ceil(F.count(F.lit(1)) / size).cast("long").alias("total_pages")
    )


def merge_facts(old: Column, new: Column, limit: int = 20) -> Column:
    """Unique facts in first-seen order, only the newest ``limit`` of them."""
    from foliospark.functions.text import let

    def newest(facts: Column) -> Column:
        return F.slice(facts, F.greatest(F.size(facts) - limit + 1, F.lit(1)), limit)

    return let(F.array_distinct(F.concat(old, new)), newest)
