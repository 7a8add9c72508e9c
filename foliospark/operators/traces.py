"""Runs, their steps and the steps' tool calls put together again from flat logs.

Each log is grouped by run where it is, so two shuffles by run meet in one tree per run. A
run's steps end at the loop's limit, so a tree is small. Logs may come late or be
incomplete: a step without a run, a call without a step and missing numbers are reported,
nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F


def missing(numbers: Column, first: Column | int = 1) -> Column:
    """Numbers that an ascending array lacks between ``first`` and its largest."""
    start = F.lit(first) if isinstance(first, int) else first
    top = F.array_max(numbers)
    return F.when(top >= start, F.array_except(F.sequence(start, top), numbers)).otherwise(F.array().cast("array<int>"))


def _ordered(fields: Sequence[str]) -> Column:
    return F.array_sort(F.collect_list(F.struct(*fields)))


def step_trees(steps: DataFrame, calls: DataFrame) -> DataFrame:
    """(run_id, step, fields..., calls): steps with their calls by number; a step known only from calls has null fields."""
    fields = [c for c in steps.columns if c not in ("run_id", "step")]
    inner = [c for c in calls.columns if c not in ("run_id", "step", "call")]
    own = steps.select("run_id", "step", F.struct(F.lit(True).alias("logged"), *fields).alias("s"), F.lit(None).alias("c"))
    made = calls.select("run_id", "step", F.lit(None).alias("s"), F.struct("call", *inner).alias("c"))
    # One shuffle for both logs: a step and its calls meet in the same group.
    both = own.unionByName(made).groupBy("run_id", "step").agg(
        F.max("s").alias("s"), F.array_sort(F.collect_list("c")).alias("calls")
    )
    return both.select("run_id", "step", F.coalesce("s.logged", F.lit(False)).alias("logged"), *[f"s.{f}" for f in fields], "calls")


def trees(runs: DataFrame, steps: DataFrame, calls: DataFrame) -> DataFrame:
    """One row per run id of any log: the run's fields, ``steps`` (nested, in order) and what is missing.

    ``runs``: run_id, ...; ``steps``: run_id, step, ...; ``calls``: run_id, step, call, ...
    Numbers start at 1. ``missing_steps`` are numbers without a step row up to the largest one
    seen, ``missing_calls`` counts call numbers that a step lacks; ``started`` is false for runs
    that only other logs know. A step logged twice keeps the row that sorts last; a run logged
    twice the same.
    """
    nested = step_trees(steps, calls)
    columns = [c for c in nested.columns if c != "run_id"]
    grouped = nested.groupBy("run_id").agg(_ordered(columns).alias("steps"))
    rest = [c for c in runs.columns if c != "run_id"]
    once = runs.groupBy("run_id").agg(F.max(F.struct(*rest)).alias("r")).select("run_id", "r.*", F.lit(True).alias("started"))
    out = once.join(grouped, "run_id", "full_outer")
    seen = F.filter("steps", lambda s: s["logged"])
    top = F.array_max(F.transform("steps", lambda s: s["step"]))
    lacks = F.array_except(F.sequence(F.lit(1).cast("int"), top), F.transform(seen, lambda s: s["step"]))
    holes = lambda s: F.size(missing(F.transform(s["calls"], lambda c: c["call"])))
    none = F.array().cast("array<int>")
    return out.select(
        "run_id", *rest, F.coalesce("started", F.lit(False)).alias("started"), "steps",
        F.coalesce(F.when(top >= 1, lacks), none).alias("missing_steps"),
        F.coalesce(F.aggregate("steps", F.lit(0), lambda n, s: n + F.greatest(holes(s), F.lit(0))), F.lit(0)).alias("missing_calls"),
    )


def of_run(runs: DataFrame, steps: DataFrame, calls: DataFrame, run_id) -> DataFrame:
    """The tree of one run; the condition reaches all three scans."""
    mine = lambda df: df.where(F.col("run_id") == run_id)
    return trees(mine(runs), mine(steps), mine(calls))


def of_conversation(runs: DataFrame, steps: DataFrame, calls: DataFrame, conversation, key: str = "conversation_id") -> DataFrame:
    """Trees of a conversation's runs."""
    wanted = runs.where(F.col(key) == conversation)
    mine = lambda df: df.join(wanted.select("run_id").distinct(), "run_id", "left_semi")
    return trees(wanted, mine(steps), mine(calls))
