"""Joins and numbering that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SALTS = 32


def salted_lookup(
    facts: DataFrame, groups: DataFrame, key: str, spread: Column | str, how: str = "inner", salts: int = SALTS
) -> DataFrame:
    """Join many ``facts`` to one ``groups`` row per key, spreading each key over ``salts`` tasks.

    ``groups`` must be unique on ``key``; it is replicated ``salts`` times so that a
    key owning a third of the facts is still read by many tasks. ``spread`` is any
    expression that varies inside a key.
    """
    salt = F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int")
    salted = facts.withColumn("__salt", salt)
    copies = groups.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(copies, [key, "__salt"], how).drop("__salt")


def number_rows(staged: DataFrame, pid: str, order: Sequence[str], out: str = "row_index") -> DataFrame:
    """Zero-based global position of rows already range-partitioned and written with ``pid``.

    Only the per-partition counts (one row per partition) go through a single
    task; the rows themselves are numbered inside their own range partition.
    """
    ahead = Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        staged.groupBy(pid)
        .count()
        .withColumn("__offset", F.coalesce(F.sum("count").over(ahead), F.lit(0)))
        .select(pid, "__offset")
    )
    inside = F.row_number().over(Window.partitionBy(pid).orderBy(*order)) - 1
    return staged.join(offsets, pid).withColumn(out, F.col("__offset") + inside).drop("__offset")
