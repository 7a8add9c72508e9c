"""Exact order statistics of a column of any size, by narrowing the range that holds them.

Sketches of bounded size are merged from all tasks and give two values around the wanted
rank; one count tells which side of them the rank lies on. Only rows strictly between the
two go on, so a value that fills half of the table is settled at once. A round leaves about
a thousandth of the rows (the sketch's rank error is proven), and no task or driver ever
holds more than ``HELD`` values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliospark.staging import stage

#: Rank error of a sketch is one part in this many; values that are sorted directly.
ACCURACY, HELD = 10_000, 100_000


def _ranked(rows: DataFrame, rank: int, total: int, held: int, accuracy: int):
    """The ``rank``-th smallest (from 0) of ``total`` values ``v``."""
    v, margin = F.col("v"), 2.0 / accuracy
    while total > held:
        at = (rank + 0.5) / total
        ends = [max(0.0, at - margin), min(1.0, at + margin)]
        low, high = rows.agg(F.percentile_approx("v", ends, accuracy)).first()[0]
        # In ascending order; the first and the last part are only reached if a sketch breaks its bound.
        parts = [
            (v < low, None), (v == low, low), ((v > low) & (v < high), None), ((v == high) & (v > low), high), (v > high, None),
        ]
        counts = rows.agg(*[F.count_if(part) for part, _ in parts]).first()
        for (part, settled), count in zip(parts, counts, strict=True):
            if rank < count:
                break
            rank -= count
        if settled is not None:
            return settled
        rows, total = rows.where(part), count
    return rows.orderBy("v").offset(rank).first()[0]


def order_statistics(values: DataFrame, value: Column | str, ranks, held: int = HELD, accuracy: int = ACCURACY) -> list:
    """Values at some ranks; ``ranks(n)`` gives them (from 0) for ``n`` values. Nulls are left out; nothing for no value.

    ``value`` must order totally (numbers, dates); NaN counts as the largest.
    """
    given = F.col(value) if isinstance(value, str) else value
    rows = stage(values.select(given.alias("v")).where(F.col("v").isNotNull()), "quantile-values")
    total = rows.count()
    return [_ranked(rows, rank, total, held, accuracy) for rank in ranks(total)] if total else []


def nearest_rank(values: DataFrame, value: Column | str, percent: float, **limits):
    """The ceil(p / 100 * n)-th smallest value, None without values."""
    # Whole arithmetic for the ceiling: p is taken to six decimals.
    share = round(percent * 1_000_000)
    found = order_statistics(values, value, lambda n: [max(0, -(-share * n // 100_000_000) - 1)], **limits)
    return found[0] if found else None


def median(values: DataFrame, value: Column | str, **limits) -> float | None:
    """The middle value, or the mean of the two in the middle."""
    found = order_statistics(values, value, lambda n: sorted({(n - 1) // 2, n // 2}), **limits)
    return float(found[0] + found[-1]) / 2 if found else None
