"""State of keyed rows folded from a log of changes: set, set once, add, append, delete.

A log has one row per change: a key, an order, a mark for deletions, and a column for each
field, null where the change leaves the field alone. ``fold`` turns it into one row per key
with one aggregate (partial sums in the map tasks); ``merge`` adds such rows to a stored
state, so a batch costs the keys that it touches and never the log before it.

An appended list is part of its key's row, so it must fit into one; ``Append(last=n)`` keeps
the newest ``n`` values, of each batch and of the whole.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from foliospark.operators.store import DELETED, KeyedTable

#: Columns of folded rows: the key's last change deletes it; what was stored before is void.
GONE, RESET = "__gone", "__reset"


@dataclass(frozen=True)
class Set:
    """The newest value wins."""

    def fold(self, name: str, order: Column) -> Column:
        return F.max_by(F.col(name), F.when(F.col(name).isNotNull(), order))

    def merge(self, old: Column, new: Column) -> Column:
        return F.coalesce(new, old)


@dataclass(frozen=True)
class SetOnce:
    """The first value stays."""

    def fold(self, name: str, order: Column) -> Column:
        return F.min_by(F.col(name), F.when(F.col(name).isNotNull(), order))

    def merge(self, old: Column, new: Column) -> Column:
        return F.coalesce(old, new)


@dataclass(frozen=True)
class Add:
    """Values add up; a field that was never added to is zero."""

    def fold(self, name: str, order: Column) -> Column:
        return F.coalesce(F.sum(name), F.lit(0))

    def merge(self, old: Column, new: Column) -> Column:
        return F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))


@dataclass(frozen=True)
class Append:
    """Values in order, in an array; ``last`` bounds it."""

    last: int | None = None

    def _cut(self, values: Column) -> Column:
        if self.last is None:
            return values
        return F.slice(values, F.greatest(F.size(values) - self.last + 1, F.lit(1)), self.last)

    def fold(self, name: str, order: Column) -> Column:
        entry = F.when(F.col(name).isNotNull(), F.struct(order.alias("o"), F.col(name).alias("v")))
        return self._cut(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["v"]))

    def merge(self, old: Column, new: Column) -> Column:
        empty = F.array()
        return self._cut(F.concat(F.coalesce(old, empty), F.coalesce(new, empty)))


Rules = Mapping[str, Set | SetOnce | Add | Append]


def fold(log: DataFrame, key: str, order: Column | str, rules: Rules, deleted: Column | str | None = None) -> DataFrame:
    """One row per key of the log: its fields since its last deletion, and whether it is gone.

    ``order`` decides between changes of a key and must be unique within it. A deletion
    voids what came before it; its own fields are not read.
    """
    at = F.col(order) if isinstance(order, str) else order
    rows = log.withColumn("__order", at)
    if deleted is None:
        marked = rows.withColumn("__cut", F.lit(None).cast(rows.schema["__order"].dataType))
    else:
        mark = F.coalesce(F.col(deleted) if isinstance(deleted, str) else deleted, F.lit(False))
        rows = rows.withColumn("__mark", mark)
        cuts = rows.where("__mark").groupBy(F.col(key).alias("__key")).agg(F.max("__order").alias("__cut"))
        marked = rows.join(cuts, F.col(key).eqNullSafe(F.col("__key")), "left")
        # The deletion itself stays, without fields, so that its key has a row.
        marked = marked.where(F.col("__cut").isNull() | (F.col("__order") >= F.col("__cut")))
        live = F.col("__cut").isNull() | (F.col("__order") > F.col("__cut"))
        marked = marked.withColumns({name: F.when(live, F.col(name)) for name in rules})
    folded = [rule.fold(name, F.col("__order")).alias(name) for name, rule in rules.items()]
    gone = F.coalesce(F.max("__order") == F.max("__cut"), F.lit(False)).alias(GONE)
    return marked.groupBy(key).agg(*folded, gone, F.max("__cut").isNotNull().alias(RESET))


def merge(state: DataFrame, folded: DataFrame, key: str, rules: Rules) -> DataFrame:
    """The new rows (with ``__gone``) of the keys in ``folded``, from what ``state`` holds of them."""
    old = state.select(F.col(key).alias("__key"), F.struct(*rules).alias("__old"))
    both = folded.join(old, F.col(key).eqNullSafe(F.col("__key")), "left")
    kept = lambda name: F.when(~F.col(RESET), F.col("__old")[name])
    fields = [rule.merge(kept(name), F.col(name)).alias(name) for name, rule in rules.items()]
    return both.select(key, *fields, GONE)


def apply(table: KeyedTable, log: DataFrame, order: Column | str, rules: Rules, deleted: Column | str | None = None) -> int:
    """Fold a batch of changes into a stored table, as one version. Batches come in order."""
    rows = merge(table.read(), fold(log, table.key, order, rules, deleted), table.key, rules)
    return table.apply(rows.withColumnRenamed(GONE, DELETED))
