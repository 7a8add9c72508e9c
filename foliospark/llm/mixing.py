"""Mixing sources to target weights by temperature.

The weight of a source is its token share raised to an exponent between 0 (uniform) and
1 (natural), normalised. The exponent is found by nested bisection over the table of
sources: the largest one whose weights reach the target entropy, raised if
necessary until no source is repeated more often than allowed. (Repetition falls and
entropy falls as the exponent rises, so the limit on repetition wins.)

Weights are realised as whole epochs of a source plus part of one more. A source is
dealt into blocks by a hash; every epoch has its own permutation of the blocks, and the
last one stops inside the block that uses up the budget. A document is taken whole;
documents of the last block enter in hash order while they fit the budget.

Blocks number the square root of the source's tokens (over ``UNIT``), so neither the
blocks of a source nor the documents of a block become many at once. Every decision is a
row of the small table of blocks, and a document is placed by looking its block up.

Nulls and odd input: a null source is a source of its own; a null id is the empty
string when hashed; rows with equal ids share their place and enter or stay out
together; a text without words has no tokens and is carried along with the epochs its
block is part of; a source without tokens gets no weight and is left out; with one
source its weight is 1; an empty table gives an empty mixture.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliospark.llm.common import WORD, Scratch, columns_of, free_name

#: Share of the largest possible entropy that the mixture should have, and epochs of a source at most.
ENTROPY = 0.95
REPEATS = 4.0
UNIT = 64
SEED = "mix-1"
#: Exponents tried at once, and rounds: the interval shrinks by GRID + 1 in each.
GRID, ROUNDS = 15, 12


@dataclass(frozen=True)
class Mixture:
    exponent: float
    budget: float
    tokens: int
    sources: int


def n_tokens(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_table(sized: DataFrame) -> DataFrame:
    """(source, tokens) of ``sized`` (source, tokens, ...); sources without tokens are left out."""
    return sized.groupBy("source").agg(F.sum("tokens").alias("tokens")).where("tokens > 0")


def solve(sources: DataFrame, entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None) -> Mixture:
    """The exponent for a table of sources. A budget beyond what the repetition limit allows is reduced to it."""
    tokens, count = sources.agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.count(F.lit(1))).first()
    if not tokens:
        return Mixture(1.0, 0.0, 0, 0)
    budget = min(float(tokens if budget is None else budget), repeats * tokens)
    logs = sources.select(F.log(F.col("tokens") / tokens).alias("x"))

    def measured(exponents: list[float]) -> list[tuple[float, float]]:
        """(entropy, most repetitions) for each exponent, in one pass."""
        sums = []
        for i, a in enumerate(exponents):
            power = F.exp(F.lit(a) * F.col("x"))
            sums += [F.sum(power).alias(f"z{i}"), F.sum(power * a * F.col("x")).alias(f"d{i}"), F.max(power / F.exp("x")).alias(f"m{i}")]
        row = logs.agg(*sums).first()
        return [
            (math.log(row[f"z{i}"]) - row[f"d{i}"] / row[f"z{i}"], row[f"m{i}"] / row[f"z{i}"] * budget / tokens)
            for i in range(len(exponents))
        ]

    goal = entropy * math.log(count) - 1e-12
    limit = repeats + 1e-9
    bounds = {"entropy": [0.0, 1.0], "repeats": [0.0, 1.0]}
    for _ in range(ROUNDS):
        grids = {k: [lo + (hi - lo) * j / (GRID + 1) for j in range(GRID + 2)] for k, (lo, hi) in bounds.items()}
        found = iter(measured([*grids["entropy"], *grids["repeats"]]))
        # The last exponent that reaches the entropy, and the first that keeps the limit.
        reach = [a for a, (h, _) in zip(grids["entropy"], [next(found) for _ in grids["entropy"]], strict=True) if h >= goal]
        low = max(reach, default=0.0)
        bounds["entropy"] = [low, min([a for a in grids["entropy"] if a > low], default=low)]
        over = [a for a, (_, m) in zip(grids["repeats"], [next(found) for _ in grids["repeats"]], strict=True) if m > limit]
        high = min([a for a in grids["repeats"] if a > max(over)], default=1.0) if over else grids["repeats"][0]
        bounds["repeats"] = [max(over, default=high), high]
    return Mixture(round(max(bounds["entropy"][0], bounds["repeats"][1]), 9), budget, int(tokens), int(count))


def allotted(sources: DataFrame, mixture: Mixture) -> DataFrame:
    """(source, tokens, weight, budget, blocks) with budgets in whole tokens."""
    if not mixture.tokens:
        return sources.select("source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).cast("long").alias("budget"), F.lit(1).cast("long").alias("blocks"))
    power = F.exp(F.lit(mixture.exponent) * F.log(F.col("tokens") / mixture.tokens))
    total = sources.agg(F.sum(power)).first()[0]
    return sources.select(
        "source",
        "tokens",
        (power / total).alias("weight"),
        F.floor(power / total * mixture.budget + 0.5).alias("budget"),
        F.ceil(F.sqrt(F.col("tokens") / UNIT)).alias("blocks"),
    )


def _hash(*parts: Column | str) -> Column:
    texts = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws("|", *texts).cast("binary"))


def place_of(key: str) -> Column:
    """The hash that orders documents."""
    return _hash(SEED, F.col(key))


def block_of(place: Column, blocks: Column) -> Column:
    return F.conv(F.substring(place, 1, 8), 16, 10).cast("long") % blocks


def plan_blocks(sized: DataFrame, shares: DataFrame) -> DataFrame:
    """(source, block, epoch, block_order, cut): what each epoch takes of each block.

    ``sized`` has source, tokens and place. ``cut`` is null for a block taken whole; else
    its documents with a place up to ``cut`` are taken.
    """
    same = sized["source"].eqNullSafe(shares["source"])
    dealt = sized.join(shares.select("source", "blocks"), same).select(sized["source"], "tokens", "place", block_of(F.col("place"), F.col("blocks")).alias("block"))
    blocks = dealt.groupBy("source", "block").agg(F.sum("tokens").alias("in_block"))
    # The source is dropped and taken from the shares again, so that null sources find theirs.
    own = shares.select(F.col("source").alias("s"), "tokens", "budget")
    epochs = blocks.join(own, blocks["source"].eqNullSafe(own["s"])).select(
        "source", "block", "in_block", "tokens", "budget",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("budget") / F.col("tokens")).cast("long"))).alias("epoch"),
    )
    order = Window.partitionBy("source", "epoch").orderBy(_hash(SEED, F.col("epoch"), F.col("source"), F.col("block")), "block")
    left = F.col("budget") - F.col("epoch") * F.col("tokens")
    ranked = epochs.select(
        "source", "block", "epoch", "in_block",
        F.row_number().over(order).alias("block_order"),
        (left - F.coalesce(F.sum("in_block").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("room"),
    ).where("room > 0")
    whole = ranked.where("room >= in_block").select("source", "block", "epoch", "block_order", F.lit(None).cast("string").alias("cut"))
    # At most one block of a source is cut.
    part = ranked.where("room < in_block").withColumnRenamed("source", "s").withColumnRenamed("block", "b")
    inside = dealt.join(part, dealt["source"].eqNullSafe(part["s"]) & (dealt["block"] == part["b"]))
    filled = F.sum("tokens").over(
        Window.partitionBy("source", "block").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    cuts = (
        inside.withColumn("filled", filled)
        .where("filled <= room")
        .groupBy("source", "block", "epoch", "block_order")
        .agg(F.max("place").alias("cut"))
    )
    return whole.unionByName(cuts)


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    entropy: float = ENTROPY, repeats: float = REPEATS, budget: float | None = None,
) -> tuple[DataFrame, DataFrame, str]:
    """(mixture, shares, name): every column of ``docs`` once per epoch the document is in, and a struct ``name``
    with source, tokens, epoch, block, block_order. Read by epoch and block order it is the mixture's sequence.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = scratch.put(
        docs.select(F.col(source).cast("string").alias("source"), n_tokens(text).alias("tokens"), place_of(key).alias("place")), "sized"
    )
    sources = scratch.put(source_table(sized), "sources")
    shares = scratch.put(allotted(sources, solve(sources, entropy, repeats, budget)), "shares")
    plan = scratch.put(plan_blocks(sized, shares), "plan")
    scratch.clear(shares, plan)
    name, share, step = (free_name(docs, n) for n in ("mix", "mix_share", "mix_step"))
    place = F.struct(F.col(source).cast("string").alias("source"), place_of(key).alias("place"))
    own = shares.select(F.struct("source", "blocks").alias(share))
    steps = plan.select(F.struct("source", "block", "epoch", "block_order", "cut").alias(step))
    placed = docs.select(*columns_of(docs), place.alias(name))
    rows = placed.join(own, F.col(name)["source"].eqNullSafe(F.col(share)["source"]))
    here = block_of(F.col(name)["place"], F.col(share)["blocks"])
    found = rows.join(
        steps, F.col(name)["source"].eqNullSafe(F.col(step)["source"]) & (here == F.col(step)["block"])
    ).where(F.col(step)["cut"].isNull() | (F.col(name)["place"] <= F.col(step)["cut"]))
    struct = F.struct(
        F.col(name)["source"].alias("source"), n_tokens(text).alias("tokens"),
        *[F.col(step)[c].alias(c) for c in ("epoch", "block", "block_order")],
    )
    return found.select(*columns_of(docs), struct.alias(name)), shares, name
