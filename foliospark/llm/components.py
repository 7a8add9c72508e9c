"""Connected components of an edge table by alternating star contractions.

Each round points the larger neighbours of every node at its smallest neighbour, then
the smaller ones at the smallest; the graph becomes a set of stars in a logarithmic
number of rounds. Edges are pairs of 64-bit numbers; nothing but two summary numbers
per round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliospark.llm.common import Scratch


def _smallest(pairs: DataFrame) -> DataFrame:
    """For each node its smallest neighbour or itself; minima are taken before the shuffle."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.join(_smallest(both), "u")
    return near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(low, "u")
    lowered = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lowered.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): every node that has an edge, with the smallest node it can reach.

    ``edges`` has two 64-bit columns; loops and repeated edges are allowed.
    """
    u, v = edges.columns[:2]
    now = scratch.put(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        sums = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == before:
            break
        before = sums
        large = scratch.put(_large_star(now), "large")
        scratch.drop(now)
        now = scratch.put(_small_star(large), "small")
        scratch.drop(large)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(stars.select("component", "component").distinct().toDF("node", "component"))
