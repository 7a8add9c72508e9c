"""Connected components of an edge table whose node names may be of any ordered type."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foliospark.staging import stage


def _contract(edges: DataFrame, upward: bool) -> DataFrame:
    """Hang neighbours of each node on the smallest node near it: the larger ones, or the smaller ones."""
    if upward:
        near = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m"))
    if upward:
        least = least.select("u", F.least("u", "m").alias("m"))
        return near.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    moved = near.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node with an edge and the smallest node that it can reach.

    ``edges`` has two columns; loops, repeated and reversed edges are allowed. Stars are
    contracted until nothing changes, in a logarithmic number of rounds, and every round
    is written, so a lost executor costs one round. A node with many neighbours has its
    minimum taken before the shuffle, and its join is split by adaptive execution.
    """
    a, b = edges.columns[:2]
    now = stage(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        mark = F.xxhash64("u", "v")
        sums = now.agg(F.count(F.lit(1)), F.bit_xor(mark), F.sum(mark.cast("decimal(38,0)"))).first()
        if sums == before:
            break
        before = sums
        now = stage(_contract(stage(_contract(now, upward=True), "stars"), upward=False), "edges")
    members = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionAll(members.select("component", "component").distinct().toDF("node", "component"))
