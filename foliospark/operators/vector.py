"""Exact nearest neighbours by cosine similarity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from foliospark.staging import stage

CANDIDATE_FACTOR = 10
#: Cells of a batch search and the vectors of a block in one.
CELLS, BLOCK = 64, 4096


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def unit_score(similarity: Column) -> Column:
    """Cosine mapped to [0, 1]."""
    return (similarity + 1.0) / 2.0


def nearest(
    vectors: DataFrame, target: Column, limit: int, key: str = "vec_id", embedding: str = "embedding", active: Column | None = None
) -> DataFrame:
    """Top ``limit`` rows by cosine to one target vector: a scan and a distributed top-k, no shuffle.

    ``active`` keeps only live rows and is applied before any similarity is computed.
    ``target`` may be a literal array or a scalar sub-query; it is made a column
    first because array functions accept no sub-query inside.
    """
    rows = vectors if active is None else vectors.where(active)
    scored = rows.withColumn("__target", target).select(
        key, F.round(cosine(F.col(embedding), F.col("__target")), 6).alias("similarity")
    )
    return scored.orderBy(F.desc("similarity"), key).limit(limit)


def centroid(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Component-wise mean as a single row ``centroid`` (one entry per dimension)."""
    means = (
        vectors.select(F.posexplode(embedding).alias("dim", "x"))
        .groupBy("dim")
        .agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("dim", "m")))
    return means.agg(F.transform(ordered, lambda d: d["m"]).alias("centroid"))


def _units(column: pa.Array) -> np.ndarray:
    """Rows of unit length; a vector of length zero stays zero."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(lists):
        return np.zeros((0, 1))
    rows = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _angles(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ pivots.T, -1.0, 1.0))


def _assign(pivots: np.ndarray):
    """(id, embedding) -> (id, cell, angle, unit); vectors of length zero are a cell of their own, the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _units(batch.column(1))
            if not len(unit):
                continue
            angles = _angles(unit, pivots)
            cell = angles.argmin(axis=1)
            zero = ~unit.any(axis=1)
            cell[zero] = len(pivots)
            offsets = np.arange(len(unit) + 1) * unit.shape[1]
            units = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(unit.reshape(-1)))
            angle = np.where(zero, 0.0, angles.min(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int32()), pa.array(angle), units], ["id", "cell", "angle", "unit"])

    return run


def _reachable(pivots: np.ndarray, radius: np.ndarray):
    """(id, cell, least, unit) -> (id, unit, cell) of the other cells that may hold a vector as near as ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = _units(batch.column(3))
            if not len(unit):
                continue
            bound = np.cos(np.maximum(_angles(unit, pivots) - radius[None, :-1], 0.0))
            bound = np.concatenate([bound, np.zeros((len(unit), 1))], axis=1)
            bound[~unit.any(axis=1)] = 1.0
            least = batch.column(2).to_numpy(zero_copy_only=False)
            near = (bound >= least[:, None] - 1e-5) & (radius >= 0)[None, :]
            near[np.arange(len(unit)), batch.column(1).to_numpy()] = False
            row, cell = np.nonzero(near)
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(3).take(row), pa.array(cell, pa.int32())], ["id", "unit", "cell"])

    return run


def _compare(limit: int):
    """Rows (cell, block, query, id, unit) sorted by cell and block -> the best of each query in the block."""

    def best(rows: pa.Table) -> pa.RecordBatch | None:
        asks = rows["query"].to_numpy(zero_copy_only=False).astype(bool)
        asked, there = rows.filter(pa.array(asks)), rows.filter(pa.array(~asks))
        if not len(asked) or not len(there):
            return None
        ids, keys = np.array(there["id"].to_pylist()), np.array(asked["id"].to_pylist())
        order = np.argsort(ids, kind="stable")
        ids, units = ids[order], _units(there["unit"])[order]
        found = []
        for start in range(0, len(keys), 512):
            part = keys[start : start + 512]
            score = np.round(_units(asked["unit"].slice(start, 512)) @ units.T, 6) + 0.0
            score[part[:, None] == ids[None, :]] = -np.inf
            top = np.argsort(-score, axis=1, kind="stable")[:, :limit]  # ties keep the order of ids
            q = np.repeat(np.arange(len(part)), top.shape[1])
            value = score[q, top.reshape(-1)]
            kept = np.isfinite(value)
            found.append((part[q[kept]], ids[top.reshape(-1)[kept]], value[kept]))
        q, v, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(score)], ["query_id", "id", "similarity"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            names = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            start = 0
            for i, name in enumerate(names):
                if name != last:
                    held.append(batch.slice(start, i - start))
                    if (made := best(pa.Table.from_batches(held))) is not None:
                        yield made
                    held, start, last = [], i, name
            held.append(batch.slice(start))
        if held and (made := best(pa.Table.from_batches(held))) is not None:
            yield made

    return run


def nearest_batch(
    vectors: DataFrame, queries: DataFrame, limit: int, key: str = "vec_id", embedding: str = "embedding", cells: int = CELLS, block: int = BLOCK
) -> DataFrame:
    """(query_id, ``key``, similarity, rank, cells_read): the exact ``limit`` best other rows for every query.

    At most ``cells`` vectors, chosen by hash, divide the rows into cells by the smallest
    angle. A query is compared with its own cell; the similarity of its ``limit``-th row there
    then rules out every cell whose pivot is further away, less the cell's radius, than that.
    Cells are cut into blocks by hash and compared block by block, so no task holds a cell.
    Ids are integers; ties go to the smaller one.
    """
    chosen = vectors.orderBy(F.xxhash64(key), key).select(embedding).limit(cells).collect()
    pivots = _units(pa.array([r[0] for r in chosen], pa.list_(pa.float64())))
    pivots = pivots[pivots.any(axis=1)]
    width = pivots.shape[1] if len(pivots) else 1
    pivots = pivots if len(pivots) else np.eye(1, width)
    kind = vectors.schema[key].dataType.simpleString()
    placed = f"id {kind}, cell int, angle double, unit array<double>"
    rows = stage(vectors.select(key, embedding).mapInArrow(_assign(pivots), placed), "vector-cells")
    asked = stage(queries.select(key, embedding).mapInArrow(_assign(pivots), placed), "vector-queries")
    sizes = rows.groupBy("cell").agg(F.max("angle").alias("radius"), F.count(F.lit(1)).alias("n")).collect()  # a row per cell
    radius, blocks = np.full(len(pivots) + 1, -1.0), {r["cell"]: -(-r["n"] // block) for r in sizes}
    for r in sizes:
        radius[r["cell"]] = r["radius"]
    if not sizes:
        return asked.select(F.col("id").alias("query_id"), F.col("id").alias(key), F.lit(0.0).alias("similarity"), F.lit(1).cast("bigint").alias("rank"), F.lit(0).cast("bigint").alias("cells_read")).limit(0)
    counts = F.create_map(*[F.lit(x) for c, n in blocks.items() for x in (c, n)])
    parts = F.coalesce(F.try_element_at(counts, F.col("cell")), F.lit(0))
    dealt_rows = rows.select("cell", F.pmod(F.xxhash64("id"), parts).cast("int").alias("block"), F.lit(False).alias("query"), "id", "unit")

    def compared(wanted: DataFrame) -> DataFrame:
        copies = wanted.where(parts > 0).select("cell", F.explode(F.sequence(F.lit(0), parts - 1)).alias("block"), F.lit(True).alias("query"), "id", "unit")
        cells_of = copies.select("cell", "block").distinct()
        met = dealt_rows.join(F.broadcast(cells_of) if sum(blocks.values()) < 1 << 16 else cells_of, ["cell", "block"], "left_semi")
        dealt = met.select("cell", "block", "query", "id", "unit").unionByName(copies).repartition("cell", "block").sortWithinPartitions("cell", "block")
        return dealt.mapInArrow(_compare(limit), f"query_id {kind}, id {kind}, similarity double")

    order = lambda df: _top_rows(df, limit)
    own = stage(order(compared(asked.select("id", "unit", "cell"))), "vector-own")
    least = own.where(F.col("rank") == limit).select(F.col("query_id").alias("id"), F.col("similarity").alias("least"))
    open_ = asked.join(least, "id", "left").select("id", "cell", F.coalesce("least", F.lit(-2.0)).alias("least"), "unit")
    further = stage(open_.mapInArrow(_reachable(pivots, radius), f"id {kind}, unit array<double>, cell int"), "vector-further")
    read = further.groupBy(F.col("id").alias("query_id")).agg(F.count(F.lit(1)).alias("more"))
    everything = order(own.drop("rank").unionByName(compared(further)))
    out = everything.join(read, "query_id", "left").withColumn("cells_read", F.coalesce("more", F.lit(0)) + 1)
    return out.select("query_id", F.col("id").alias(key), "similarity", "rank", "cells_read")


def _top_rows(scored: DataFrame, limit: int) -> DataFrame:
    window = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    ranked = scored.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= limit)
    return ranked.withColumn("rank", F.col("rank").cast("bigint"))
