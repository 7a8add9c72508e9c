"""Exact batch nearest neighbours against brute force."""

import numpy as np
import pytest

from foliospark.operators import vector

SCHEMA = "vec_id bigint, embedding array<float>"


def plain(vectors, queries, limit):
    unit = {k: np.array(v) / (np.linalg.norm(v) or 1.0) for k, v in vectors.items()}
    out = set()
    for q in queries:
        scored = sorted((-round(float(unit[q] @ u), 6) + 0.0, k) for k, u in unit.items() if k != q)[:limit]
        out |= {(q, k, -s + 0.0, r) for r, (s, k) in enumerate(scored, 1)}
    return out


@pytest.mark.parametrize(("cells", "block"), [(64, 4096), (8, 16), (1, 5)])
def test_batch_matches_brute_force(spark, cells, block):
    rng = np.random.default_rng(cells)
    centres = rng.normal(size=(8, 12)) * 5
    vectors = {k: (centres[k % 8] + rng.normal(size=12) * 0.3).astype(np.float32).astype(float).tolist() for k in range(300)}
    vectors |= {300 + k: vectors[k] for k in range(20)}  # ties
    vectors |= {400 + k: [0.0] * 12 for k in range(3)}
    rows = spark.createDataFrame(list(vectors.items()), SCHEMA).repartition(4)
    asked = [k for k in vectors if k % 25 == 0]
    got = vector.nearest_batch(rows, rows.where("vec_id % 25 = 0"), 6, cells=cells, block=block).collect()
    assert {(r.query_id, r.vec_id, round(r.similarity, 6) + 0.0, r["rank"]) for r in got} == plain(vectors, asked, 6)
    if cells == 8:
        read = [r.cells_read for r in got if r.query_id < 400 and r["rank"] == 1]
        assert sum(read) / len(read) < 7  # cells that the bounds rule out are not read


def test_batch_over_few_or_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vector.nearest_batch(empty, empty, 3).count() == 0
    two = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], SCHEMA)
    assert {(r.query_id, r.vec_id, r.similarity) for r in vector.nearest_batch(two, two, 3).collect()} == {(1, 2, 0.0), (2, 1, 0.0)}
    assert vector.nearest_batch(two, two.limit(0), 3).count() == 0
