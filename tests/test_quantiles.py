"""Exact order statistics against sorting, with limits small enough for many rounds."""

import random

import pytest

from foliospark.operators import quantiles


@pytest.mark.parametrize("shape", ["spread", "ties", "two", "skewed"])
def test_every_rank_agrees_with_sorting(spark, shape):
    rng = random.Random(shape)
    make = {
        "spread": lambda: rng.uniform(-1e9, 1e9), "ties": lambda: float(rng.choice([7, 7, 7, rng.randint(0, 40)])),
        "two": lambda: rng.choice([1.0, 2.0]), "skewed": lambda: 10.0 ** rng.uniform(-300, 300),
    }[shape]
    values = [make() for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(4)
    ordered = sorted(values)
    ranks = [0, 1, 1499, 1500, 2850, 2999]
    assert quantiles.order_statistics(df, "v", lambda n: ranks, held=20, accuracy=50) == [ordered[r] for r in ranks]
    assert quantiles.median(df, "v", held=20, accuracy=50) == (ordered[1499] + ordered[1500]) / 2


def test_odd_input(spark):
    df = spark.createDataFrame([(None,), (5,), (1,), (9,)], "v int")
    assert (quantiles.median(df, "v"), quantiles.nearest_rank(df, "v", 95), quantiles.nearest_rank(df, "v", 0)) == (5.0, 9, 1)
    assert quantiles.median(df.where("v IS NULL"), "v") is None and quantiles.nearest_rank(df.limit(0), "v", 50) is None
