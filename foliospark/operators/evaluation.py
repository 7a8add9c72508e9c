"""Retrieval quality: reciprocal rank, precision, NDCG, aggregates and regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

AGGREGATES = ("mrr", "mean_precision_at_k", "mean_ndcg_at_k", "top1_accuracy")
REGRESSION_DROP = 0.05


def is_expected(path: Column, patterns: Column) -> Column:
    """Does the path contain any expected pattern (case-insensitive, either slash)?"""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.exists(patterns, lambda p: F.contains(low, F.lower(p)))


def query_metrics(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """Per query: reciprocal rank, precision@k, NDCG@k over the retrieved list, top hit.

    ``ranked`` holds the top k of each query (query_id, file_path, rank);
    ``expected`` holds (query_id, expected_files). The ideal order only reorders
    what was retrieved: its DCG is the sum of the first ``hits`` discounts.
    """
    judged = ranked.join(expected, "query_id").withColumn(
        "rel", is_expected(F.col("file_path"), F.col("expected_files")).cast("int")
    )
    gain = F.col("rel") / F.log2(F.col("rank") + 1)
    per = judged.groupBy("query_id").agg(
        F.min(F.when(F.col("rel") == 1, F.col("rank"))).alias("first"),
        F.sum("rel").alias("hits"),
        F.count(F.lit(1)).alias("n"),
        F.sum(gain).alias("dcg"),
        F.max(F.when(F.col("rank") == 1, F.col("rel"))).alias("top"),
    )
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.col("hits"), F.lit(1)).cast("int")),
        F.lit(0.0),
        lambda acc, i: acc + 1.0 / F.log2(i + 1),
    )
    scored = expected.select("query_id").join(per, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return scored.select(
        "query_id",
        F.round(zero(1.0 / F.col("first")), 4).alias("reciprocal_rank"),
        F.round(zero(F.col("hits") / F.col("n")), 4).alias("precision_at_k"),
        F.round(zero(F.when(F.col("hits") > 0, F.col("dcg") / ideal)), 4).alias("ndcg_at_k"),
        (F.coalesce("top", F.lit(0)) == 1).alias("top_hit_correct"),
    )


def aggregate_metrics(per_query: DataFrame) -> DataFrame:
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4)
    return per_query.agg(
        F.count(F.lit(1)).alias("total_queries"),
        mean("reciprocal_rank").alias("mrr"),
        mean("precision_at_k").alias("mean_precision_at_k"),
        mean("ndcg_at_k").alias("mean_ndcg_at_k"),
        mean(F.col("top_hit_correct").cast("int")).alias("top1_accuracy"),
    )


def _long(report: DataFrame) -> DataFrame:
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in AGGREGATES]
    return report.select(F.inline(F.array(*pairs)))


def regressions(current: DataFrame, baseline: DataFrame, threshold: float = REGRESSION_DROP) -> DataFrame:
    """Aggregate metrics that fell by more than ``threshold`` from a positive baseline."""
    both = _long(baseline).withColumnRenamed("value", "baseline").join(
        _long(current).withColumnRenamed("value", "current"), "metric"
    )
    drop = F.col("baseline") - F.col("current")
    return both.where((F.col("baseline") > 0) & (drop > threshold)).select(
        "metric", "baseline", "current", F.round(-drop, 4).alias("delta"), F.lit(True).alias("critical")
    )


def query_regressions(current: DataFrame, baseline: DataFrame, threshold: float = REGRESSION_DROP) -> DataFrame:
    """Queries whose reciprocal rank fell by more than ``threshold``."""
    old = baseline.select("query_id", F.col("reciprocal_rank").alias("baseline"))
    both = current.select("query_id", F.col("reciprocal_rank").alias("current")).join(old, "query_id")
    drop = F.col("baseline") - F.col("current")
    return both.where((F.col("baseline") > 0) & (drop > threshold))
