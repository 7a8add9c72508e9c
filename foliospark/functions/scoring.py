"""Scores of generated answers against their evaluation cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliospark.functions import text as tx

# Weight of each dimension in the overall score.
WEIGHTS = {
    "faithfulness": 0.25,
    "relevance": 0.20,
    "completeness": 0.15,
    "citation_coverage": 0.15,
    "tool_success": 0.10,
    "guardrail_compliance": 0.10,
    "latency_budget": 0.05,
}
PASS_FROM = 0.7
MIN_DRAFT_CHARS = 10
# What counts as a citation (on lower-cased text).
CITATION = r"\[[0-9,\s]+\]|\(fonte:|\(source:|(^|[^a-z0-9_])fonte($|[^a-z0-9_])|(^|[^a-z0-9_])ref\."


def found(words: Column, low: Column) -> Column:
    return F.filter(words, lambda w: F.contains(low, F.lower(w)))


def cites(low: Column) -> Column:
    return low.rlike(CITATION)


def dimensions(output: Column) -> dict[str, Column]:
    """Seven scores; reads expected_keywords, forbidden_keywords, requires_citations,
    expected_agents, actual_agents, latency_budget_ms and actual_latency_ms."""
    low = F.lower(F.coalesce(output, F.lit("")))
    expected, forbidden = F.col("expected_keywords"), F.col("forbidden_keywords")
    n_exp, n_forb = F.size(expected), F.size(forbidden)
    hit, bad = F.size(found(expected, low)), F.size(found(forbidden, low))
    agents = F.col("expected_agents")
    coverage = hit / n_exp
    return {
        "faithfulness": F.when(n_forb == 0, 1.0).otherwise(1.0 - bad / n_forb),
        "relevance": F.when(n_exp == 0, F.when(F.length(low) > 0, 1.0).otherwise(0.0)).otherwise(coverage),
        "completeness": F.when(n_exp == 0, 1.0).otherwise(coverage),
        "citation_coverage": F.when(~F.col("requires_citations") | cites(low), 1.0).otherwise(0.0),
        "tool_success": F.when(F.size(agents) == 0, 1.0).otherwise(
            F.size(F.filter(agents, lambda a: F.array_contains("actual_agents", a))) / F.size(agents)
        ),
        "guardrail_compliance": F.when(bad > 0, 0.0).otherwise(1.0),
        "latency_budget": F.when(
            (F.coalesce("latency_budget_ms", F.lit(0)) == 0)
            | (F.coalesce("actual_latency_ms", F.lit(0)) == 0)
            | (F.col("actual_latency_ms") <= F.col("latency_budget_ms")),
            1.0,
        ).otherwise(0.0),
    }


def score_cases(cases: DataFrame, output: str = "actual_output") -> DataFrame:
    """Add the seven dimensions, overall_score (3 decimals) and passed.

    A dimension without a value counts neither in the sum nor in the weights.
    """
    return with_overall(cases.withColumns(dimensions(F.col(output))))


def with_overall(scored: DataFrame) -> DataFrame:
    """overall_score and passed from the dimension columns."""
    total = sum((F.coalesce(F.col(d) * w, F.lit(0.0)) for d, w in WEIGHTS.items()), F.lit(0.0))
    weight = sum((F.when(F.col(d).isNotNull(), w).otherwise(0.0) for d, w in WEIGHTS.items()), F.lit(0.0))
    overall = F.round(F.round(F.try_divide(total, weight), 9), 3)
    return scored.withColumn("overall_score", overall).withColumn("passed", F.col("overall_score") >= PASS_FROM)


def aggregate_scores(scored: DataFrame) -> DataFrame:
    """Mean of every dimension with pass and fail counts, one row."""
    means = [F.coalesce(F.avg(d), F.lit(0.0)).alias(d) for d in (*WEIGHTS, "overall_score")]
    return scored.agg(
        *means,
        F.count_if("passed").alias("passed_cases"),
        F.count_if(~F.col("passed")).alias("failed_cases"),
    )


def critique(draft: Column | str) -> Column:
    """struct(approved, violations, confidence): forbidden words, missing citations, too short."""
    d = tx.col(draft)
    low = F.lower(d)
    bad = found(F.col("forbidden_keywords"), low)
    missing = F.col("requires_citations") & ~cites(low)
    violations = F.array_compact(
        F.concat(
            F.transform(bad, lambda w: F.concat(F.lit('Forbidden keyword detected: "'), w, F.lit('"'))),
            F.array(F.when(missing, F.lit("Response requires citations but none were found"))),
            F.array(F.when(F.length(tx.strip(d)) < MIN_DRAFT_CHARS, F.lit("Response is too short or empty"))),
        )
    )
    checks = 1 + F.col("requires_citations").cast("int") + F.size("forbidden_keywords")
    return F.struct(
        (F.size(violations) == 0).alias("approved"),
        violations.alias("violations"),
        F.round((checks - F.size(violations)) / checks, 2).alias("confidence"),
    )
