"""Named queries over the given tables, each with the SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# The driver tables carry no file paths; both sides derive the same one.
CORPUS_SQL = """corpus AS (
  SELECT doc_id, source || '/' || lpad(CAST(doc_id AS VARCHAR), 12, '0') || '.txt' AS file_path,
         '.txt' AS file_extension, source, lang, text AS content
  FROM documents)"""


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``; ``sql`` is its equivalent for the comparison engine."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Use every core when the input arrives in fewer splits than there are cores.

    A large table has far more splits than cores and passes through unshuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the shape the corpus operators expect."""
    from pyspark.sql import functions as F

    path = F.concat(
        "source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".txt")
    )
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id",
        path.alias("file_path"),
        F.lit(".txt").alias("file_extension"),
        "source",
        "lang",
        F.col("text").alias("content"),
    )
