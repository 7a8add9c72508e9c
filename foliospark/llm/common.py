"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foliospark.staging import checkpoint_root

#: The word pattern of most operators: everything but the space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each value, null as empty, one value at a time."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def words(text: bytes) -> list[bytes]:
    """Words after lower-casing A-Z; ``bytes.split`` separates at exactly U+0009-U+000D and the space."""
    return text.lower().split()


def free_name(taken: DataFrame | list[str], base: str) -> str:
    """``base``, lengthened until no column is called so (names are compared without case, as Spark does)."""
    names = {c.lower() for c in (taken.columns if isinstance(taken, DataFrame) else taken)}
    while base.lower() in names:
        base += "_"
    return base


def columns_of(df: DataFrame) -> list[Column]:
    """All columns of ``df`` by name, whatever characters the names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def remainder(id_column: str, modulus: int) -> Column:
    """crc32 of the id as text modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % F.lit(modulus)


def largest(rows: DataFrame, value: str, limit: int, *ties: str) -> DataFrame:
    """The ``limit`` rows with the largest positive ``value``, ties in the order of ``ties``.

    A histogram of the values (some thousands of classes at most) first shows which class
    the last of them is in. Only rows from there on meet in one task: about ``limit``, not
    ``limit`` from every partition.
    """
    kind = F.floor(F.log2(F.col(value)) * 64)
    counts = sorted(rows.groupBy(kind.alias("k")).count().collect(), key=lambda r: -r["k"])
    reached, least = 0, None
    for r in counts:
        least = r["k"]
        reached += r["count"]
        if reached >= limit:
            break
    near = rows.where(kind >= least) if least is not None else rows
    return near.orderBy(F.desc(value), *ties).limit(limit)


class Scratch:
    """Intermediate tables of one run, in the folder that the whole cluster shares.

    Writing a table cuts the lineage: a lost executor costs the tasks since the last
    table, not the whole job. Tables no longer read can be dropped on the way.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{checkpoint_root(spark)}/foliospark/{label}-{uuid.uuid4().hex}"
        self.count = 0
        self.held: list[DataFrame] = []

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a scan of what was written."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.held.append(out)
        return out

    def clear(self, *kept: DataFrame) -> None:
        """Delete all tables but ``kept``."""
        names = {t._scratch_path for t in kept}
        self.drop(*[t for t in self.held if t._scratch_path not in names])
        self.held = list(kept)

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables written by ``put``."""
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table._scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
