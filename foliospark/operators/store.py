"""Keyed tables on plain files: classify changes, upsert, delete, versions, snapshot."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from foliospark.staging import folder_bytes, stage, stage_sized

DELETED = "__deleted"
#: Bytes of a file of a run, and how much larger than what follows it a run may be and still be merged.
FILE_BYTES, GROWTH = 256 << 20, 2


def orphans(stored: DataFrame, current: DataFrame, key: str = "file_path") -> DataFrame:
    """Stored keys that are no longer present."""
    return stored.join(current.select(key), key, "left_anti")


def upsert_actions(
    stored: DataFrame, incoming: DataFrame, key: str = "file_path", digest: str = "content_hash", force: bool = False
) -> DataFrame:
    """inserted / updated / unchanged for each incoming key; ``force`` never leaves one unchanged."""
    old = stored.select(key, F.col(digest).alias("__old"))
    same = F.lit(False) if force else F.col("__old") == F.col(digest)
    action = F.when(F.col("__old").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    return incoming.select(key, digest).join(old, key, "left").select(key, digest, action.alias("action"))


def action_summary(actions: DataFrame) -> DataFrame:
    count = lambda a: F.count_if(F.col("action") == a).alias(a)
    return actions.agg(count("inserted"), count("updated"), count("unchanged"), F.count(F.lit(1)).alias("total"))


def snapshot_changes(previous: DataFrame, current: DataFrame, key: str = "file_path") -> DataFrame:
    """added / modified / removed files between two (key, size, mtime) snapshots."""
    p = previous.select(key, F.struct("size", "mtime").alias("__p"))
    c = current.select(key, F.struct("size", "mtime").alias("__c"))
    change = F.when(F.col("__p").isNull(), "added").when(F.col("__c").isNull(), "removed").otherwise("modified")
    both = p.join(c, key, "full_outer").where(~F.col("__p").eqNullSafe(F.col("__c")))
    return both.select(key, change.alias("change"))


def parse_snapshot(text: Column | str) -> Column:
    """Snapshot JSON {path: [mtime, size]} as a map of structs; malformed entries are dropped."""
    c = F.col(text) if isinstance(text, str) else text
    raw = F.from_json(c, "map<string, array<bigint>>")
    valid = F.map_filter(raw, lambda _, v: F.size(v) == 2)
    return F.transform_values(valid, lambda _, v: F.struct(v[0].alias("mtime"), v[1].alias("size")))


class Conflict(RuntimeError):
    """Another writer stored the next version first."""


class KeyedTable:
    """A parquet table with upsert and delete by key, in versions.

    A write adds one folder of changed rows below ``data`` and then a small file below
    ``versions`` that names the folders of the table; moving that file into place is the
    commit. A job that ends before it leaves the old version as it was. Folders are runs,
    oldest first: a row of a later run replaces that of an earlier one, and a deleted key is
    a row with a mark. A write is merged with the runs before it that are not much larger, so
    a table of n writes has about log n runs and a row is rewritten about as often. Each run
    is sorted by key over files whose number comes from its size; a lookup reads the row
    groups that may hold its key. Null is a key like any other.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType, file_bytes: int = FILE_BYTES):
        self.spark, self.path, self.key, self.file_bytes = spark, path.rstrip("/"), key, file_bytes
        self.schema = StructType([f for f in schema.fields if f.name != DELETED])
        self._typed = StructType([*self.schema.fields, StructField(DELETED, BooleanType())])

    # -- versions

    def _hadoop(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        """Stored versions, oldest first."""
        files, folder = self._hadoop("versions")
        if not files.exists(folder):
            return []
        names = [status.getPath().getName() for status in files.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def _runs(self, version: int | None = None) -> tuple[int, list[dict]]:
        """(version, its runs); the newest if none is named, 0 before the first write."""
        known = self.versions()
        if version is None:
            version = known[-1] if known else 0
        elif version not in known:
            raise ValueError(f"no version {version}; stored: {known[:1]} to {known[-1:]}")
        if not version:
            return 0, []
        files, path = self._hadoop(f"versions/{version:012d}.json")
        stream = files.open(path)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return version, json.loads(text)

    def _commit(self, version: int, runs: list[dict]) -> None:
        files, draft = self._hadoop(f"versions/.{uuid.uuid4().hex}")
        _, final = self._hadoop(f"versions/{version:012d}.json")
        out = files.create(draft, False)
        try:
            out.write(bytearray(json.dumps(runs).encode()))
        finally:
            out.close()
        if files.exists(final) or not files.rename(draft, final):
            files.delete(draft, False)
            raise Conflict(f"version {version} of {self.path} was stored by another writer")

    # -- reading

    def _run(self, name: str) -> DataFrame:
        return self.spark.read.schema(self._typed).parquet(f"{self.path}/data/{name}")

    def _merged(self, runs: list[dict]) -> DataFrame:
        """Rows of some runs with the newest of each key, deleted ones included."""
        if not runs:
            return self.spark.createDataFrame([], self._typed)
        oldest = self._run(runs[0]["name"])
        if len(runs) == 1:
            return oldest
        later = [self._run(r["name"]).withColumn("__at", F.lit(i)) for i, r in enumerate(runs[1:])]
        rest = [c for c in self._typed.names if c != self.key]
        newest = reduce(DataFrame.unionByName, later)
        if len(later) > 1:
            picked = F.max_by(F.struct(*rest), "__at").alias("r")
            newest = newest.groupBy(self.key).agg(picked).select(self.key, "r.*")
        newest = newest.select(self._typed.names)
        keys = newest.select(F.col(self.key).alias("__key"))
        return oldest.join(keys, F.col(self.key).eqNullSafe(F.col("__key")), "left_anti").unionByName(newest)

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version, or an older one that is still stored."""
        return self._merged(self._runs(version)[1]).where(~F.col(DELETED)).drop(DELETED)

    def lookup(self, value) -> DataFrame:
        """Rows of one key; the condition reaches every run's scan."""
        return self.read().where(F.col(self.key) == value)

    # -- writing

    def _write(self, rows: DataFrame, size: int | None = None) -> dict:
        """One run. Its rows are written once as they come where their size is not known yet."""
        name = uuid.uuid4().hex
        if size is None:
            rows, size = stage_sized(rows, "keyed-run")
        parts = max(1, -(-size // self.file_bytes))
        laid = rows.repartitionByRange(parts, self.key) if parts > 1 else rows.coalesce(1)
        laid.sortWithinPartitions(self.key).write.parquet(f"{self.path}/data/{name}")
        return {"name": name, "bytes": folder_bytes(self.spark, f"{self.path}/data/{name}")}

    def apply(self, rows: DataFrame) -> int:
        """Commit changed rows, those with a true ``__deleted`` as deletions, as the next version; returns its number."""
        version, runs = self._runs()
        runs.append(self._write(rows.select(self._typed.names)))
        first = len(runs) - 1
        while first and runs[first - 1]["bytes"] <= GROWTH * sum(r["bytes"] for r in runs[first:]):
            first -= 1
        if first < len(runs) - 1:
            folded = self._merged(runs[first:])
            if not first:  # nothing older is left for a deletion to hide
                folded = folded.where(~F.col(DELETED))
            runs[first:] = [self._write(folded, sum(r["bytes"] for r in runs[first:]))]
        self._commit(version + 1, runs)
        return version + 1

    def upsert(self, rows: DataFrame) -> int:
        """Insert new keys and replace existing ones. ``rows`` must be unique on the key."""
        return self.apply(rows.select(*self.schema.names, F.lit(False).alias(DELETED)))

    def delete(self, keys: DataFrame) -> int:
        """Delete keys; those that are not stored change nothing."""
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields if f.name != self.key]
        return self.apply(keys.select(self.key).distinct().select(self.key, *nothing, F.lit(True).alias(DELETED)))

    def vacuum(self, keep: int = 1) -> int:
        """Forget all but the newest ``keep`` versions and delete folders that none of them names.

        Folders of failed writes go as well, so no write may run meanwhile. Returns the number of folders deleted.
        """
        known = self.versions()
        kept = known[-max(1, keep):]
        named = {r["name"] for v in kept for r in self._runs(v)[1]}
        for version in known[: len(known) - len(kept)]:
            files, path = self._hadoop(f"versions/{version:012d}.json")
            files.delete(path, False)
        files, folder = self._hadoop("data")
        gone = [s.getPath() for s in files.listStatus(folder) if s.getPath().getName() not in named] if files.exists(folder) else []
        for path in gone:
            files.delete(path, True)
        return len(gone)


def latest_versions(rows: DataFrame, key: str, version: str) -> DataFrame:
    """Newest row per key of an append-only log (a finalised run supersedes its start)."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("r")).select(key, "r.*")


def read_through(requests: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Split requests into cached answers and misses."""
    return requests.join(cache, key), requests.join(cache.select(key), key, "left_anti")


def evict_oldest(cache: DataFrame, capacity: int, key: str, inserted: str) -> DataFrame:
    """Room for one more entry: a cache of ``capacity`` entries or more loses its oldest tenth, or what exceeds the capacity.

    Entries go by key, whatever their other columns hold; keys are unique. The oldest are
    found with a distributed top-k, not by numbering all rows.
    """
    total = cache.count()
    if total < capacity:
        return cache
    drop = max(total - capacity, max(1, capacity // 10))
    doomed = cache.select(key, inserted).orderBy(inserted, key).limit(drop).select(F.col(key).alias("__doomed"))
    return cache.join(stage(doomed, "evicted"), F.col(key).eqNullSafe(F.col("__doomed")), "left_anti")


def touch(cache: DataFrame, used: DataFrame, key: str, count: str = "access_count") -> DataFrame:
    """``cache`` with the accesses of ``used`` (key, one row per access) added to its counter."""
    hits = used.groupBy(F.col(key).alias("__key")).agg(F.count(F.lit(1)).alias("__n"))
    counted = cache.join(hits, F.col(key).eqNullSafe(F.col("__key")), "left")
    return counted.withColumn(count, F.coalesce(count, F.lit(0)) + F.coalesce("__n", F.lit(0))).select(cache.columns)
