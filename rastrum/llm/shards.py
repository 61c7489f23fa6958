"""Sharding (operator 2), DataFrame operations only: size-tiered compaction under versioned manifests.

A store is a folder: ``data/<run>/`` holds immutable Parquet shards, ``manifest/v<number>`` lists what a version
adds and drops, ``manifest/s<number>`` all shards of one (written every SNAPSHOT versions). Arrivals are appended as small shards. ``compact`` sorts the shards below the target
size into tiers (each tier spans a factor of ``growth`` in bytes) and merges every tier that holds
``fan_in`` shards or a whole target's worth, without a shuffle: a task reads a run of shards and
writes one file of about the target size. A version exists from the moment its manifest folder is
renamed into place; two writers can't commit the same number, and a job that dies before leaves only unlisted files.

Nulls and repeated rows are stored as they are; an empty arrival commits a version without new shards;
an empty store reads as an empty table of the given schema. Any columns are allowed.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rastrum.llm.frames import shared_dir, table


SNAPSHOT = 32


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


class ShardStore:
    """A versioned set of Parquet shards of one schema."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType, target_bytes: int = 128 << 20, growth: int = 4, fan_in: int = 4):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.target_bytes, self.growth, self.fan_in = target_bytes, growth, fan_in
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self, kind: str) -> list[int]:
        folder = self._path(f"{self.root}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in self._fs.listStatus(folder)]
        return sorted(int(n[1:]) for n in names if n[:1] == kind)

    def versions(self) -> list[int]:
        return self._numbers("v")

    def _entries(self, after: int, version: int, snapshot: int | None = None) -> list:
        """Entries of the versions beyond ``after`` up to ``version``, and of a snapshot."""
        folders = [f"{self.root}/manifest/v{n}" for n in self.versions() if after < n <= version]
        folders += [f"{self.root}/manifest/s{snapshot}"] if snapshot is not None else []
        return self.spark.read.schema("path string, bytes long, added boolean").parquet(*folders).collect() if folders else []

    def shards(self, version: int | None = None) -> list[Shard]:
        """The files of a version: one entry per file, so their number is the data's size over the file size."""
        version = self._latest() if version is None else version
        snapshot = max((n for n in self._numbers("s") if n <= version), default=None)
        rows = self._entries(snapshot or 0, version, snapshot)
        gone = {r["path"] for r in rows if not r["added"]}
        return sorted((Shard(r["path"], r["bytes"]) for r in rows if r["added"] and r["path"] not in gone), key=lambda s: s.path)

    def _list(self, rows: list[tuple[str, int, bool]], name: str) -> bool:
        """Writes entries beside the manifest and renames them into place; false if ``name`` was there before."""
        temporary, final = f"{self.root}/manifest/_{uuid.uuid4().hex}", self._path(f"{self.root}/manifest/{name}")
        self.spark.createDataFrame(rows, "path string, bytes long, added boolean").coalesce(1).write.parquet(temporary)
        inside = self._path(f"{self.root}/manifest/{name}/{temporary.rpartition('/')[2]}")  # where a rename puts it that came second
        if not self._fs.exists(final) and self._fs.rename(self._path(temporary), final) and not self._fs.exists(inside):
            return True
        for left in (inside, self._path(temporary)):
            self._fs.delete(left, True)
        return False

    def commit(self, added: list[Shard], dropped: list[Shard], base: int) -> int:
        """Version ``base`` + 1: what ``base`` holds with these changes; fails if another writer has committed it."""
        version = base + 1
        if not self._list([(s.path, s.bytes, True) for s in added] + [(s.path, s.bytes, False) for s in dropped], f"v{version}"):
            raise RuntimeError(f"version {version} was committed by another writer")
        if version % SNAPSHOT == 0:
            self._list([(s.path, s.bytes, True) for s in self.shards(version)], f"s{version}")
        return version

    def _files(self, folder: str) -> list[Shard]:
        found, walk = [], self._fs.listFiles(self._path(folder), True)
        while walk.hasNext():
            status = walk.next()
            if status.getPath().getName().endswith(".parquet"):
                found.append(Shard(status.getPath().toString(), status.getLen()))
        return found

    def _age(self, shard: Shard) -> float:
        return time.time() - self._fs.getFileStatus(self._path(shard.path)).getModificationTime() / 1000

    def _latest(self) -> int:
        return (self.versions() or [0])[-1]

    def append(self, arrivals: DataFrame) -> int:
        """Commits the rows as new shards, one for each partition that has rows."""
        base = self._latest()
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        arrivals.select(self.schema.names).write.parquet(folder)
        return self.commit(self._files(folder), [], base)

    def append_each(self, arrivals: DataFrame, by: str) -> int:
        """One append for each value of ``by`` (few values), in order, from a single pass over the rows."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        arrivals.select(*self.schema.names, F.col(by).alias("__arrival")).write.partitionBy("__arrival").parquet(folder)
        runs: dict[str, list[Shard]] = {}
        for shard in self._files(folder):
            runs.setdefault(shard.path.rsplit("/", 2)[1], []).append(shard)
        version = self._latest()
        for run in sorted(runs):
            version = self.commit(runs[run], [], version)
        return version

    def tier(self, shard: Shard) -> int:
        """0 for shards of the target size, then one more for each factor of ``growth`` below it."""
        size, tier = shard.bytes, 0
        while size * self.growth <= self.target_bytes * 2 and tier < 12:
            size, tier = size * self.growth, tier + 1
        return tier if shard.bytes * 2 < self.target_bytes else 0

    def compact(self) -> int:
        """Merges tiers that are full until none is; returns the version that holds the result."""
        version, before = self._latest(), self.shards()
        shards = before
        while True:
            tiers: dict[int, list[Shard]] = {}
            for shard in shards:
                tiers.setdefault(self.tier(shard), []).append(shard)
            due = {t: run for t, run in tiers.items() if t and (len(run) >= self.fan_in or sum(s.bytes for s in run) >= self.target_bytes)}
            if not due:
                break
            tier, run = max(due.items())
            size = sum(s.bytes for s in run)
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            rows = self.spark.read.schema(self.schema).parquet(*[s.path for s in run])
            rows.coalesce(max(1, round(size / self.target_bytes))).write.parquet(folder)
            gone = {s.path for s in run}
            shards = [s for s in shards if s.path not in gone] + self._files(folder)
        if shards is before:
            return version
        had, have = set(before), set(shards)
        return self.commit([s for s in shards if s not in had], [s for s in before if s not in have], version)

    def vacuum(self, keep_version: int, least_age: float = 24 * 3600.0) -> None:
        """Ends time travel before ``keep_version``: deletes what only older versions hold.

        Every version from ``keep_version`` on stays readable. Files that no version lists may belong to a writer who hasn't
        committed yet; they go once they are ``least_age`` seconds old.
        """
        latest = self._latest()
        held = self.shards(keep_version)
        wanted = {s.path for s in held} | {r["path"] for r in self._entries(keep_version, latest) if r["added"]}
        first = min(self.versions(), default=1)
        older = {r["path"] for r in self._entries(0, keep_version)} | {s.path for s in self.shards(first)}
        self._list([(s.path, s.bytes, True) for s in held], f"s{keep_version}")
        for kind in "vs":
            for n in self._numbers(kind):
                if n < keep_version:
                    self._fs.delete(self._path(f"{self.root}/manifest/{kind}{n}"), True)
        for shard in self._files(f"{self.root}/data"):
            if shard.path not in wanted and (shard.path in older or self._age(shard) >= least_age):
                self._fs.delete(self._path(shard.path), False)

    def read(self, version: int | None = None) -> DataFrame:
        paths = [s.path for s in self.shards(version)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents arrive in four batches of unequal size, are compacted, and are read from the last version."""
    docs = table(spark, sf_dir, "documents")
    store = ShardStore(spark, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", docs.schema)
    lot = F.pmod(F.xxhash64("doc_id"), F.lit(16))
    arrival = F.when(lot < 8, 0).when(lot < 12, 1).when(lot < 15, 2).otherwise(3)
    store.append_each(docs.withColumn("__lot", arrival), "__lot")
    version = store.compact()
    store.vacuum(version)
    return store.read(version).select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


OP2_SQL = "select doc_id, lang, source, n_chars, md5(text) as text_md5 from documents"
