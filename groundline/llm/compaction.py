"""Operator 5: size-tiered compaction of shards. DataFrame functions only.

An arrival is appended as small files that never change. Files of similar size are
merged, `fan_in` or more at a time, into files of up to `target` bytes; the merges of a
pass are one job, each reads its files in one task and moves nothing between executors.
The live files are what the newest manifest names; a manifest is put in place by one
rename that fails if another writer was first, and that writer's work is then planned
upon anew. Files stay until no version that is kept names them.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import fs_path, prepare, remove

TARGET, FAN_IN, ARRIVAL_ROWS = 128 << 20, 4, 2000
#: Merges in a job, versions that stay readable.
LOT, KEEP = 256, 2


@dataclass(frozen=True)
class Shard:
    path: str  # under the store's root
    size: int


def plan_merges(shards: list[Shard], target: int = TARGET, fan_in: int = FAN_IN) -> list[list[Shard]]:
    """Runs to merge: shards of one tier (a power of `fan_in` in bytes), in order of
    size, cut where `target` would be passed. A run of fewer than `fan_in` shards waits,
    unless it fills the target to three quarters; full shards are left alone."""
    tiers: dict[int, list[Shard]] = {}
    for s in shards:
        if s.size < target * 3 // 4:
            tiers.setdefault(int(math.log(max(1, s.size), fan_in)), []).append(s)
    out = []
    for tier in sorted(tiers):
        run: list[Shard] = []
        total = 0
        for s in sorted(tiers[tier], key=lambda s: (s.size, s.path)):
            if run and total + s.size > target:
                out.append(run)
                run, total = [], 0
            run.append(s)
            total += s.size
        out.append(run)
    return [r for r in out if len(r) >= fan_in or len(r) > 1 and sum(s.size for s in r) >= target * 3 // 4]


class ShardStore:
    """A folder of immutable Parquet shards and versioned manifests."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType | None = None):
        self.spark, self.root = prepare(spark), root.rstrip("/")
        self.fs, self.at = fs_path(spark, self.root)
        self.schema = schema

    def versions(self) -> list[int]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests")
        if not self.fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard]]:
        """(version, live shards); (0, []) for a new store."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return 0, []
        jvm = self.spark._jvm
        stream = self.fs.open(jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifests/{version:012d}.json"))
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        said = json.loads(text)
        self.schema = T.StructType.fromJson(said["schema"])
        return version, [Shard(**s) for s in said["shards"]]

    def commit(self, seen: int, shards: list[Shard]) -> int:
        """Put version seen + 1 in place; FileExistsError if another writer did so."""
        jvm, version = self.spark._jvm, seen + 1
        path = jvm.org.apache.hadoop.fs.Path
        final = path(f"{self.root}/manifests/{version:012d}.json")
        draft = path(f"{self.root}/manifests/.{version:012d}.{jvm.java.util.UUID.randomUUID()}")
        out = self.fs.create(draft, False)
        out.write(json.dumps({"schema": json.loads(self.schema.json()), "shards": [vars(s) for s in shards]}).encode())
        out.close()
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(self.fs.makeQualified(draft), self.fs.makeQualified(final), none)
        except Exception as e:
            self.fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise FileExistsError(f"version {version} is there already") from None
            raise
        return version

    def _list(self, name: str) -> list[Shard]:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        found = [(f.getPath().getName(), f.getLen()) for f in self.fs.listStatus(folder)]
        return [Shard(f"{name}/{n}", size) for n, size in sorted(found) if n.endswith(".parquet")]

    def _new(self, kind: str) -> str:
        return f"data/{kind}-{self.spark._jvm.java.util.UUID.randomUUID()}"

    def _try_commit(self, name: str, change: Callable[[list[Shard]], list[Shard] | None]) -> int:
        """Commit `change` of the live shards, again after other writers' commits; None
        means that it can't be made any more, and folder `name` is removed."""
        while True:
            seen, live = self.manifest()
            if (shards := change(live)) is None:
                remove(self.spark, f"{self.root}/{name}")
                return seen
            try:
                return self.commit(seen, shards)
            except FileExistsError:
                continue

    def append(self, arrivals: DataFrame, rows: int = ARRIVAL_ROWS) -> int:
        """Write arrivals as shards of at most `rows` rows, where they are; commit them.
        Columns are taken by name; a ValueError if names or types aren't the store's."""
        self.manifest()
        if self.schema is None:
            self.schema = arrivals.schema
        kinds = lambda schema: sorted((f.name, f.dataType.simpleString()) for f in schema)
        if kinds(arrivals.schema) != kinds(self.schema):
            raise ValueError(f"arrivals have {arrivals.schema.simpleString()}, the store {self.schema.simpleString()}")
        name = self._new("arrival")
        (
            arrivals.select(*(arrivals[f"`{f.name}`"] for f in self.schema))
            .write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(f"{self.root}/{name}")
        )
        return self._try_commit(name, lambda live: live + self._list(name))

    def compact(self, target: int = TARGET, fan_in: int = FAN_IN, keep: int = KEEP) -> int:
        """Merge tier by tier until no run is left; a pass is a job for each LOT of runs,
        and a commit each."""
        while True:
            seen, live = self.manifest()
            runs = plan_merges(live, target, fan_in)
            if not runs:
                return seen
            for i in range(0, len(runs), LOT):
                some, name = runs[i : i + LOT], self._new("merged")
                parts = [self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{s.path}" for s in run)).coalesce(1) for run in some]
                whole = parts[0]
                for part in parts[1:]:  # a union keeps its inputs' partitions: one file a run
                    whole = whole.union(part)
                whole.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
                gone, merged = {s.path for run in some for s in run}, self._list(name)

                def change(live: list[Shard]) -> list[Shard] | None:
                    kept = [s for s in live if s.path not in gone]
                    return kept + merged if len(kept) + len(gone) == len(live) else None

                self._try_commit(name, change)
                self.expire(keep)

    def expire(self, keep: int = KEEP) -> None:
        """Remove all versions but the newest `keep`, and then the files that only they name."""
        old, kept = self.versions()[:-keep], self.versions()[-keep:]
        named = {s.path for v in kept for s in self.manifest(v)[1]}
        gone = {s.path for v in old for s in self.manifest(v)[1]} - named
        for v in old:
            remove(self.spark, f"{self.root}/manifests/{v:012d}.json")
        for path in gone:
            remove(self.spark, f"{self.root}/{path}")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version's shards; the newest by default."""
        _, live = self.manifest(version)
        if not live:
            return self.spark.createDataFrame([], self.schema or T.StructType())
        return self.spark.read.schema(self.schema).parquet(*(f"{self.root}/{s.path}" for s in live))


def compact_table(docs: DataFrame, root: str, target: int = TARGET, fan_in: int = FAN_IN, rows: int = ARRIVAL_ROWS) -> DataFrame:
    """Append `docs` to the store at `root`, compact it, and read the newest version.

    Every row and column comes back as it was: nulls, repeated rows, empty and very long
    texts. Rows are dealt by files, not by a key, so no key is hot. An empty table gives
    an empty version with its schema.
    """
    store = ShardStore(docs.sparkSession, root, docs.schema)
    store.append(docs, rows)
    store.compact(target, fan_in)
    return store.read()
