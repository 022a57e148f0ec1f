"""Training shards by size-tiered compaction under a versioned manifest, in DataFrame functions only.

Arrivals become small immutable Parquet shards. Shards of one tier (sizes within a factor of `factor`) are merged, once
there are `fanout` of them, into files of about the target size; shards of at least half the target are final. Merging
deals its shards into files by their bytes, and one task reads a file's shards and writes it, without a shuffle. Each append
and each merge commits the next version of the manifest by a rename that fails if the version is there already (see
functions/manifest): readers see the old list or the new one, and of two writers one tries again on the newer list. A
version names parts, small files that list up to PART live shards each; a commit writes the parts that it changes only. What
a lost executor left half-written is in no manifest.

`vacuum` deletes manifests but the last `keep`, and shard folders that none of those lists and that are older than
`grace_s`, a day by default: another writer's shards, written but not yet committed, and a reader's older version stay.
Only a store's sole writer, with no reader on older versions, may take a shorter time.

Rows come back as they were: nulls, empty and long texts, repeated rows and extra columns included. An empty arrival
commits a version without new shards; reading a store without shards needs the schema that its manifest keeps.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lumenframe.functions.manifest import Conflict, Manifest

__all__ = ["Conflict", "Shard", "ShardStore"]
PART = 1000  # shards that a part of the manifest lists
FILES = 200  # that one job writes when shards are merged
TARGET_BYTES, FANOUT, FACTOR, SMALLEST = 64 << 20, 4, 4.0, 64 << 10


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, factor: float = FACTOR):
        self.spark, self.root, self.target, self.fanout, self.factor = spark, root.rstrip("/"), target_bytes, fanout, factor
        self.log, self.lists = Manifest(spark, f"{self.root}/manifest"), Manifest(spark, f"{self.root}/parts")
        self.fs, self.known = self.log.fs, {}  # parts never change

    def _path(self, name: str):
        return self.log.jvm.org.apache.hadoop.fs.Path(name)

    # ---- manifest ----

    def versions(self) -> list[int]:
        return self.log.versions()

    def _part(self, name: str) -> list[Shard]:
        if name not in self.known:
            self.known[name] = [Shard(*s) for s in self.lists.read(name)]
        return self.known[name]

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard], str | None]:
        """(version, shards, schema as JSON) of a version, the last one by default; version 0 has nothing."""
        version, found = self.log.load(version)
        return (version, [s for p in found["parts"] for s in self._part(p)], found["schema"]) if found else (0, [], None)

    def _commit(self, base: int, shards: list[Shard], schema: str) -> int:
        found = self.log.load(base)[1] if base else None
        before = found["parts"] if found else []
        live, parts, left = set(shards), [], []
        for p in before:
            own = self._part(p)
            if live.issuperset(own) and len(own) >= PART // 2:
                parts.append(p)
                live.difference_update(own)
            else:
                left += [s for s in own if s in live]
        left = list(dict.fromkeys([*left, *(s for s in shards if s in live)]))
        for at in range(0, len(left), PART):
            name = f"{uuid.uuid4().hex}.json"
            self.lists.write(name, [[s.path, s.bytes] for s in left[at : at + PART]])
            parts.append(name)
        return self.log.commit(base, {"schema": schema, "parts": parts})

    # ---- shards ----

    def _write(self, df: DataFrame, max_records: int = 0) -> list[Shard]:
        folder = f"{self.root}/shards/{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", max_records).parquet(folder)
        files = [x for x in self.fs.listStatus(self._path(folder)) if x.getPath().getName().startswith("part-")]
        return sorted((Shard(x.getPath().toString(), x.getLen()) for x in files), key=lambda s: s.path)

    def append(self, df: DataFrame, max_records: int = 0, tries: int = 20) -> int:
        """Adds an arrival, in files of at most max_records rows (0: as its tasks write them); returns the new version."""
        own = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields]).json()
        if self.manifest()[2] not in (None, own):
            raise ValueError("an arrival has the columns of the store")
        new = self._write(df, max_records)
        for left in reversed(range(tries)):
            base, shards, schema = self.manifest()
            if schema not in (None, own):
                raise ValueError("an arrival has the columns of the store")
            try:
                return self._commit(base, [*shards, *new], own)
            except Conflict:
                if not left:
                    raise
        raise AssertionError("no try")

    def tier(self, shard: Shard) -> int:
        """-1: final."""
        return -1 if 2 * shard.bytes >= self.target else int(math.log(max(shard.bytes, SMALLEST) / SMALLEST, self.factor))

    def plan(self, shards: list[Shard]) -> list[Shard]:
        """The shards of the smallest tier that has enough of them."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            tiers.setdefault(self.tier(s), []).append(s)
        full = [t for t, own in tiers.items() if t >= 0 and len(own) >= self.fanout]
        return tiers[min(full)] if full else []

    def files(self, old: list[Shard]) -> list[list[list[Shard]]]:
        """The shards by file, the files by job. Shards to be merged are below half the target each, so a file has from three
        quarters to five quarters of it; a last one that would have less than half goes with the one before."""
        out: list[list[Shard]] = [[]]
        held = 0
        for s in old:
            if held >= 0.75 * self.target:
                out.append([])
                held = 0
            out[-1].append(s)
            held += s.bytes
        if len(out) > 1 and 2 * held < self.target:
            last = out.pop()
            out[-1].extend(last)
        return [out[i : i + FILES] for i in range(0, len(out), FILES)]

    def compact(self) -> int:
        """Merges until no tier is full; returns the last version."""
        while True:
            base, shards, schema = self.manifest()
            old = self.plan(shards)
            if not old:
                return base
            new = [s for files in self.files(old) for s in self._merge(files, schema)]
            gone = set(old)
            while gone <= set(shards):  # another merge may take a shard first: then this one is void, its files go in vacuum
                try:
                    self._commit(base, [*(s for s in shards if s not in gone), *new], schema)
                    break
                except Conflict:
                    base, shards, schema = self.manifest()

    def _merge(self, files: list[list[Shard]], schema: str | None) -> list[Shard]:
        """Each of the lists as one file, by a task of its own."""
        key = "spark.sql.unionOutputPartitioning"  # else a union of single partitions is a single partition
        before = self.spark.conf.get(key)
        self.spark.conf.set(key, "false")
        try:
            return self._write(reduce(DataFrame.union, (self._read(own, schema).coalesce(1) for own in files)))
        finally:
            self.spark.conf.set(key, before)

    def _read(self, shards: list[Shard], schema: str | None) -> DataFrame:
        kind = T.StructType.fromJson(json.loads(schema)) if schema else T.StructType()
        return self.spark.read.schema(kind).parquet(*(s.path for s in shards)) if shards else self.spark.createDataFrame([], kind)

    def read(self, version: int | None = None) -> DataFrame:
        _, shards, schema = self.manifest(version)
        return self._read(shards, schema)

    def vacuum(self, keep: int = 2, grace_s: float = 86_400.0) -> None:
        """Deletes manifests but the last `keep`, and older files that none of those list."""
        versions = self.versions()
        live = {s.path for v in versions[-keep:] for s in self.manifest(v)[1]}
        parts = {p for v in versions[-keep:] for p in self.log.load(v)[1]["parts"]}
        for v in versions[:-keep]:
            self.log.forget(v)
        top, before = self._path(f"{self.root}/shards"), (time.time() - grace_s) * 1000
        for part in self.fs.listStatus(self.lists.path("")):
            if part.getPath().getName() not in parts and part.getModificationTime() <= before:
                self.fs.delete(part.getPath(), False)
        for folder in self.fs.listStatus(top) if self.fs.exists(top) else []:
            files = list(self.fs.listStatus(folder.getPath()))
            if max([folder.getModificationTime(), *(f.getModificationTime() for f in files)]) > before:
                continue
            if not any(f.getPath().toString() in live for f in files):
                self.fs.delete(folder.getPath(), True)
            else:
                for f in files:
                    if f.getPath().getName().startswith("part-") and f.getPath().toString() not in live:
                        self.fs.delete(f.getPath(), False)

    def drop(self) -> None:
        self.fs.delete(self._path(self.root), True)
