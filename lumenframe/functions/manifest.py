"""Versioned manifests: small JSON files, committed by a rename that fails if the version is there already.

Readers see the old version or the new one, and of two writers one has to try again. The file system must have such a rename,
as HDFS and local ones do; object stores without it need one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class Manifest:
    def __init__(self, spark: SparkSession, root: str):
        self.root, self.jvm = root.rstrip("/"), spark.sparkContext._jvm
        self.gateway, self.conf = spark.sparkContext._gateway, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)
        self.fs.mkdirs(self.path(""))

    def path(self, name: str) -> Any:
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def versions(self) -> list[int]:
        names = (x.getPath().getName() for x in self.fs.listStatus(self.path("")))
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def read(self, name: str) -> Any:
        stream = self.fs.open(self.path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def write(self, name: str, content: Any) -> None:
        out = self.fs.create(self.path(name), False)
        out.write(bytearray(json.dumps(content).encode()))
        out.close()

    def load(self, version: int | None = None) -> tuple[int, Any]:
        """(version, content), of the last version by default; (0, None) if there is none."""
        version = max(self.versions(), default=0) if version is None else version
        return (version, self.read(f"v{version:010d}.json")) if version else (0, None)

    def commit(self, base: int, content: Any) -> int:
        """Makes content the version after base."""
        draft, final = f"draft-{uuid.uuid4().hex}", f"v{base + 1:010d}.json"
        self.write(draft, content)
        never = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)  # no option: an existing version is an error
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(self.path(draft), self.path(final), never)
        except Exception as e:
            self.fs.delete(self.path(draft), False)
            if self.fs.exists(self.path(final)):
                raise Conflict(f"version {base + 1} is there already") from e
            raise
        return base + 1

    def forget(self, version: int) -> None:
        self.fs.delete(self.path(f"v{version:010d}.json"), False)
