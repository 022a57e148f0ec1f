"""Where the streams' rows go: late ones to a table of their own, changes of ROIs into a versioned table.

Both sinks are for foreachBatch and safe to repeat: a batch that is played again after a failure writes the same folder, or
finds its number in the table's manifest and is left out.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenframe.functions.manifest import Manifest

KEY = ["session_id", "roi_id"]
TABLE = "session_id long, roi_id long, roi_type string, name string, color array<double>, xs array<double>, ys array<double>, zs array<double>, selected boolean"
BUCKETS = 64


class RoiTable:
    """One row for each live ROI, in buckets by session. A batch rewrites the buckets that it touches, into a new folder, and
    commits the next version: the buckets' folders and the batch's number. What a failed batch left is in no version."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.manifest = Manifest(spark, f"{self.root}/manifest")

    def _folders(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(TABLE).parquet(*folders) if folders else self.spark.createDataFrame([], TABLE)

    def read(self, version: int | None = None) -> DataFrame:
        _, found = self.manifest.load(version)
        return self._folders(sorted(found["folders"].values()) if found else [])

    def merge(self, feed: DataFrame, batch: int) -> bool:
        """Puts a batch's `row` and `gone` events into the table; False if it is in already."""
        base, found = self.manifest.load()
        found = found or {"batch": -1, "folders": {}}
        if batch <= found["batch"]:
            return False
        columns = [c.split(" ")[0] for c in TABLE.split(", ")]
        last = feed.filter("event IN ('row', 'gone')").groupBy(*KEY).agg(F.max_by(F.struct("event", *columns[2:]), F.struct("seq", "no")).alias("r"))
        bucket = F.pmod(F.xxhash64("session_id"), F.lit(self.buckets)).alias("bucket")
        last = last.select(*KEY, "r.*", bucket).persist()
        try:
            touched = [str(r["bucket"]) for r in last.select("bucket").distinct().collect()]  # at most as many as there are buckets
            folders = dict(found["folders"])
            if touched:
                old = self._folders([folders[b] for b in touched if b in folders])
                kept = old.join(last.select(*KEY), KEY, "left_anti").select(*columns, bucket)
                rows = kept.union(last.filter("event = 'row'").select(*columns, "bucket"))
                folder = f"{self.root}/data/{uuid.uuid4().hex}"
                rows.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(folder)
                made = {x.getPath().getName() for x in self.manifest.fs.listStatus(self.manifest.jvm.org.apache.hadoop.fs.Path(folder))}
                folders = {b: f for b, f in folders.items() if b not in touched} | {b: f"{folder}/bucket={b}" for b in touched if f"bucket={b}" in made}
            self.manifest.commit(base, {"batch": batch, "folders": folders})
            return True
        finally:
            last.unpersist()

    def vacuum(self, keep: int = 2) -> None:
        """Deletes versions but the last ones, and folders that those don't list; for the table's only writer."""
        versions = self.manifest.versions()
        live = {f.rsplit("/", 1)[0].rsplit("/", 1)[1] for v in versions[-keep:] for f in self.manifest.load(v)[1]["folders"].values()}
        for v in versions[:-keep]:
            self.manifest.forget(v)
        top = self.manifest.jvm.org.apache.hadoop.fs.Path(f"{self.root}/data")
        for folder in self.manifest.fs.listStatus(top) if self.manifest.fs.exists(top) else []:
            if folder.getPath().getName() not in live:
                self.manifest.fs.delete(folder.getPath(), True)


def routed(out: DataFrame, late: str, on_time: Callable[[DataFrame, int], object], checkpoint: str, **trigger: object) -> StreamingQuery:
    """Runs a stream of this package: its late rows go to the folder `late` (a subfolder for each batch), and the others to
    on_time(rows, batch)."""

    def each(rows: DataFrame, batch: int) -> None:
        rows.persist()
        try:
            rows.filter("event = 'late'").write.mode("overwrite").parquet(f"{late}/batch={batch}")
            on_time(rows.filter("event <> 'late'"), batch)
        finally:
            rows.unpersist()

    return out.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def folder(path: str) -> Callable[[DataFrame, int], object]:
    """An on_time that writes a subfolder for each batch."""
    return lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")
