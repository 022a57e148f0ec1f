"""Line dedup against levelled, sorted runs of line hashes, in DataFrame functions only.

A line's key is the line without white space at its ends and with A-Z lower-cased; only keys of at least `min_chars` code
points count. Documents come in batches of ascending doc_id, each of at most about `batch_bytes` of text and at least
BATCHES of them. A batch's keys, one row each with the smallest doc_id that holds them, are merge-joined with every run;
keys that no run holds are the batch's own and form the next run. A run is a bucketed, sorted table, so the joins neither
shuffle nor re-read other buckets; when a level holds `fanout` runs, they are merged, bucket by bucket, into one of the
next level, which the following batches read in their place. Since batches ascend, the run's doc_id is the key's smallest.

Lines of other documents with that key go; every other line stays. Null or empty texts are one empty line. Rows without
doc_id stay as they are. Rows that repeat a doc_id count as one document where keys are held, so each of them keeps the lines
that only they have; what goes is told for each row's own text. Empty tables give
empty results; other columns pass through, but for the names lines, drop, _doc, _row, n_lines, n_dropped
and kept.
"""

from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.shared import delete

from .common import SPACES, Stage, cut, partitions

BATCHES, FANOUT = 5, 2  # batches at least; runs of a level that make one of the next
BATCH_BYTES = 1 << 40
TASK_POSITIONS = 4_000_000  # positions of dropped lines that a task may hold


def key(line: Column) -> Column:
    bare = F.btrim(line, F.lit(SPACES))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def row_of(text: Column) -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


class LineRuns:
    """The runs, newest first, by level. Each is a table of (h1, h2, owner, last, new) bucketed and sorted by (h1, h2);
    rows with new = true are the run's keys, the others are the batch's hits on older runs and go when runs merge."""

    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT):
        """root: a folder of the shared one, where the tables lie."""
        self.spark, self.root, self.fanout, self.levels = spark, root, fanout, [[]]
        self.name, self.made, self.buckets = f"lumenframe_lines_{uuid.uuid4().hex}", 0, partitions(spark)

    def _write(self, df: DataFrame) -> str:
        table = f"{self.name}_{self.made}"
        self.made += 1
        df.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.root}/{table}").saveAsTable(table)
        return table

    def add(self, keys: DataFrame) -> DataFrame:
        """Adds a batch's keys(h1, h2, first, last); returns its duplicates (h1, h2, owner)."""
        found, owners = keys, []
        for i, run in enumerate(x for level in self.levels for x in level):
            older = self.spark.table(run).filter("new").select("h1", "h2", F.col("owner").alias(f"o{i}"))
            found, owners = found.join(older.hint("merge"), ["h1", "h2"], "left"), [*owners, F.col(f"o{i}")]
        old = F.coalesce(*owners, F.lit(None).cast("long"))
        run = self._write(found.select("h1", "h2", F.coalesce(old, "first").alias("owner"), "last", old.isNull().alias("new")))
        # read by path: the join that follows must be free to split a hot line's rows, which buckets would forbid
        self.levels[0].insert(0, run)
        return self.spark.read.schema(self.spark.table(run).schema).parquet(f"{self.root}/{run}").filter("owner < last").select("h1", "h2", "owner")

    def _own(self, run: str) -> DataFrame:
        return self.spark.table(run).filter("new").select("h1", "h2", "owner", "last")

    def compact(self) -> None:
        for depth in range(10**6):
            if depth == len(self.levels) or len(self.levels[depth]) < self.fanout:
                return
            runs, self.levels[depth] = self.levels[depth], []
            # the runs share no key: a full merge join of the sorted buckets puts them together without a shuffle
            merged = self._own(runs[0])
            for run in runs[1:]:
                more = self._own(run).select("h1", "h2", *(F.col(c).alias(f"_{c}") for c in ("owner", "last")))
                merged = merged.join(more.hint("merge"), ["h1", "h2"], "full").select("h1", "h2", *(F.coalesce(c, f"_{c}").alias(c) for c in ("owner", "last")))
            if depth + 1 == len(self.levels):
                self.levels.append([])
            self.levels[depth + 1].insert(0, self._write(merged.withColumn("new", F.lit(True))))
            for run in runs:
                self._drop(run)

    def _drop(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        delete(self.spark, f"{self.root}/{run}")

    def drop(self) -> None:
        for i in range(self.made):
            self._drop(f"{self.name}_{i}")


def drops(docs: DataFrame, min_chars: int = 10, batches: int | None = None, fanout: int = FANOUT, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, row (a hash of the text), drop (positions of the lines that go, from 0), for the rows that lose lines. batches: in place of a
    number by batch_bytes."""
    spark, stage = docs.sparkSession, Stage(docs.sparkSession)
    if batches is None:
        batches = max(BATCHES, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // batch_bytes))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / batches for i in range(1, batches)], 10 * batches)).first()[0] if batches > 1 else []
    bounds = [None, *sorted(set(cuts or [])), None]
    runs, out = LineRuns(spark, stage.root, fanout), []
    try:
        for i, (low, high) in enumerate(zip(bounds, bounds[1:])):
            batch = docs.filter(F.col("doc_id").isNotNull())
            batch = batch.filter(F.col("doc_id") > low) if low is not None else batch
            batch = batch.filter(F.col("doc_id") <= high) if high is not None else batch
            lines = batch.select(F.col("doc_id").cast("long"), row_of(F.col("text")).alias("row"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
            lines = lines.filter(F.char_length("line") >= min_chars).select("doc_id", "row", "pos", key(F.col("line")).alias("key")).filter(F.char_length("key") >= min_chars)
            lines = stage.put(lines.select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), f"lines{i}")
            twice = runs.add(lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")))
            gone = lines.join(twice, ["h1", "h2"]).filter("owner < doc_id")
            out.append(cut(gone.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("drop"))))
            runs.compact()
    finally:  # whatever failed, no table stays
        runs.drop()
        stage.drop()
    all_ = out[0]
    for x in out[1:]:
        all_ = all_.union(x)
    return all_


def dedup_lines(docs: DataFrame, min_chars: int = 10, batches: int | None = None, fanout: int = FANOUT) -> DataFrame:
    """docs with n_lines, n_dropped and kept, the text of the lines that stay."""
    docs = docs.drop("lines", "drop", "_doc", "_row", "n_lines", "n_dropped", "kept")
    gone = drops(docs, min_chars, batches, fanout)
    # hashed where a task's share of the positions is small, so that the texts need no sorting; else a merge join
    positions = gone.agg(F.sum(F.size("drop") + 8)).first()[0] or 0
    side = gone.select(F.col("doc_id").alias("_doc"), F.col("row").alias("_row"), "drop")
    side = side.hint("shuffle_hash") if positions <= TASK_POSITIONS * partitions(docs.sparkSession) else side
    same = (F.col("doc_id") == F.col("_doc")) & (row_of(F.col("text")) == F.col("_row"))
    rows = docs.join(side, same, "left").drop("_doc", "_row").withColumn("lines", lines_of(F.col("text")))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "drop")
    kept = F.when(F.col("drop").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n"))
    return rows.withColumn("n_lines", F.size("lines").cast("long")).withColumn("n_dropped", F.coalesce(F.size(F.array_distinct("drop")), F.lit(0)).cast("long")).withColumn("kept", kept).drop("lines", "drop")
