"""Folders of files as data sources: a listing, in batches and as a stream, and a sink that writes a file for each row.

    for source in (FolderListing, FileDrop):
        spark.dataSource.register(source)
    spark.read.format("folder_listing").option("folders", json.dumps(["/a", "hdfs://n/b"])).load()
    spark.readStream.format("folder_listing").option("root", "/archive").load()
    rows.write.format("file_drop").option("root", "/out").mode("append").save()

Listing: regular files directly in each folder; names with a leading dot are left out, names with a leading underscore are
not (Spark's own file sources skip both). Folders are given one by one, or as all those directly in a root; ones that don't
exist give no rows. Tasks list FOLDERS of them each. Filters on folder (equal, in) leave out partitions' folders, and those on
name (equal, in, starts, ends, contains) leave out files before they are looked at closer: with the option pushdown, which
needs the session's spark.sql.python.filterPushdown.enabled; they mean the same without it. As a stream, a micro-batch has the files modified
since the last one and up to SETTLE seconds ago: a file that is moved in with an older time of modification is missed.

Sink: rows (path, content), path relative to the root. A file is written beside its place and moved there, so readers see it
whole or not at all, and a task that runs twice does no harm. A row that can't be written is no error: its path and the
reason are a line of JSON below the root's _warnings, where they show up when the job commits; a job that fails leaves none.

Paths are those of Arrow's file systems (local, mounted, HDFS by libhdfs, S3, GCS) and must mean the same to all executors.
"""

from __future__ import annotations

import json
import posixpath
import time
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from lumenframe.functions.shared import delete

FOLDERS, SETTLE = 100, 2.0
LISTING = "folder string, path string, name string, length long"


def _system(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def _folders(options: dict) -> list[str]:
    found = [f for f in json.loads(options.get("folders", "[]")) if f]
    if root := options.get("root"):
        system, at = _system(root)
        below = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
        found += sorted(f"{root.rstrip('/')}/{x.base_name}" for x in below if x.type == fs.FileType.Directory and not x.base_name.startswith((".", "_")))
    return found


class Folders(InputPartition):
    def __init__(self, folders: list[str], low: int = 0, high: int | None = None):
        super().__init__(folders)
        self.folders, self.low, self.high = folders, low, high


def _dealt(folders: list[str], *times: int) -> list[Folders]:
    return [Folders(folders[i : i + FOLDERS], *times) for i in range(0, len(folders), FOLDERS)]


def _listed(partition: Folders, names: list[Filter]) -> Iterator[tuple]:
    for folder in partition.folders:
        system, at = _system(folder)
        for x in sorted(system.get_file_info(fs.FileSelector(at, allow_not_found=True)), key=lambda x: x.base_name):
            if x.base_name.startswith(".") or not all(_holds(f, x.base_name) for f in names) or x.type != fs.FileType.File:
                continue
            if partition.high is None or partition.low < x.mtime_ns <= partition.high:
                yield folder, f"{folder.rstrip('/')}/{x.base_name}", x.base_name, x.size


def _holds(f: Filter, value: str) -> bool:
    match f:
        case EqualTo(value=x):
            return value == x
        case In(value=x):
            return value in x
        case StringStartsWith(value=x):
            return value.startswith(x)
        case StringEndsWith(value=x):
            return value.endswith(x)
        case StringContains(value=x):
            return x in value
    raise ValueError(f)


class ListingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.of_folder, self.of_name = options, [], []

    def partitions(self) -> list[InputPartition]:
        return _dealt([x for x in _folders(self.options) if all(_holds(f, x) for f in self.of_folder)]) or [Folders([])]

    def read(self, partition: Folders) -> Iterator[tuple]:
        return _listed(partition, self.of_name)


class PushedReader(ListingReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In) and f.attribute == ("folder",):
                self.of_folder.append(f)
            elif isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith | StringContains) and f.attribute == ("name",):
                self.of_name.append(f)
            else:
                yield f


class ListingStream(DataSourceStreamReader):
    """An offset is a time of modification, in nanoseconds."""

    def __init__(self, options: dict):
        self.options, self.settle = options, float(options.get("settle", SETTLE))

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - int(self.settle * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _dealt(_folders(self.options), start["until"], end["until"])

    def read(self, partition: Folders) -> Iterator[tuple]:
        return _listed(partition, [])

    def commit(self, end: dict) -> None:
        pass


class FolderListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return LISTING

    def reader(self, schema) -> DataSourceReader:
        return (PushedReader if self.options.get("pushdown") == "true" else ListingReader)(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ListingStream(self.options)


@dataclass
class Dropped(WriterCommitMessage):
    written: int
    warnings: str | None  # the file that holds them, not yet in place


class FileWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root = root

    def write(self, iterator: Iterator) -> Dropped:
        system, root = _system(self.root)
        made, written, failed = set(), 0, []
        for row in iterator:
            target = posixpath.join(root, row["path"])
            beside = posixpath.join(posixpath.dirname(target), f".{uuid.uuid4().hex}")
            try:
                if (folder := posixpath.dirname(target)) not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(beside) as out:
                    out.write(bytes(row["content"] or b""))
                system.move(beside, target)
                written += 1
            except (OSError, ValueError, TypeError) as e:
                failed.append(json.dumps({"path": row["path"], "reason": str(e)}))
        if not failed:
            return Dropped(written, None)
        staged = f"{root}/_warnings/.{uuid.uuid4().hex}"
        system.create_dir(posixpath.dirname(staged), recursive=True)
        with system.open_output_stream(staged) as out:
            out.write("\n".join(failed).encode())
        return Dropped(written, staged)

    def commit(self, messages: list[Dropped | None]) -> None:
        for m in messages:
            if m and m.warnings:
                folder, name = posixpath.split(m.warnings)
                _system(self.root)[0].move(m.warnings, f"{folder}/{name.removeprefix('.')}.json")

    def abort(self, messages: list[Dropped | None]) -> None:
        for m in messages:
            if m and m.warnings:
                _system(self.root)[0].delete_file(m.warnings)


class FileDrop(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_drop"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("file_drop appends; files of the same name are replaced")
        return FileWriter(self.options["root"])


def listing(spark: SparkSession, folders: list[str] | None = None, root: str | None = None) -> DataFrame:
    spark.dataSource.register(FolderListing)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled")
    read = spark.read.format("folder_listing").option("folders", json.dumps(folders or [])).option("pushdown", pushed)
    return (read.option("root", root) if root else read).load()


def drop(rows: DataFrame, root: str) -> DataFrame:
    """Writes rows(path, content) below root; returns the warnings (path, reason)."""
    spark = rows.sparkSession
    spark.dataSource.register(FileDrop)
    rows.select("path", "content").write.format("file_drop").option("root", root).mode("append").save()
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_warnings")
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema("path string, reason string").json(str(at)) if found else spark.createDataFrame([], "path string, reason string")


def contents(found: DataFrame) -> DataFrame:
    """A listing's paths with the files' bytes, read in the tasks that list them."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, out, held = [], [], 0
            for path in batch.column(0).to_pylist():
                system, at = _system(path)
                with system.open_input_file(at) as f:
                    out.append(f.readall())
                paths.append(path)
                held += len(out[-1])
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "content": pa.array(out, pa.binary())})
                    paths, out, held = [], [], 0
            yield pa.RecordBatch.from_pydict({"path": pa.array(paths, pa.string()), "content": pa.array(out, pa.binary())})

    return found.select("path").mapInArrow(read, "path string, content binary")


def clear(spark: SparkSession, root: str) -> None:
    """Removes the folders directly in root with all they hold, dealt to tasks."""
    found = spark.createDataFrame([(f,) for f in _folders({"root": root})], "folder string")

    def gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                system, at = _system(folder)
                system.delete_dir(at)
            yield batch

    found.repartition(max(1, spark.sparkContext.defaultParallelism)).mapInArrow(gone, found.schema).write.format("noop").mode("overwrite").save()


def remove(spark: SparkSession, root: str) -> None:
    """Removes root, its folders in tasks."""
    clear(spark, root)
    delete(spark, root)


def mask_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and length of the *.mat files directly in folder, with their bytes; no rows if it is unset or not there."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    if folder:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs_ = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs_.exists(path) and fs_.getFileStatus(path).isDirectory():
            return spark.read.format("binaryFile").option("pathGlobFilter", "*.mat").load(folder)
    return spark.createDataFrame([], schema)
