"""Helpers that the operators share: lineage cuts, tables in the shared folder, size-checked broadcasts."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions.shared import shared_dir

#: Characters that separate words in every contract of this subpackage.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: Largest number of rows (of a few numbers each) that an operator broadcasts; beyond it, it shuffles.
BROADCAST_ROWS = 200_000


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that no executor's loss repeats what came before."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


class Stage:
    """Parquet tables in the shared folder for the length of one call of an operator."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_dir(spark)}/lumenframe-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are within BROADCAST_ROWS, else as it is (Spark then shuffles)."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_job(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_job(spark: SparkSession) -> None:
    """Session settings of a job that hands whole texts to Python: batches of at most 8 MB, so that a worker's memory and
    the executor's buffers don't depend on how long the texts are. Called by the jobs, not by the operators."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


@contextmanager
def arrow_batches(spark: SparkSession, rows: int, mb: int) -> Iterator[None]:
    """Jobs started inside hand rows to Python in batches of at most so many rows and megabytes."""
    now = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": f"{mb}m"}
    before = {k: spark.conf.get(k) for k in now}
    try:
        for k, v in now.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def slices(batches: Iterator[pd.DataFrame], rows: int = 1000) -> Iterator[pd.DataFrame]:
    """The batches in pieces of at most so many rows, so that what a task makes of them stays small."""
    for pdf in batches:
        for at in range(0, len(pdf), rows):
            yield pdf.iloc[at : at + rows]


def slim(run: Callable) -> Callable:
    """run for mapInPandas, after which the worker, which Spark keeps for later tasks, gives its free memory back."""

    def inner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library: nothing to give back by this way

    return inner
