"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """From spark.checkpoint.dir; a temporary one only where none is set and all runs on this machine (tests)."""
    sc = spark.sparkContext
    here = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not here:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        here = tempfile.mkdtemp(prefix="lumenframe-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(here)
    return here.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared one."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
