"""Row numbers over a whole table without putting it into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.functions.shared import shared_dir


def ranked(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """df with `rank`, 0, 1, ... by its unique key, and the number of rows: range partitions are sorted and kept, each row
    knows its place in its partition, and the counts of the partitions before are added."""
    shared_dir(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # an id is the partition, from bit 33 on, and the place in it; the cut keeps both as they are
    part = df.repartitionByRange(n, key).sortWithinPartitions(key).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    counts = {r["p"]: r["n"] for r in part.groupBy(F.shiftright("_id", 33).alias("p")).agg(F.count("*").alias("n")).collect()}  # one for each partition
    before, total = [], 0
    for p in range(max(counts, default=-1) + 1):
        before.append(total)
        total += counts.get(p, 0)
    shift = F.get(F.array(*map(F.lit, before or [0])), F.shiftright("_id", 33).cast("int"))
    return part.withColumn("rank", (F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + shift).cast("long")).drop("_id"), total
