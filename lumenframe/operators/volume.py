"""Volumes as scanlines: one row for each (series_id, k, j), values along i in an array; no query explodes a volume first."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_SERIES = 100_000


SCANLINES = "series_id int, k int, j int, vals array<double>"
SLICE_ROWS = 4_096  # scanlines of a row group, about: what a reader passes over at once


def ingest(blobs: DataFrame, decode: Callable[[bytes], Iterator[tuple]]) -> DataFrame:
    """blobs(series_id, content) -> scanlines, by the caller's decoder of (k, a slice as rows of values), or (k, rows, their js)
    if they are not 0, 1, ...; masked values are null. A slice is a batch of its own, whose values stay in Arrow's buffers: a
    task holds one slice beside the bytes it decodes. A failure becomes a row with its error, after the slices that came before
    it."""
    schema = pa.schema([("series_id", pa.int32()), ("k", pa.int32()), ("j", pa.int32()), ("vals", pa.list_(pa.float64())), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for series, content in zip(batch.column(0), batch.column(1)):
                try:
                    for k, rows, *js in decode(content.as_buffer() if content.is_valid else b""):
                        null = np.ma.getmaskarray(rows).ravel() if np.ma.isMaskedArray(rows) else None
                        rows = np.ascontiguousarray(np.ma.getdata(rows), dtype=np.float64)
                        ny, nx = rows.shape
                        j = np.asarray(js[0], np.int32) if js else np.arange(ny, dtype=np.int32)
                        vals = pa.ListArray.from_arrays(pa.array(np.arange(0, (ny + 1) * nx, nx, dtype=np.int32)[: ny + 1] if nx else np.zeros(ny + 1, np.int32)), pa.array(rows.ravel(), mask=null))
                        yield pa.RecordBatch.from_arrays([pa.repeat(series, ny).cast(pa.int32()), pa.array(np.full(ny, k, np.int32)), pa.array(j), vals, pa.nulls(ny, pa.string())], schema=schema)
                except Exception as e:  # noqa: BLE001  a decoder's own failure is data here
                    none = [pa.nulls(1, schema.field(c).type) for c in ("k", "j", "vals")]
                    yield pa.RecordBatch.from_arrays([pa.array([series.as_py()], pa.int32()), *none, pa.array([str(e)])], schema=schema)

    return blobs.select("series_id", "content").mapInArrow(run, f"{SCANLINES}, error string")


def write(scanlines: DataFrame, path: str) -> None:
    """Parquet by series, sorted by k and j, in row groups of a few slices: readers of a series open its folder only, readers
    of a slice pass over the other row groups."""
    by = scanlines.repartition("series_id", F.floor(F.col("k") / 64)).sortWithinPartitions("series_id", "k", "j")
    by.write.partitionBy("series_id").option("parquet.block.row.count.limit", SLICE_ROWS).parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The scanlines that `write` left; filters and joins on series_id prune folders, filters on k and j row groups."""
    return spark.read.schema(SCANLINES).parquet(path)


def known(series: DataFrame) -> DataFrame:
    """series, broadcast only if few enough are counted."""
    return F.broadcast(series) if series.count() <= BROADCAST_SERIES else series


def coronal(lines: DataFrame, geometry: DataFrame) -> DataFrame:
    """New j is the old k, new k the reversed old j: rows are renamed, values stay where they are."""
    return lines.join(known(geometry.select("series_id", "ny")), "series_id").select("series_id", (F.col("ny") - 1 - F.col("j")).alias("k"), F.col("k").alias("j"), "vals")


BRICK = 32  # values along a side of what is turned at once


def sagittal(lines: DataFrame, brick: int = BRICK) -> DataFrame:
    """New i is the old j, new j the old k, new k the old i. Rows are cut into pieces of `brick` values; a brick is such a
    piece of `brick` rows with one k. Whole pieces are shuffled, not values: they meet in their brick, which is turned, and its
    columns meet in the new rows."""
    n = F.size("vals")
    part = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / brick).cast("int")), lambda b: F.struct(b.alias("b"), F.slice("vals", b * brick + 1, F.lit(brick)).alias("p")))
    pieces = lines.filter(n > 0).select("series_id", "k", "j", F.floor(F.col("j") / brick).alias("bj"), F.explode(part).alias("e"))
    bricks = pieces.groupBy("series_id", "k", "bj", F.col("e.b").alias("b")).agg(F.sort_array(F.collect_list(F.struct("j", F.col("e.p").alias("p")))).alias("r"))
    longest = F.array_max(F.transform("r", lambda x: F.size(x["p"])))
    turned = F.transform(F.sequence(F.lit(0), longest - 1), lambda i: F.struct((F.col("b") * brick + i).alias("k"), F.transform(F.filter("r", lambda x: F.size(x["p"]) > i), lambda x: F.get(x["p"], i)).alias("vals")))
    columns = bricks.select("series_id", F.col("k").alias("j"), "bj", F.explode(turned).alias("c"))
    rows = columns.groupBy("series_id", F.col("c.k").alias("k"), "j").agg(F.sort_array(F.collect_list(F.struct("bj", F.col("c.vals").alias("vals")))).alias("r"))
    return rows.select("series_id", "k", "j", F.flatten(F.transform("r", lambda x: x["vals"])).alias("vals"))


def axial_slice(lines: DataFrame, s: int) -> DataFrame:
    return lines.filter(F.col("k") == s)


def coronal_slice(lines: DataFrame, s: int) -> DataFrame:
    return lines.filter(F.col("j") == s)


def sagittal_slice(lines: DataFrame, s: int) -> DataFrame:
    return lines.select("series_id", "k", "j", F.get("vals", F.lit(s)).alias("v")).filter(F.col("v").isNotNull())


def grey(vals: Column, window: Column, level: Column) -> Column:
    """0..255 by a linear ramp of the given window around the level; a window of 0 is a step at the level."""
    low = level - window / 2
    return F.transform(vals, lambda v: F.when(window == 0, F.when(v >= level, 255.0).otherwise(0.0)).otherwise(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (v - low) / window * 255))))


def rescaled(vals: Column, slope: Column, intercept: Column) -> Column:
    return F.transform(vals, lambda v: v * F.coalesce(slope, F.lit(1.0)) + F.coalesce(intercept, F.lit(0.0)))


def by_axis(orientation: Column, x: Column, y: Column, z: Column) -> Column:
    """x, y or z for orientation 0, 1, 2."""
    return F.when(orientation == 2, z).when(orientation == 1, y).otherwise(x)


def location(orientation: Column, index: Column, fallback: Column | None = None) -> Column:
    """Position of a slice from the geometry columns, else the header's."""
    own = by_axis(orientation, F.col("ox"), F.col("oy"), F.col("oz")) + index * by_axis(orientation, F.col("sx"), F.col("sy"), F.col("sz"))
    return own if fallback is None else F.coalesce(own, fallback)


def extents(lines: DataFrame) -> DataFrame:
    """series_id, orientation, low, high."""
    g = lines.groupBy("series_id").agg(F.min("k").alias("k0"), F.max("k").alias("k1"), F.min("j").alias("j0"), F.max("j").alias("j1"), (F.max(F.size("vals")) - 1).alias("i1"))
    return g.select("series_id", F.expr("stack(3, 2, k0, k1, 1, j0, j1, 0, 0, i1) AS (orientation, low, high)"))


def clamp(s: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(s, high))


def wheel(steps: Column, start: Column, low: Column, high: Column) -> Column:
    """Where a slice ends up after ordered steps of +-1 that stop at the ends."""
    return F.aggregate(steps, start, lambda s, d: clamp(s + d, low, high))


def wheels(log: DataFrame, start: int, low: int, high: int, block: int = 4096) -> DataFrame:
    """session_id, slice: where each session's steps(session_id, seq, step) leave a slice that stops at the ends. A run of
    steps is the function min(hi, max(lo, s + shift)); those of counted blocks of a log are found side by side, then
    composed in order, so no task holds a long log. seq counts a session's rows from 1."""
    ends = "struct<shift:bigint,lo:bigint,hi:bigint>"
    one = F.struct(F.lit(0).cast("long").alias("shift"), F.lit(low).cast("long").alias("lo"), F.lit(high).cast("long").alias("hi"))
    then = lambda f, shift, lo, hi: F.struct((f["shift"] + shift).alias("shift"), clamp(f["lo"] + shift, lo, hi).alias("lo"), clamp(f["hi"] + shift, lo, hi).alias("hi")).cast(ends)
    part = log.groupBy("session_id", F.floor((F.col("seq") - 1) / block).alias("_block")).agg(F.sort_array(F.collect_list(F.struct("seq", "step"))).alias("_s"))
    part = part.select("session_id", "_block", F.aggregate("_s", one.cast(ends), lambda f, x: then(f, x["step"], F.lit(low), F.lit(high))).alias("_f"))
    whole = part.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("_block", "_f"))).alias("_fs"))
    f = F.aggregate("_fs", one.cast(ends), lambda f, x: then(f, x["_f"]["shift"], x["_f"]["lo"], x["_f"]["hi"]))
    return whole.withColumn("_f", f).select("session_id", clamp(F.lit(start) + F.col("_f.shift"), F.col("_f.lo"), F.col("_f.hi")).cast("int").alias("slice"))


def turned(orientation: Column) -> Column:
    """The next orientation; the slice then starts at its lowest."""
    return (orientation + 1) % 3


def sample(points: DataFrame, geometry: DataFrame, lines: DataFrame) -> DataFrame:
    """points(series_id, orientation, slice_index, x, y, z) with row, col and value of the voxel, for points inside. The
    two in-plane indices round half to even; one equi-join on the scanline's key reads the value."""
    p = points.join(known(geometry), "series_id")
    index = lambda w, o, s: F.rint((F.col(w) - F.col(o)) / F.col(s)).cast("int")
    third = lambda axis, w, o, s: F.when(F.col("orientation") == axis, F.col("slice_index").cast("int")).otherwise(index(w, o, s))
    p = p.withColumn("_i", third(0, "x", "ox", "sx")).withColumn("_j", third(1, "y", "oy", "sy")).withColumn("_k", third(2, "z", "oz", "sz"))
    p = p.filter((F.col("_i") >= 0) & (F.col("_i") < F.col("nx")) & (F.col("_j") >= 0) & (F.col("_j") < F.col("ny")) & (F.col("_k") >= 0) & (F.col("_k") < F.col("nz")))
    hit = p.join(lines.select("series_id", F.col("k").alias("_k"), F.col("j").alias("_j"), "vals"), ["series_id", "_k", "_j"])
    return hit.select(*points.columns, F.col("_j").alias("row"), F.col("_i").alias("col"), F.get("vals", F.col("_i")).alias("value"))


def snap(orientation: Column, index: Column, x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """The point with its through-plane coordinate moved onto the slice."""
    on = location(orientation, index)
    return F.when(orientation == 0, on).otherwise(x), F.when(orientation == 1, on).otherwise(y), F.when(orientation == 2, on).otherwise(z)


def unflatten(flat: DataFrame) -> DataFrame:
    """flat(series_id, nx, ny, nz, vals), x fastest -> scanlines. Rows are cut inside the array first, so that exploding
    repeats no volume."""
    nx, ny = F.col("nx"), F.col("ny")
    cut = F.transform(F.sequence(F.lit(0), ny * F.col("nz") - 1), lambda r: F.struct(F.floor(r / ny).cast("int").alias("k"), (r % ny).alias("j"), F.slice("vals", r * nx + 1, nx).alias("vals")))
    return flat.select("series_id", F.explode(cut).alias("r")).select("series_id", "r.k", "r.j", "r.vals")


def linear(i: Column, j: Column, k: Column) -> Column:
    return i + F.col("nx") * (j + F.col("ny") * k)
