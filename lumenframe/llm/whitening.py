"""Embedding whitening: projections on the leading components of the covariance, by matrix-free Jacobi-Davidson.

Vectors become longs, floor(256 c). The fit list, each distinct vector once, lies packed in the shared folder; a product of
its covariance V with a few columns B is one Spark job, sum of (x - S/n) ((x - S/n)' B) / n over the packed blocks, centred
before multiplying; V is never formed. Each task returns one small matrix; where these are many, Spark adds them up by entry
first. `davidson.leading` asks for products until every wanted pair's residual is at double precision.

A row counts if its vector is not null, holds no null, NaN or infinite entry, and is as long as the longest such vector (a
shorter one lacks entries). Components without variance (rank below the number wanted) are left out, and so are all rows of
a table whose vectors are all the same; empty tables give empty results. Rows that repeat, ids that repeat or are null and
ties are answered row by row; ties between eigenvalues leave the choice of components within their space to the seed. A
deviation beyond a long is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import davidson
from .common import Stage, arrow_batches, cut

SCALE, COMPONENTS = 256, 4
BLOCK_BYTES = 1 << 19
#: Bytes that the tasks of one product may send to the driver; beyond it, their matrices are added up by Spark.
DIRECT_BYTES = 32 << 20


def usable(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """(id, x) of the rows that count, all vectors of one length."""
    ok = F.coalesce(F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))
    rows = df.filter(ok).select(F.col(id_).alias("id"), F.transform(vector, lambda v: F.floor(v.cast("double") * SCALE)).alias("x"))
    longest = rows.agg(F.max(F.size("x"))).first()[0] or 0
    return rows.filter(F.size("x") == longest) if longest else rows.limit(0)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class FitList:
    """The distinct vectors, packed, with their number n and their exact sums s."""

    def __init__(self, rows: DataFrame, stage: Stage):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column(0)).astype("<i8") if batch.num_rows else np.zeros((0, 1), "<i8")
                each = max(1, BLOCK_BYTES // (8 * max(1, x.shape[1])))
                own = [x[i : i + each] for i in range(0, len(x), each)]
                sums = [[str(v) for v in b.astype(object).sum(axis=0)] for b in own]  # longs may overflow, Python's integers don't
                cols = [pa.array([b.tobytes() for b in own], pa.binary()), pa.array([len(b) for b in own], pa.int64()), pa.array(sums, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=["block", "n", "sums"])

        with arrow_batches(rows.sparkSession, 4096, 8):
            self.blocks = stage.put(rows.select("x").distinct().mapInArrow(pack, "block binary, n long, sums array<string>"), "fit")
        self.n = self.blocks.agg(F.sum("n")).first()[0] or 0
        by_place = self.blocks.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"))
        self.s = [int(r["s"]) for r in by_place.orderBy("i").collect()]  # as many as a vector has entries
        self.d, self.mean = len(self.s), np.array([v / max(1, self.n) for v in self.s])
        self.blocks = self.blocks.select("block")
        self.tasks = self.blocks.rdd.getNumPartitions()

    def total(self, of: object, size: int) -> np.ndarray:
        """The sum over all blocks of of(centred vectors), an array of `size` numbers."""
        d, mean = self.d, self.mean

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = np.zeros(size)
            for batch in batches:
                for block in batch.column(0):
                    own += of(np.frombuffer(block.as_buffer(), "<i8").reshape(-1, d) - mean).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([own], pa.list_(pa.float64()))], names=["part"])

        with arrow_batches(self.blocks.sparkSession, 64, 8):
            parts = self.blocks.mapInArrow(run, "part array<double>")
            if 8 * size * self.tasks <= DIRECT_BYTES:
                return np.sum([r["part"] for r in parts.collect()], axis=0)
            rows = parts.select(F.posexplode("part").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(size)
        for r in rows:
            out[r["i"]] = r["v"]
        return out

    def times(self, b: np.ndarray) -> np.ndarray:
        """V b."""
        return self.total(lambda c: c.T @ (c @ b), b.size).reshape(b.shape) / self.n

    def trace(self) -> float:
        return float(self.total(lambda c: np.array([(c * c).sum()]), 1)[0]) / self.n


def whiten(df: DataFrame, id_: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, seed: int = 0) -> DataFrame:
    """A row for each vector and component: the id, component (from 1, by falling eigenvalue), n, deviation, whitened,
    explained and identity_error."""
    spark, stage = df.sparkSession, Stage(df.sparkSession)
    kind = dict(df.dtypes)[id_]
    names = f"{id_} {kind}, component int, n long, deviation long, whitened double, explained double"
    try:
        rows = usable(df, id_, vector)
        fit = FitList(rows, stage)
        values, vectors = np.zeros(0), np.zeros((fit.d, 0))
        if fit.n > 1:
            values, vectors, _ = davidson.leading(fit.times, fit.d, components, seed)
            some = values > fit.d * davidson.EPS * max(values[0], 0)
            values, vectors = values[some], vectors[:, some]
        if not len(values):
            return spark.createDataFrame([], f"{names}, identity_error double")
        k, axes, explained = len(values), vectors / np.sqrt(values), values / fit.trace()
        middle = fit.total(lambda c: (c @ axes).sum(axis=0), k) / fit.n
        spread = fit.total(lambda c: ((z := c @ axes - middle).T @ z), k * k).reshape(k, k) / fit.n
        error = float(np.abs(spread - np.eye(k)).max())
        n, d, mean, sums, far = fit.n, fit.d, fit.mean, np.array(fit.s, dtype=object), max(map(abs, fit.s))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column(1))
                most = int(max(-int(x.min()), int(x.max()), 0))
                if d * (n * most + far) ** 2 < 2**63:  # then no step leaves the longs
                    off = ((n * x - sums.astype("i8")) ** 2).sum(axis=1).tolist()
                else:
                    off = [v if v < 2**63 else None for v in ((n * x.astype(object) - sums) ** 2).sum(axis=1)]
                z, m = (x - mean) @ axes, len(x)
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(m), k)))
                cols = [pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), m)), pa.array(np.full(m * k, n)), pa.array(off, pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(z.ravel()), pa.array(np.tile(explained, m))]
                yield pa.RecordBatch.from_arrays([ids, *cols], names=[id_, "component", "n", "deviation", "whitened", "explained"])

        with arrow_batches(spark, 4096, 8):
            return cut(rows.mapInArrow(run, names).withColumn("identity_error", F.lit(error)))
    finally:
        stage.drop()
