"""Packing documents into sequences of a fixed number of tokens: best fit, then local search by swaps.

A document is its ids and an end id; only longer ones are cut, from the end, so that the first piece is the shorter one.
Pieces that fill a sequence are done. The others are dealt into groups of about GROUP pieces, and each group is packed by
best fit, largest first. Then underfull sequences exchange pieces: one moves, or one goes for one, two for one or one for
two, so that the fuller sequence gains as much as its gap allows. Each exchange raises the sum of squared fills, so the
search ends, and it drains the emptiest sequences until they are gone. Rounds of new groups follow, of the sequences that are
still underfull, until these fit into one group or a round empties none. A group's rows are all that a task holds.

Documents without text are their end id. Rows that repeat are packed as often as they are; doc_id may be null or repeat; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bpe
from .common import Stage, cut

CAPACITY, END, GROUP, ROUNDS = 1024, 2, 20_000, 12


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of docs (doc_id, text)."""
    tail = np.array([end], dtype="<u4").tobytes()

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        crcs, sizes = [], []
        for ids in pdf["ids"]:
            whole = memoryview(ids + tail)
            n, step = len(whole) // 4, 4 * capacity
            first = 4 * ((n - 1) % capacity + 1)
            crcs.append([zlib.crc32(whole[:first]), *(zlib.crc32(whole[i : i + step]) for i in range(first, len(whole), step))])
            sizes.append(n)
        return pdf.drop(columns="ids").assign(_n=sizes, _crcs=crcs)

    fields = [T.StructField("_n", T.LongType()), T.StructField("_crcs", T.ArrayType(T.LongType()))]
    done = bpe.encode(docs.select("doc_id", "text"), path, finish=(sums, fields))
    first = (F.col("_n") - 1) % capacity + 1
    rows = done.select("doc_id", first.alias("first"), F.posexplode("_crcs").alias("piece", "ids_crc32"))
    start = F.when(F.col("piece") == 0, 0).otherwise(F.col("first") + (F.col("piece") - 1) * capacity)
    return rows.select("doc_id", "piece", start.cast("long").alias("start"), F.when(F.col("piece") == 0, F.col("first")).otherwise(capacity).cast("long").alias("length"), "ids_crc32")


def best_fit(lengths: Iterable[int], capacity: int) -> list[list[int]]:
    """Places in `lengths` by sequence, largest first, each where it leaves least."""
    lengths = list(lengths)
    bins: list[list[int]] = []
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps = 0  # bit g: a sequence with gap g is there
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = gaps >> lengths[i]
        if fits:
            gap = lengths[i] + (fits & -fits).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                gaps ^= 1 << gap
            bins[b].append(i)
        else:
            gap, b = capacity, len(bins)
            bins.append([i])
        by_gap[gap - lengths[i]].append(b)
        gaps |= 1 << gap - lengths[i]
    return bins


class Search:
    """Local search over the underfull ones of some sequences. For each length that a sequence can give, of one piece or of
    two, the sequences that can give it, emptiest first."""

    def __init__(self, lengths: list[int], bins: list[list[int]], capacity: int):
        self.size, self.capacity = lengths, capacity
        self.bins = [list(b) for b in bins]
        self.fill = [sum(lengths[i] for i in b) for b in self.bins]
        self.age = [0] * len(self.bins)  # entries of an earlier age are stale
        self.offers: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.masks = [0, 0]
        for b in range(len(self.bins)):
            self._offer(b)

    def options(self, b: int) -> tuple[dict[int, tuple[int, ...]], dict[int, tuple[int, ...]]]:
        """What b can give: by its length, one piece, and two."""
        one = {self.size[i]: i for i in self.bins[b]}
        two: dict[int, tuple[int, ...]] = {}
        twice: dict[int, int] = {}
        for i in self.bins[b]:
            if one[self.size[i]] != i:
                twice[self.size[i]] = i
        own = sorted(one)
        for k, x in enumerate(own):
            if x in twice:
                two[2 * x] = (one[x], twice[x])
            for y in own[k + 1 :]:
                two[x + y] = (one[x], one[y])
        return {x: (i,) for x, i in one.items()}, two

    def _offer(self, b: int) -> None:
        self.age[b] += 1
        if not 0 < self.fill[b] < self.capacity:
            return
        for kind, own in enumerate(self.options(b)):
            for x in own:
                heapq.heappush(self.offers[kind].setdefault(x, []), (self.fill[b], b, self.age[b]))
                self.masks[kind] |= 1 << x

    def _donor(self, kind: int, x: int, a: int) -> int | None:
        """The emptiest other sequence that can give x."""
        heap, own = self.offers[kind].get(x, []), None
        while heap:
            fill, b, age = heap[0]
            if age != self.age[b]:
                heapq.heappop(heap)
            elif b == a:
                own = heapq.heappop(heap)
            else:
                break
        found = heap[0][1] if heap else None
        if own:
            heapq.heappush(heap, own)
        if not heap:
            self.masks[kind] &= ~(1 << x)
        return found

    def step(self, a: int) -> bool:
        """The exchange by which a gains most, if there is any that raises the sum of squares."""
        gap = self.capacity - self.fill[a]
        best = (0,)
        if not 0 < gap < self.capacity:
            return False
        one, two = self.options(a)
        for give, kinds in [({0: ()}, (0,)), (one, (0, 1)), (two, (0,))]:
            for y, out in give.items():
                for kind in kinds:
                    wanted = (self.masks[kind] >> (y + 1)) & ((1 << gap) - 1)
                    while wanted and (gain := wanted.bit_length()) > best[0]:
                        wanted ^= 1 << (gain - 1)
                        b = self._donor(kind, y + gain, a)
                        if b is not None and self.fill[a] + gain > self.fill[b]:
                            best = (gain, b, kind, out)
                            break
                if best[0] == gap:
                    break
        if not best[0]:
            return False
        gain, b, kind, out = best
        back = self.options(b)[kind][sum(self.size[i] for i in out) + gain]
        self.bins[a] = [i for i in self.bins[a] if i not in out] + list(back)
        self.bins[b] = [i for i in self.bins[b] if i not in back] + list(out)
        self.fill[a] += gain
        self.fill[b] -= gain
        self._offer(a)
        self._offer(b)
        return True

    def run(self) -> list[list[int]]:
        """Exchanges until none is left that raises the sum of squares; the sequences that are not empty. Sequences of the
        same lengths are alike: what one of them lacks in a pass, the others lack too. The last pass changes nothing, so it
        answers for all."""
        moved = True
        while moved:
            moved, stuck = False, set()
            for a in sorted((b for b in range(len(self.bins)) if 0 < self.fill[b] < self.capacity), key=lambda b: -self.fill[b]):
                while (kind := tuple(sorted(self.size[i] for i in self.bins[a]))) not in stuck and self.step(a):
                    moved = True
                stuck.add(kind)
        return [b for b in self.bins if b]


def pack(lengths: list[int], capacity: int = CAPACITY, bins: list[list[int]] | None = None) -> list[list[int]]:
    """Places in `lengths` by sequence; from the sequences given, or from best fit."""
    return Search(lengths, best_fit(lengths, capacity) if bins is None else bins, capacity).run()


def place(items: DataFrame, stage: Stage, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """sequence_id and offset for items (pid, length), pid being unique; lengths from 1 to capacity."""
    out = "pid long, length long, sequence_id long, offset long, fill long"

    def run_of(turn: int):  # noqa: ANN202
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["sequence_id", "pid"], ignore_index=True)  # a group's rows come in any order
            sizes_of = pdf["length"].to_numpy()
            bins = pack(sizes_of.tolist(), capacity, list(pdf.groupby("sequence_id", sort=True).indices.values()) if turn else None)
            at = np.concatenate([np.asarray(b, dtype=int) for b in bins])
            sizes = [sizes_of[b] for b in bins]
            fills = np.array([s.sum() for s in sizes])
            each = [len(b) for b in bins]
            offset = np.concatenate([np.cumsum(s) - s for s in sizes])
            name = (turn << 56 | int(key[0]) << 24) + np.repeat(np.arange(len(bins)), each)
            return pd.DataFrame({"pid": pdf["pid"].to_numpy()[at], "length": np.concatenate(sizes), "sequence_id": name, "offset": offset, "fill": np.repeat(fills, each)})

        return run

    full = items.filter(F.col("length") >= capacity).select("pid", "length", (-1 - F.col("pid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = items.filter(F.col("length") < capacity).select("pid", "length", F.col("pid").alias("sequence_id"))
    done, n, bins = [full], left.count(), None
    for turn in range(ROUNDS):
        if not n:
            break
        groups = -(-n // group)
        dealt = left.withColumn("g", F.pmod(F.xxhash64(F.lit(turn), "sequence_id"), F.lit(groups)))
        packed = stage.put(dealt.groupBy("g").applyInPandas(run_of(turn), out), f"round{turn}")
        open_ = packed.filter(F.col("fill") < capacity)
        now = open_.agg(F.count("*"), F.coalesce(F.sum(F.col("length") / F.col("fill")), F.lit(0.0))).first()  # pieces, sequences
        last = groups == 1 or (bins is not None and round(now[1]) >= bins) or turn == ROUNDS - 1
        done.append((packed if last else packed.filter(F.col("fill") == capacity)).drop("fill"))
        if last:
            break
        n, bins, left = now[0], round(now[1]), open_.select("pid", "length", "sequence_id")
    rows = done[0]
    for x in done[1:]:
        rows = rows.union(x)
    return rows.drop("length")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for docs (doc_id, text)."""
    stage = Stage(docs.sparkSession)
    try:
        rows = stage.put(pieces(docs, path, capacity, end).select(F.monotonically_increasing_id().alias("pid"), "*"), "pieces")
        placed = place(rows.select("pid", "length"), stage, capacity, group)
        return cut(rows.join(placed, "pid").drop("pid"))
    finally:
        stage.drop()
