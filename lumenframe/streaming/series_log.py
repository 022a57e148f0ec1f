"""A log of loads and adds to the series that each session takes in, on streams.

A session's state is its loads so far and the folders it holds. An add of a folder that is held does nothing; a load clears
what is held and takes in its own folder. A micro-batch's rows are applied in seq order; rows whose seq is not above the
session's last one are late, and only marked so (see `sinks.routed`).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenframe.streaming.idle import Idle

OUT = "session_id long, seq long, event string, epoch long, folder string"
_OUT = Row(*(c.split(" ")[0] for c in OUT.split(", ")))


class LoadProcessor(StatefulProcessor):
    def __init__(self, idle_ms: int | None = None):
        self.idle = Idle(idle_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "folder string", "seq long")
        self.head = handle.getValueState("head", "epoch long, seq long")
        self.idle.init(handle)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        epoch, last, out = 0, None, []
        if self.idle.over(timerValues):
            self.held.clear()
        elif (head := self.head.get()) is not None:
            epoch, last = head
        held = {k[0] for k, _ in self.held.iterator()} if last is not None else set()
        new: dict[str, int] = {}
        cleared = False
        for r in sorted(rows, key=lambda r: r.seq):
            if last is not None and r.seq <= last:
                out.append((int(key[0]), r.seq, "late", None, r.folder))
                continue
            last = int(r.seq)
            if r.op == "load":
                epoch, held, new, cleared = epoch + 1, set(), {}, True
            if r.folder not in held:
                held.add(r.folder)
                new[r.folder] = last
                out.append((int(key[0]), last, "added", epoch, r.folder))
        if cleared:
            self.held.clear()
        for folder, seq in new.items():
            self.held.updateValue((folder,), (seq,))
        self.head.update((epoch, last))
        self.idle.seen(timerValues)
        return (_OUT(*r) for r in out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.idle.over(timerValues):
            self.held.clear()
            self.head.clear()
            self.idle.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream(loads: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """loads(session_id, seq, op, folder) as a stream -> OUT; needs the RocksDB state store. For idle_ms see `gestures.stream`."""
    rows = loads.select("session_id", "seq", "op", "folder")
    return rows.groupBy("session_id").transformWithState(LoadProcessor(idle_ms), OUT, "Append", "ProcessingTime" if idle_ms else "None")
