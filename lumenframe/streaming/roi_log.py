"""An edit log to the current ROI table and its change feed, on streams.

Each session keeps its live ROIs with type, name, colour and points, its counters and its selection; a micro-batch's rows
are applied in seq order. What listeners would be told is emitted row by row; what the batch changes in the table follows
once for each ROI: a `row` event with the whole ROI as the batch leaves it, or `gone`. So a drag of a thousand steps within a
batch writes its ROI once. Late rows (seq not above the last one) are marked and not applied; `sinks.routed` puts them
elsewhere. A session that is idle for longer than idle_ms is forgotten: its state goes, and its next row begins a new session,
whose ids start at 1 again; its rows in the table stay until those ids come again.

A worker pays for each cell that it takes in and for each row that it gives, so a log row reaches it as one JSON text, and what a
session tells comes back as lists of up to TOLD events. ROIs are kept in entries of LIVE ids each.

`listeners` leaves the table's events out, `current` turns a feed into the table; `sinks.RoiTable` keeps the table up to date.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenframe.operators.rois import PALETTE
from lumenframe.streaming.idle import Idle

ROW = "roi_type string, name string, color array<double>, xs array<double>, ys array<double>, zs array<double>"
OUT = f"session_id long, seq long, no int, event string, roi_id long, {ROW}, selected boolean"
_OUT = Row("told")
Roi = tuple  # type, name, colour, xs, ys, zs
LIVE = 64  # ids whose ROIs are one entry of a session's state
TOLD = 1_000  # events, at most, that leave a worker as one row
Number = float | None


class Edit:
    """A log row from its JSON, in which nulls are left out; NaN and infinities are strings there."""

    op = roi_id = roi_type = has_color = tool = name = idx = ex = ey = xs = ys = zs = None

    def __init__(self, text: str):
        self.__dict__.update(json.loads(text))


def _number(v: Any) -> Number:
    return None if v is None else float(v)


def _plus(a: Number, b: Number) -> Number:
    return None if a is None or b is None else a + b


class RoiStore:
    """One session: live ROIs by id, the next id, colours given, the selection, the last seq."""

    def __init__(self, live: dict[int, Roi] | None = None, next_id: int = 1, colors: int = 0, selected: int | None = None, seq: int = -1):
        self.live, self.next_id, self.colors, self.selected, self.seq = live or {}, next_id, colors, selected, seq
        self.touched: set[int] = set()  # ROIs whose row in the table may have changed

    def _choose(self, roi: int | None) -> None:
        self.touched |= {x for x in (self.selected, roi) if x is not None}
        self.selected = roi

    def _add(self, r: Any) -> int:
        own, self.next_id = self.next_id, self.next_id + 1
        color = None
        if r.has_color == 0:
            color, self.colors = list(PALETTE[self.colors % len(PALETTE)]), self.colors + 1
        n = 1 + sum(kind == r.roi_type for kind, *_ in self.live.values())
        self.live[own] = (r.roi_type, f"{(r.roi_type or '').capitalize()} {n}", color, *([_number(v) for v in c or ()] for c in (r.xs, r.ys, r.zs)))
        return own

    def _edit(self, roi: int, r: Any) -> bool | None:
        """None: nothing is changed; else whether a vertex came or went."""
        kind, name, color, *p = self.live[roi]
        xs, ys, zs = map(list, p)
        ex, ey = _number(r.ex), _number(r.ey)
        inside = r.idx is not None and 0 <= r.idx < len(xs) if r.op != "translate" else True
        if r.op == "translate":
            xs, ys = [_plus(x, ex) for x in xs], [_plus(y, ey) for y in ys]
        elif r.op == "insert":
            for c, v in ((xs, ex), (ys, ey), (zs, 0.0)):
                c.insert(len(c) if r.idx is None else int(r.idx) + 1, v)
        elif not inside or r.op == "delete" and len(xs) <= 3:
            return None
        elif r.op == "update":
            xs[int(r.idx)], ys[int(r.idx)], zs[int(r.idx)] = ex, ey, 0.0
        else:
            for c in (xs, ys, zs):
                c.pop(int(r.idx))
        self.live[roi] = (kind, name, color, xs, ys, zs)
        return r.op in ("insert", "delete")

    def apply(self, r: Any) -> list[tuple[str, int | None]]:
        """(event, roi) of a log row."""
        op, roi = r.op, r.roi_id
        if op == "add":
            own = self._add(r)
            self.touched.add(own)
            return [("added", own), ("changed", None)]
        if op == "clear":
            self._choose(None)
            self.live.clear()
            return [("selection", None), ("changed", None)]
        if op == "tool":
            if r.tool == "edit":
                return []
            self._choose(None)
            return [("selection", None)]
        if op == "select":
            self._choose(roi)
            return [("selection", roi)]
        if op == "remove":
            out: list[tuple[str, int | None]] = []
            if roi is not None and roi == self.selected:
                self._choose(None)
                out.append(("selection", None))
            if self.live.pop(roi, None) is not None:
                out += [("removed", roi), ("changed", None)]
            return out
        if roi not in self.live:
            return []
        if op == "rename":
            name = (r.name or "").strip(" ")
            if not name:
                return []
            self.live[roi] = (self.live[roi][0], name, *self.live[roi][2:])
            self.touched.add(roi)
            return [("changed", None)]
        if op in ("update", "translate", "insert", "delete"):
            told = self._edit(roi, r)
            if told is not None:
                self.touched.add(roi)
            return [("changed", None)] if told else []
        return []


class LogProcessor(StatefulProcessor):
    def __init__(self, idle_ms: int | None = None):
        self.idle = Idle(idle_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.live = handle.getMapState("live", "part long", f"rois array<struct<roi_id long, {ROW}>>")
        self.head = handle.getValueState("head", "next_id long, colors long, selected long, seq long")
        self.idle.init(handle)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        s, out = RoiStore(), []
        if self.idle.over(timerValues):
            self.live.clear()
        elif (head := self.head.get()) is not None:
            s.next_id, s.colors, s.selected, s.seq = head
            s.live = {r[0]: tuple(r[1:]) for _, (part,) in self.live.iterator() for r in part}
        before, no = dict(s.live), 0
        for r in sorted((Edit(r.edit) for r in rows), key=lambda r: r.seq):
            if r.seq <= s.seq:
                out.append((int(key[0]), r.seq, 0, "late", None, *[None] * 7))
                continue
            s.seq = int(r.seq)
            for no, (event, roi) in enumerate(s.apply(r)):
                out.append((int(key[0]), r.seq, no, event, roi, *((r.roi_type, *[None] * 6) if event == "added" else [None] * 7)))
        for roi in sorted(before.keys() - s.live.keys()):
            out.append((int(key[0]), s.seq, 9, "gone", roi, *[None] * 7))
        for roi in sorted(s.touched & s.live.keys()):
            out.append((int(key[0]), s.seq, 9, "row", roi, *s.live[roi], roi == s.selected))
        self._keep(before, s.live)
        self.head.update((s.next_id, s.colors, s.selected, s.seq))
        self.idle.seen(timerValues)
        return (_OUT(tuple(out[i : i + TOLD])) for i in range(0, len(out), TOLD))

    def _keep(self, before: dict[int, Roi], live: dict[int, Roi]) -> None:
        """Writes the entries in which a ROI came, went or was edited; an edit makes a new tuple."""
        parts = {roi // LIVE: [] for roi in before.keys() | live.keys() if before.get(roi) is not live.get(roi)}
        for roi, row in live.items():
            if roi // LIVE in parts:
                parts[roi // LIVE].append((roi, *row))
        for part, rois in parts.items():
            if rois:
                self.live.updateValue((part,), (rois,))
            else:
                self.live.removeKey((part,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.idle.over(timerValues):
            self.live.clear()
            self.head.clear()
            self.idle.clear()
        return iter(())

    def close(self) -> None:
        pass


def changes(log: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """log(session_id, seq, op, roi_id, roi_type, has_color, tool, name, idx, ex, ey, points) as a stream -> OUT; needs the
    RocksDB state store. With a limit there are timers, so the query goes on until it is stopped, unless its trigger is `once`."""
    at = lambda c: F.transform("points", lambda p: p[c]).alias(f"{c}s")
    edit = F.to_json(F.struct("seq", "op", "roi_id", "roi_type", "has_color", "tool", "name", "idx", "ex", "ey", *map(at, "xyz")))
    edits = log.select("session_id", edit.alias("edit")).groupBy("session_id")
    return edits.transformWithState(LogProcessor(idle_ms), f"told array<struct<{OUT}>>", "Append", "ProcessingTime" if idle_ms else "None").select(F.inline("told"))


def listeners(feed: DataFrame) -> DataFrame:
    """What listeners are told."""
    return feed.filter(~F.col("event").isin("row", "gone", "late")).select("session_id", "seq", "no", "event", "roi_id")


def shaped(rows: DataFrame) -> DataFrame:
    """The table's columns, points as structs, of rows with xs, ys and zs."""
    points = F.transform(F.arrays_zip("xs", "ys", "zs"), lambda p: F.struct(p["xs"].alias("x"), p["ys"].alias("y"), p["zs"].alias("z")))
    return rows.select("session_id", "roi_id", "roi_type", "name", "color", points.alias("points"), "selected")


def current(feed: DataFrame) -> DataFrame:
    """The table after a feed: session_id, roi_id, roi_type, name, color, points, selected."""
    whole = F.struct("event", "roi_type", "name", "color", "xs", "ys", "zs", "selected")
    rows = feed.filter("event IN ('row', 'gone')").groupBy("session_id", "roi_id").agg(F.max_by(whole, "seq").alias("r"))
    return shaped(rows.filter("r.event = 'row'").select("session_id", "roi_id", "r.*"))
