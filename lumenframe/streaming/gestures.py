"""Pointer gestures to regions of interest: a state machine for each session, in streams and in batches.

State: tool, drawing, points, anchor. Rows come in seq order; in a stream, a row whose seq is not above the session's last
one is late and only marked so (`sinks.routed` puts such rows elsewhere). A session that is idle for longer than idle_ms is
forgotten: its state goes, and its next row begins a new session, whatever its seq. A change of tool keeps a drawing that is under way; slice and orientation are those at the
end of the drawing. An escape ends all that went before it, so in a batch ESCAPES of them and what lies between are a group
of their own: a long session is spread, and only what one person does without an escape has to fit a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lumenframe.streaming.idle import Idle

OUT = "session_id long, seq long, event string, roi_type string, slice_index long, orientation int, n_points int, xs array<double>, ys array<double>, zs array<double>"
STATE = "tool string, drawing boolean, xs array<double>, ys array<double>, zs array<double>, ax double, ay double, az double, seq long"
_COLUMNS = [c.split(" ")[0] for c in OUT.split(", ")]
_OUT = Row(*_COLUMNS)
SIDES = 64
_ROUND = [(math.cos(2 * math.pi * i / SIDES), math.sin(2 * math.pi * i / SIDES)) for i in range(SIDES)]
ESCAPES = 256  # that end the rows of one group
Point = tuple[float, float, float]


def square(p: Point, q: Point) -> list[Point]:
    dx, dy = q[0] - p[0], q[1] - p[1]
    side = min(abs(dx), abs(dy))
    x, y = p[0] + math.copysign(side, dx or 1.0), p[1] + math.copysign(side, dy or 1.0)
    return [p, (x, p[1], p[2]), (x, y, p[2]), (p[0], y, p[2])]


def oval(p: Point, q: Point) -> list[Point]:
    (cx, cy, cz), rx, ry = ((a + b) / 2 for a, b in zip(p, q)), abs(q[0] - p[0]) / 2, abs(q[1] - p[1]) / 2
    return [(cx + rx * c, cy + ry * s, cz) for c, s in _ROUND]


BUILD = {"rectangle": square, "ellipse": oval}


class Drawing:
    """One session's state; `step` takes a row and gives (event, points) for finished and cancelled drawings."""

    def __init__(self, tool: str = "none", drawing: bool = False, points: list[Point] | None = None, anchor: Point | None = None, seq: int = -1):
        self.tool, self.drawing, self.points, self.anchor, self.seq = tool, drawing, points or [], anchor, seq

    def _end(self, event: str) -> tuple[str, str, list[Point]] | None:
        tool, points = self.tool, self.points
        self.drawing, self.points, self.anchor = False, [], None
        if event == "cancelled":
            self.tool = "none"
            return event, tool, []
        return ("roi", tool, points) if len(points) >= 2 else None

    def step(self, kind: str, tool: str, at: Point) -> tuple[str, str, list[Point]] | None:
        if kind == "tool":
            self.tool = tool
        elif kind == "escape":
            return self._end("cancelled")
        elif kind == "left_press" and self.tool == "freehand":
            self.drawing, self.points = True, [at]
        elif kind == "left_press" and self.tool == "polygon":
            self.points = [*self.points, at] if self.drawing else [at]
            self.drawing = True
        elif kind == "left_press" and self.tool in BUILD:
            self.drawing, self.anchor, self.points = True, at, [at]
        elif not self.drawing:
            return None
        elif kind == "move" and self.tool == "freehand":
            self.points.append(at)
        elif kind == "move" and self.tool in BUILD and self.anchor:
            self.points = BUILD[self.tool](self.anchor, at)
        elif kind == "left_release" and self.tool == "freehand":
            return self._end("roi")
        elif kind == "left_release" and self.tool in BUILD:
            if not self.anchor or self.anchor == at:  # another tool began the drawing, or it has no size
                return self._end("cancelled")
            self.points = BUILD[self.tool](self.anchor, at)
            return self._end("roi")
        elif kind == "right_press" and self.tool == "polygon":
            return self._end("roi" if len(self.points) >= 3 else "cancelled")
        return None


def advance(state: Drawing, session: int, rows: Iterable[Any]) -> list[tuple]:
    """Rows in order of seq; a place that is null is nowhere, as NaN."""
    out = []
    for r in rows:
        if r.seq <= state.seq:
            out.append((session, r.seq, "late", None, r.slice_index, r.orientation, 0, [], [], []))
            continue
        state.seq = r.seq
        done = state.step(r.kind, r.tool, tuple(math.nan if c is None else c for c in (r.x, r.y, r.z)))
        if done:
            event, tool, points = done
            xs, ys, zs = (list(c) for c in zip(*points)) if points else ([], [], [])
            out.append((session, r.seq, event, tool, r.slice_index, r.orientation, len(points), xs, ys, zs))
    return out


def batch(gestures: DataFrame) -> DataFrame:
    """gestures(session_id, seq, kind, tool, x, y, z, slice_index, orientation) -> OUT."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(advance(Drawing(), int(key[0]), pdf.sort_values("seq", kind="stable").itertuples(index=False)), columns=_COLUMNS)

    before = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = gestures.withColumn("_part", F.floor(F.count(F.when(F.col("kind") == "escape", 1)).over(before) / ESCAPES))
    return rows.groupBy("session_id", "_part").applyInPandas(run, OUT)


class DrawingProcessor(StatefulProcessor):
    def __init__(self, idle_ms: int | None = None):
        self.idle = Idle(idle_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("drawing", STATE)
        self.idle.init(handle)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        s = Drawing()
        if not self.idle.over(timerValues) and (known := self.state.get()) is not None:
            tool, drawing, xs, ys, zs, ax, ay, az, seq = known
            s = Drawing(tool, drawing, list(zip(xs, ys, zs)), None if ax is None else (ax, ay, az), seq)
        out = advance(s, int(key[0]), sorted(rows, key=lambda r: r.seq))
        xs, ys, zs = (list(c) for c in zip(*s.points)) if s.points else ([], [], [])
        self.state.update((s.tool, s.drawing, xs, ys, zs, *(s.anchor or (None, None, None)), int(s.seq)))
        self.idle.seen(timerValues)
        return (_OUT(*r) for r in out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        if self.idle.over(timerValues):
            self.state.clear()
            self.idle.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream(gestures: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """The same on a stream; needs the RocksDB state store. With a limit there are timers, so the query goes on until it is
    stopped, whatever its trigger, unless that is `once`."""
    return gestures.groupBy("session_id").transformWithState(DrawingProcessor(idle_ms), OUT, "Append", "ProcessingTime" if idle_ms else "None")
