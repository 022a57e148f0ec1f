"""When a session was last seen, kept with its state, so that one that is idle too long can be forgotten."""

from __future__ import annotations

from typing import Any

from pyspark.sql.streaming import StatefulProcessorHandle


class Idle:
    """Without a limit nothing is kept. A batch's rows come before its timers, so rows must ask `over` as well."""

    def __init__(self, limit_ms: int | None):
        self.limit = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        if self.limit:
            self.handle, self.at = handle, handle.getValueState("seen", "at long")

    def over(self, timers: Any) -> bool:
        return bool(self.limit and self.at.exists() and timers.getCurrentProcessingTimeInMs() - self.at.get()[0] >= self.limit)

    def seen(self, timers: Any) -> None:
        if self.limit:
            now = timers.getCurrentProcessingTimeInMs()
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(now + self.limit)
            self.at.update((now,))

    def clear(self) -> None:
        self.at.clear()
