"""Keyed state of file events: one value a key, timers where a state is to go by itself.

Times are kept as microseconds, so a state is the same whatever the session's
time zone. A key's events of one micro-batch are sorted in its worker; what a
micro-batch holds is the source's choice (``maxFilesPerTrigger``,
``maxBytesPerTrigger``). State is a RocksDB store, checkpointed with the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Debounce(StatefulProcessor):
    """Accepts a key's first event and each that comes ``gap`` microseconds or more after the last accepted one.

    ``idle``: milliseconds without events after which a key's state goes; each
    batch with events sets the timer anew.
    """

    def __init__(self, gap: int, idle: int | None = None):
        self.gap, self.idle = gap, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us long, timer long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        last, timer = self.last.get() if self.last.exists() else (None, None)
        for us in sorted(r["us"] for r in rows if r["us"] is not None):
            if last is None or us >= last + self.gap:
                last = us
                yield Row(file=key[0], us=us)
        if last is None:
            return
        if self.idle is not None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle
            self.handle.registerTimer(timer)
        self.last.update((last, timer))

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


class Renames(StatefulProcessor):
    """Pairs a content's creation with the pending deletion before it, if it comes within ``gap`` microseconds.

    A later deletion takes the pending one's place, a creation ends it. ``wait``:
    milliseconds after which a pending deletion comes out alone, by a timer.
    """

    def __init__(self, gap: int, wait: int | None = None):
        self.gap, self.wait = gap, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "file string, us long, timer long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        held = self.pending.get() if self.pending.exists() else None
        before = held
        for us, kind, file in sorted((r["us"], r["kind"], r["file"]) for r in rows):
            if kind == "delete":
                held = (file, us, None)
            else:
                if held is not None and us <= held[1] + self.gap:
                    yield Row(hash=key[0], old_file=held[0], new_file=file, us=us)
                held = None
        if held == before:
            return
        if before is not None and before[2] is not None:
            self.handle.deleteTimer(before[2])
        if held is None:
            self.pending.clear()
            return
        timer = None
        if self.wait is not None:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.wait
            self.handle.registerTimer(timer)
        self.pending.update((held[0], held[1], timer))

    def handleExpiredTimer(self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        if self.pending.exists():
            file, us, timer = self.pending.get()
            if timer == expiredTimerInfo.getExpiryTimeInMs():
                self.pending.clear()
                yield Row(hash=key[0], old_file=file, new_file=None, us=us)

    def close(self) -> None:
        pass
