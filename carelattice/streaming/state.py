"""Keyed state over streams: one job for each key, actions of alarms and jobs, acknowledgements."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.machines import ALARM_MOVES
from .retries import KEEP_SECONDS, clock, timed


def first_of_key(stream: DataFrame, key: str, time_col: str, within: str = "1 day") -> DataFrame:
    """The first row of each key; keys are forgotten ``within`` after they were last needed, so state stays bounded."""
    return stream.withWatermark(time_col, within).dropDuplicatesWithinWatermark([key])


class Actions(StatefulProcessor):
    """The machine of one key: its status and counts, the occurrence that comes next, and a timer after which it is forgotten."""

    def __init__(self, key: str, order: str, action: str, moves: dict[str, dict[str, str]], start: str, most_retries: int | None, keep: int, event_time: bool):
        self.key, self.order, self.action, self.moves, self.start, self.most = key, order, action, moves, start, most_retries
        self.keep, self.event_time = 1000 * keep, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("machine", "status string, applied int, refused int, retries int, skipped int, forget long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, applied, refused, retries, skipped, forget = self.state.get() if self.state.exists() else (self.start, 0, 0, 0, 0, 0)
        own = pd.concat(list(rows)).sort_values(self.order)
        for a in own[self.action]:
            after = self.moves.get(a, {}).get(status)
            retries += after is not None and a == "RETRYABLE"
            skipped += after is not None and a == "SKIP"
            if self.most is not None and after == "RETRY_WAITING" and retries > self.most:
                after = "FAILED"
            status, applied, refused = after or status, applied + (after is not None), refused + (after is None)
        until = clock(timerValues, self.event_time, own) + self.keep
        if until > forget:
            if forget:
                self.handle.deleteTimer(forget)
            self.handle.registerTimer(until)
        self.state.update((status, applied, refused, retries, skipped, max(until, forget)))
        yield pd.DataFrame({self.key: [key[0]], "status": [status], "applied": [applied], "refused": [refused], "retries": [retries], "skipped": [skipped]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def run_actions(
    stream: DataFrame, key: str, order: str, action: str, moves: dict[str, dict[str, str]] | None = None, start: str = "ACTIVE",
    most_retries: int | None = None, keep_seconds: int = KEEP_SECONDS, time_col: str | None = None, late: str = "0 seconds",
) -> DataFrame:
    """Status of each key after each batch of its actions: key, status, applied, refused, retries, skipped.

    The same table of moves and of retries as the batch fold; ``skipped`` occurrences become times by ``machines.after_skips``. Within a batch
    actions are taken in ``order``. A key that reaches a status without a way out keeps its state, so that later actions are refused, until
    ``keep_seconds`` have passed on the stream's clock (processing time, or ``time_col``'s watermark) since the last of them; then it is
    forgotten and would begin anew. So the state holds the keys of that span only. The session's state store must be
    ``retries.STATE_STORE``. Without ``time_col`` the stream needs a processing-time trigger: its timers have no end.
    """
    rows = timed(stream, time_col, late)
    processor = Actions(key, order, action, moves or ALARM_MOVES, start, most_retries, keep_seconds, time_col is not None)
    out = f"{key} {stream.schema[key].dataType.simpleString()}, status string, applied int, refused int, retries int, skipped int"
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="update", timeMode="EventTime" if time_col else "ProcessingTime")


class Acknowledgements(StatefulProcessor):
    """Whether a key was sent and delivered, forgotten a while after the last word of it."""

    def __init__(self, key: list[str], order: str, kind: str, keep: int, event_time: bool):
        self.key, self.order, self.kind, self.keep, self.event_time = key, order, kind, 1000 * keep, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("delivery", "sent boolean, done boolean, forget long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sent, done, forget = self.state.get() if self.state.exists() else (False, False, 0)
        found, own = [], pd.concat(list(rows)).sort_values(self.order)
        for row in own.to_dict("records"):
            if row[self.kind] == "SENT":
                sent = True
            elif row[self.kind] == "DELIVERED" and sent and not done:
                done = True
                found.append(row[self.order])
        until = clock(timerValues, self.event_time, own) + self.keep
        if until > forget:
            if forget:
                self.handle.deleteTimer(forget)
            self.handle.registerTimer(until)
        self.state.update((sent, done, max(until, forget)))
        if found:
            yield pd.DataFrame([(*key, x) for x in found], columns=[*self.key, "delivered"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def acknowledged(stream: DataFrame, key: list[str], order: str, kind: str = "event_type", keep_seconds: int = KEEP_SECONDS, time_col: str | None = None, late: str = "0 seconds") -> DataFrame:
    """Deliveries accepted: the first DELIVERED of each key after a SENT, once. A key is forgotten ``keep_seconds`` after its last event."""
    rows = timed(stream, time_col, late)
    kinds = {n: stream.schema[n].dataType.simpleString() for n in (*key, order)}
    out = ", ".join([*(f"{n} {kinds[n]}" for n in key), f"delivered {kinds[order]}"])
    processor = Acknowledgements(key, order, kind, keep_seconds, time_col is not None)
    return rows.groupBy(*key).transformWithStateInPandas(statefulProcessor=processor, outputStructType=out, outputMode="append", timeMode="EventTime" if time_col else "ProcessingTime")
