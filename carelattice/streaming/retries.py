"""Messages that stay pending over batches: attempts, idle time, dead letters.

Messages are dealt to buckets by the hash of their identifier, and each bucket is a key of a stateful operator, so that the
state is read, written and timed once a bucket and batch instead of once a message. A failed message stays in its bucket until
its idle time is over, and the bucket has one timer, for the earliest of its messages; the timer's batch tries
them again. What was answered for good is remembered for a
while, so that a message that is delivered twice isn't worked on twice, and is then forgotten, so the
state holds the messages of that span only. State and timers are in the checkpoint and survive restarts and lost
executors.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .index_jobs import MOST_ATTEMPTS, contract, dead_letters

#: Seconds that a failed message waits, and that an answered one is remembered.
IDLE_SECONDS, KEEP_SECONDS = 60, 24 * 3600
#: Keys of the state. A batch rewrites the buckets that its messages fall into; a started stream must keep their number.
BUCKETS = 256
#: The state store that keyed state with timers needs.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOME = "message_id string, outcome string, attempt int, fields map<string, string>, failure_type string, failure_message string"

Attempt = Callable[[str, dict, int], None]


def clock(timer_values, event_time: bool, rows: pd.DataFrame | None = None) -> int:
    """Milliseconds of the stream's clock: the batch's processing time, or the watermark, but never before the ``rows`` that have come."""
    if not event_time:
        return timer_values.getCurrentProcessingTimeInMs()
    own = rows["clock_ms"].max() if rows is not None else None
    return max(timer_values.getCurrentWatermarkInMs(), 0 if own is None or pd.isna(own) else int(own))


def timed(stream: DataFrame, time_col: str | None, late: str) -> DataFrame:
    """``stream`` with a watermark, and the milliseconds of its time as ``clock_ms``, if it has a time."""
    return stream.withWatermark(time_col, late).withColumn("clock_ms", F.unix_millis(F.col(time_col))) if time_col else stream


class Attempts(StatefulProcessor):
    """Works on the messages of a bucket when they arrive and whenever their idle time has passed, ``most`` times at most."""

    def __init__(self, attempt: Attempt, most: int, idle: int, keep: int, event_time: bool):
        self.attempt, self.most, self.idle, self.keep, self.event_time = attempt, most, 1000 * idle, 1000 * keep, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # pending: {message_id: [attempts, due, fields]}, answered: {message_id: due}, as JSON.
        self.state = handle.getValueState("messages", "pending string, answered string, timer long")

    def _read(self) -> tuple[dict, dict, int | None]:
        pending, answered, timer = self.state.get() or ("{}", "{}", None)
        return json.loads(pending), json.loads(answered), timer

    def _write(self, pending: dict, answered: dict, timer: int | None) -> None:
        """Keep the bucket, with a timer for what is due first; ``timer`` is the one that it has."""
        due = min(min((m[1] for m in pending.values()), default=math.inf), min(answered.values(), default=math.inf))
        if due == math.inf:
            self.state.clear()
            return
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        self.state.update((json.dumps(pending), json.dumps(answered), due))

    def _try(self, message_id: str, fields: dict, number: int, now: int, pending: dict, answered: dict) -> tuple:
        kind = text = None
        try:
            self.attempt(message_id, fields, number)
        except Exception as error:
            kind, text = type(error).__name__, str(error)
        outcome = "done" if kind is None else "pending" if number < self.most else "dead"
        if outcome == "pending":
            pending[message_id] = [number, now + self.idle, fields]
        else:
            pending.pop(message_id, None)
            answered[message_id] = now + self.keep
        return message_id, outcome, number, fields, kind, text

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pending, answered, timer = self._read()
        now = clock(timerValues, self.event_time)
        for batch in rows:
            found = []
            times = batch["clock_ms"].fillna(0).astype("int64") if self.event_time else [0] * len(batch)
            for message_id, fields, valid, own in zip(batch["message_id"], batch["fields"], batch["valid"], times, strict=True):
                if message_id in pending or message_id in answered:
                    continue
                if valid:
                    found.append(self._try(message_id, dict(fields), 1, max(now, own), pending, answered))
                else:
                    answered[message_id] = max(now, own) + self.keep
                    found.append((message_id, "rejected", 0, dict(fields) if fields is not None else {}, None, None))
            if found:
                yield _rows(found)
        self._write(pending, answered, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        pending, answered, _ = self._read()
        now = clock(timerValues, self.event_time)
        answered = {name: due for name, due in answered.items() if due > now}
        again = [(name, number, fields) for name, (number, due, fields) in pending.items() if due <= now]
        if again:
            yield _rows([self._try(name, fields, number + 1, now, pending, answered) for name, number, fields in again])
        self._write(pending, answered, None)  # Spark deletes the timer that has expired

    def close(self) -> None:
        pass


def _rows(found: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(found, columns=["message_id", "outcome", "attempt", "fields", "failure_type", "failure_message"])


def attempts(
    messages: DataFrame, attempt: Attempt, valid=None, most: int = MOST_ATTEMPTS, idle_seconds: int = IDLE_SECONDS, keep_seconds: int = KEEP_SECONDS, time_col: str | None = None, late: str = "0 seconds",
    buckets: int = BUCKETS,
) -> DataFrame:
    """The outcome of every attempt at the messages of a stream: OUTCOME, outcome being done, pending, dead or rejected.

    ``attempt(message_id, fields, number)`` does the work and raises to fail; it must bear to run again, since a batch that is lost is
    repeated. Messages that aren't ``valid`` (a column; the contract of index jobs unless given) are rejected at once. The clock is the batch's
    processing time, or with ``time_col`` that of the messages and then the column's watermark, ``late`` behind. A failed message is tried again in the first batch at
    or after ``idle_seconds`` from its last attempt, and is dead after ``most`` attempts. A repeated message_id is ignored until ``keep_seconds``
    after its answer. A batch costs the state of the ``buckets`` that it touches: more of them suit small batches that remember much. Their number belongs to the
    checkpoint. The session's state store must be ``STATE_STORE``. Without ``time_col`` the
    stream needs a processing-time trigger (``seconds`` of ``write_outcomes``): its timers have no end.
    """
    rows = messages.select("message_id", "fields", F.coalesce(valid if valid is not None else contract(F.col("fields")).isNotNull(), F.lit(False)).alias("valid"), *([time_col] if time_col else []))
    rows = timed(rows, time_col, late)
    processor = Attempts(attempt, most, idle_seconds, keep_seconds, time_col is not None)
    keyed = rows.filter(F.col("message_id").isNotNull()).withColumn("bucket", F.pmod(F.xxhash64("message_id"), F.lit(buckets)).cast("int")).groupBy("bucket")
    return keyed.transformWithStateInPandas(statefulProcessor=processor, outputStructType=OUTCOME, outputMode="append", timeMode="EventTime" if time_col else "ProcessingTime")


def write_outcomes(outcomes: DataFrame, folder: str, checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Run to the input's end, or with ``seconds`` on and on. Each batch's outcomes are written under its number, so a repeated batch replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = outcomes.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def last_outcomes(outcomes: DataFrame) -> DataFrame:
    """Of each message its last outcome, with the columns that are given."""
    kept = [c for c in ("outcome", "attempt", "fields", "failure_type", "failure_message") if c in outcomes.columns]
    return outcomes.groupBy("message_id").agg(F.max_by(F.struct(*kept), "attempt").alias("o")).select("message_id", "o.*")


def dead(outcomes: DataFrame) -> DataFrame:
    """The dead letters among the outcomes, with their fields and what happened."""
    return dead_letters(outcomes.filter("outcome = 'dead'"))
