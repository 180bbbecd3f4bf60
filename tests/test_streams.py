"""Keyed state over streams, on a clock that the tests set by the events' times."""

import json
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from carelattice.operators import machines
from carelattice.plans import catalog_alarms
from carelattice.streaming import retries, state

from . import compare


@pytest.fixture(autouse=True)
def store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", retries.STATE_STORE)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")


class Inbox:
    """A stream of JSON files, one a batch, drained again and again by a query that starts anew each time."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0
        (folder / "in").mkdir()

    def put(self, *rows):
        self.n += 1
        (self.folder / "in" / f"{self.n:03d}.json").write_text("\n".join(json.dumps(r) for r in rows))

    def drain(self, operator, mode="append"):
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).json(str(self.folder / "in"))
        out, checkpoint = str(self.folder / "out"), str(self.folder / "checkpoint")
        write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
        operator(stream).writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        return self.spark.read.parquet(out)


def message(name, at, **fields):
    return {"message_id": name, "at": f"2024-01-01T{at}Z", "fields": {"job_id": name, "job_type": "PUBLIC_GUIDELINE_INDEX", "manifest_path": "m.json", **fields}}


def test_retries_over_batches_and_restarts(spark, tmp_path):
    """Pending over batches, tried after the idle time only, dead after three, forgotten after a while; each drain is a restart."""
    tried = tmp_path / "tried"

    def attempt(name, fields, number, tried=str(tried)):
        with open(tried, "a") as f:
            f.write(f"{name}:{number}\n")
        if number <= int(fields.get("fails", 0)):
            raise ConnectionError(f"{name} {number}")

    inbox = Inbox(spark, tmp_path, "message_id string, at timestamp, fields map<string, string>")
    run = lambda: inbox.drain(lambda s: retries.attempts(s, attempt, time_col="at", keep_seconds=600))
    state_of = lambda df: {r.message_id: (r.outcome, r.attempt) for r in retries.last_outcomes(df).collect()}
    inbox.put(message("good", "00:00:00"), message("bad", "00:00:00", chunk_size="x"), message("never", "00:00:00", fails=9), message("once", "00:00:00", fails=1))
    assert state_of(run()) == {"good": ("done", 1), "bad": ("rejected", 0), "never": ("pending", 1), "once": ("pending", 1)}
    inbox.put(message("tick1", "00:00:30"), message("good", "00:00:30"))  # half the idle time: nothing is tried again, nor is what was answered
    assert state_of(run())["never"] == ("pending", 1)
    inbox.put(message("tick2", "00:01:10"))
    found = state_of(run())
    assert found["never"] == ("pending", 2) and found["once"] == ("done", 2)
    inbox.put(message("tick3", "00:01:40"))
    assert state_of(run())["never"] == ("pending", 2)
    inbox.put(message("tick4", "00:03:00"))
    outcomes = run()
    assert state_of(outcomes)["never"] == ("dead", 3)
    (letter,) = retries.dead(outcomes).collect()
    assert letter.fields["original_message_id"] == "never" and letter.fields["failure_type"] == "ConnectionError" and letter.fields["failure_message"] == "never 3"
    inbox.put(message("tick5", "00:30:00"))
    run()
    inbox.put(message("good", "00:30:10"))  # remembered no more, so it is new
    run()
    assert sorted(x for x in tried.read_text().split() if "tick" not in x) == ["good:1", "good:1", "never:1", "never:2", "never:3", "once:1", "once:2"]


def test_messages_share_the_state_of_a_bucket(spark, tmp_path):
    """The state has a row a bucket, however many messages; each of them keeps its own idle time and is forgotten by itself."""

    def attempt(name, fields, number):
        if number <= int(fields["fails"]):
            raise ValueError(f"{name} {number}")

    inbox = Inbox(spark, tmp_path, "message_id string, at timestamp, fields map<string, string>")
    run = lambda: inbox.drain(lambda s: retries.attempts(s, attempt, time_col="at", keep_seconds=600, buckets=2))
    state_of = lambda df: {r.message_id: (r.outcome, r.attempt) for r in retries.last_outcomes(df).collect()}
    rows = lambda: spark.read.format("statestore").option("stateVarName", "messages").load(str(tmp_path / "checkpoint")).count()
    inbox.put(*(message(f"m{i}", f"00:00:{i:02d}", fails=9 if i % 2 else 0) for i in range(40)), message("m1", "00:00:39", fails=0))
    assert state_of(run()) == {f"m{i}": ("pending" if i % 2 else "done", 1) for i in range(40)}
    assert rows() == 2
    inbox.put(message("tick1", "00:01:21", fails=0))  # the idle time of m21 ends with this second, that of m23 doesn't
    assert {k: v for k, v in state_of(run()).items() if v[0] == "pending"} == {f"m{i}": ("pending", 2 if i <= 21 else 1) for i in range(1, 40, 2)}
    inbox.put(message("tick2", "00:02:21", fails=0))
    assert {k: v for k, v in state_of(run()).items() if k[:4] != "tick" and int(k[1:]) % 2} == {f"m{i}": ("dead", 3) if i <= 21 else ("pending", 2) for i in range(1, 40, 2)}
    inbox.put(message("tick3", "00:10:20", fails=0))
    run()  # m0 to m20 are forgotten, m22 is not
    inbox.put(message("m20", "00:10:20.5", fails=9), message("m22", "00:10:20.5", fails=9))
    found = state_of(run())
    assert found["m22"] == ("done", 1) and found["m39"] == ("dead", 3)
    assert spark.read.parquet(str(tmp_path / "out")).filter("message_id = 'm20' AND outcome = 'pending'").count() == 1
    inbox.put(message("tick4", "05:00:00", fails=0))
    run()
    inbox.put(message("tick5", "09:00:00", fails=0))
    run()
    assert rows() == 1  # tick5's


def test_slices_of_many_files(spark, tmp_path):
    """A slice is as many files as the input has parts, and still one batch, though the slices meet within a millisecond."""
    times = ["0", "1.0002", "1.0003", "1.0007", "1.0008", "3.5", "3.6", "4.002"]  # a slice ends at 1.0005
    con = duckdb.connect()
    rows = ", ".join(f"({i}, TIMESTAMP '2024-01-01' + INTERVAL ({t} * 1000000) MICROSECOND, '{'click' if i % 3 else 'signup'}')" for i, t in enumerate(times))
    con.sql(f"CREATE TABLE events AS SELECT event_id::BIGINT AS event_id, ts::TIMESTAMP AS ts, event_type FROM (VALUES {rows}) v(event_id, ts, event_type)")
    (tmp_path / "events.parquet").mkdir()
    for i in range(2):
        con.sql(f"COPY (FROM events WHERE event_id % 2 = {i}) TO '{tmp_path}/events.parquet/{i}.parquet'")
    before = set(Path(spark.conf.get("spark.checkpoint.dir")).glob("streams/*"))
    got, want = compare.compare(spark, con, catalog_alarms.stream_retries, catalog_alarms.SQL["stream_retries"], str(tmp_path))
    assert got == want and len(got) == len(times)
    (folder,) = set(Path(spark.conf.get("spark.checkpoint.dir")).glob("streams/*")) - before
    assert len(list(folder.glob("in/*.parquet"))) > catalog_alarms.SLICES


def test_retries_by_processing_time(spark, tmp_path):
    def attempt(name, fields, number):
        if number < 2:
            raise ValueError("no")

    inbox = Inbox(spark, tmp_path, "message_id string, fields map<string, string>")
    inbox.put({k: v for k, v in message("x", "00:00:00").items() if k != "at"})
    stream = spark.readStream.schema(inbox.schema).json(str(tmp_path / "in"))
    query = retries.write_outcomes(retries.attempts(stream, attempt, idle_seconds=1), str(tmp_path / "out"), str(tmp_path / "checkpoint"), seconds=1)
    try:
        for _ in range(40):
            query.awaitTermination(1)
            if query.lastProgress and {(r.outcome, r.attempt) for r in spark.read.schema(retries.OUTCOME).parquet(str(tmp_path / "out")).collect()} == {("pending", 1), ("done", 2)}:
                break
        else:
            raise AssertionError("not tried again")
    finally:
        query.stop()


def test_action_state_equals_the_fold_and_is_bounded(spark, tmp_path):
    schema = "k int, n int, at timestamp, step string"
    inbox = Inbox(spark, tmp_path, schema)
    row = lambda k, n, at, step: {"k": k, "n": n, "at": f"2024-01-01T{at}Z", "step": step}
    tries = ["CLAIM", "RETRYABLE"] * 3
    first = [row(1, i, "00:00:00", s) for i, s in enumerate(tries[:3])] + [row(2, 0, "00:00:00", "CANCEL"), row(3, 0, "00:00:01", "CLAIM")]
    second = [row(1, 3 + i, "00:01:00", s) for i, s in enumerate([*tries[3:], "CLAIM"])] + [row(2, 1, "00:01:00", "CLAIM")]
    run = lambda: inbox.drain(lambda s: state.run_actions(s, "k", "n", "step", machines.JOB_MOVES, "QUEUED", most_retries=2, time_col="at", keep_seconds=300), "update")
    inbox.put(*first)
    run()
    inbox.put(*second)
    last = lambda df: {r.k: tuple(r.s) for r in df.groupBy("k").agg(F.max_by(F.struct("status", "applied", "refused", "retries"), F.col("applied") + F.col("refused")).alias("s")).collect()}
    folded = machines.fold_actions(spark.createDataFrame([(r["k"], r["n"], r["step"]) for r in first + second], "k int, n int, step string"), "k", ["n"], "step", machines.JOB_MOVES, "QUEUED", most_retries=2)
    assert last(run()) == {r.k: (r.status, r.applied, r.refused, r.retries) for r in folded.collect()}
    rows = lambda: spark.read.format("statestore").option("stateVarName", "machine").load(str(tmp_path / "checkpoint")).count()
    assert rows() == 3
    inbox.put(row(9, 0, "01:00:00", "CLAIM"))
    run()
    assert rows() == 1


def test_acknowledged_stream(spark, tmp_path):
    inbox = Inbox(spark, tmp_path, "k int, at int, ts timestamp, event_type string")
    row = lambda k, at, kind: {"k": k, "at": at, "ts": f"2024-01-01T00:00:{at:02d}Z", "event_type": kind}
    run = lambda: inbox.drain(lambda s: state.acknowledged(s, ["k"], "at", time_col="ts", keep_seconds=3600))
    inbox.put(row(1, 1, "DELIVERED"), row(1, 2, "SENT"), row(1, 3, "DELIVERED"), row(2, 1, "DELIVERED"))
    run()
    inbox.put(row(1, 4, "DELIVERED"), row(3, 5, "SENT"))
    assert [(r.k, r.delivered) for r in run().collect()] == [(1, 3)]
