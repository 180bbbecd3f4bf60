import datetime

import pytest
from pyspark.sql import functions as F

from carelattice import schemas
from carelattice.functions import dates
from carelattice.operators import machines, quality, relational, schedules, search
from carelattice.plans import assembly
from carelattice.sources import commits, readers, sinks, vector_table

AT = lambda *a: datetime.datetime(*a)


def text_of(df, *names):
    return [tuple(r) for r in df.select(*(F.date_format(n, "yyyy-MM-dd HH:mm") if n.endswith("_at") or n == "upcoming" else F.col(n) for n in names)).collect()]


def test_local_occurrences_over_changes_of_clocks(spark):
    """Daily rules keep the zone's clock time; an hour that is left out or comes twice isn't missed, repeated or in the past."""
    rows = [
        ("FREQ=DAILY", "2024-03-08 14:00", "2024-03-09 14:00", "America/New_York", "2024-03-10 13:00"), ("FREQ=DAILY", "2024-03-08 07:30", "2024-03-09 07:30", "America/New_York", "2024-03-10 07:30"),
        ("FREQ=DAILY", "2024-03-08 07:30", "2024-03-10 07:30", "America/New_York", "2024-03-11 06:30"), ("FREQ=DAILY", "2024-11-01 05:30", "2024-11-03 05:30", "America/New_York", "2024-11-04 06:30"),
        ("FREQ=DAILY", "2024-11-01 05:30", "2024-11-03 06:10", "America/New_York", "2024-11-04 06:30"), ("FREQ=WEEKLY", "2024-03-25 06:00", "2024-03-25 06:00", "Europe/Berlin", "2024-04-01 05:00"),
        ("FREQ=WEEKLY;BYDAY=MO,TH", "2024-03-25 06:00", "2024-03-28 06:00", "Europe/Berlin", "2024-04-01 05:00"), ("FREQ=DAILY;INTERVAL=2", "2024-03-08 14:00", "2024-03-08 14:00", "America/New_York", "2024-03-10 13:00"),
        ("FREQ=DAILY", "2024-03-08 14:00", "2024-03-01 00:00", "Asia/Seoul", "2024-03-08 14:00"), ("FREQ=DAILY", "2024-03-08 14:00", "2024-03-08 14:00", "Mars/Base", None), ("nonsense", "2024-03-08 14:00", "2024-03-08 14:00", "Asia/Seoul", None),
        (None, "2024-03-08 14:00", "2024-03-08 14:00", "Asia/Seoul", None), ("FREQ=DAILY;COUNT=1", "2024-03-08 14:00", "2024-03-08 14:00", "Asia/Seoul", None),
    ]
    df = spark.createDataFrame(rows, "rule string, s string, a string, zone string, want string")
    at = lambda n: F.to_timestamp(n)
    found = df.select("want", F.date_format(dates.next_occurrence(F.col("rule"), at("s"), at("a"), F.col("zone")), "yyyy-MM-dd HH:mm").alias("got")).collect()
    assert [r.got for r in found] == [r.want for r in found]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")  # the session's own zone doesn't matter
    try:
        found = df.select(F.unix_timestamp(dates.next_occurrence(F.col("rule"), F.to_timestamp(F.concat("s", F.lit(":00Z"))), F.to_timestamp(F.concat("a", F.lit(":00Z"))), F.col("zone"))).alias("got"), F.unix_timestamp(F.to_timestamp(F.concat("want", F.lit(":00Z")))).alias("utc")).collect()
        assert [r.got for r in found] == [r.utc for r in found]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_every_zone_is_known_to_spark(spark):
    names = dates.zone_names()
    assert len(names) > 590
    df = spark.createDataFrame([(z,) for z in names], "z string").select(dates.known_zone(F.col("z")).alias("k"), F.from_utc_timestamp(F.lit("2024-01-01"), F.col("z")).alias("t"))
    assert df.filter("k AND t IS NOT NULL").count() == len(names)
    assert not spark.range(1).select(dates.known_zone(F.lit("Asia/seoul "))).first()[0]


def test_requests(spark):
    schema = "id int, title string, message string, alarm_type string, meal_slot string, scheduled_at string, recurrence_rule string, timezone string"
    ok = (1, "t", None, "MEDICATION", "MORNING", "2026-08-20T08:00:00+09:00", "FREQ=DAILY", "Asia/Seoul")
    change = lambda i, **x: tuple(x.get(n, i if n == "id" else v) for n, v in zip([c.split()[0] for c in schema.split(", ")], ok, strict=True))
    rows = [ok, change(2, title=""), change(3, message="m" * 501), change(4, meal_slot=None), change(5, alarm_type="GUIDE_CHECK"), change(6, timezone="Nowhere"), change(7, scheduled_at="2026-08-20T08:00:00"), change(8, recurrence_rule="FREQ=NO"),
            change(9, recurrence_rule="FREQ=DAILY;COUNT=1"), change(10, recurrence_rule=""), change(11, recurrence_rule=None, scheduled_at="2026-08-20 08:00Z"), change(12, title=None, timezone=None), change(13, scheduled_at="2026-13-40T08:00:00Z"), change(14, recurrence_rule="x" * 101)]
    good, bad = schedules.split_requests(spark.createDataFrame(rows, schema))
    assert sorted(text_of(good, "id", "status", "next_trigger_at")) == [(1, "ACTIVE", "2026-08-19 23:00"), (10, "ACTIVE", "2026-08-19 23:00"), (11, "ACTIVE", "2026-08-20 08:00")]
    assert {r.id: tuple(r.errors) for r in bad.collect()} == {
        2: ("TITLE_LENGTH",), 3: ("MESSAGE_LENGTH",), 4: ("MEAL_SLOT_REQUIRED",), 5: ("MEAL_SLOT_NOT_ALLOWED",), 6: ("INVALID_TIMEZONE",), 7: ("TIME_WITHOUT_ZONE",), 8: ("INVALID_RULE",), 9: ("NO_OCCURRENCE",),
        12: ("TITLE_LENGTH", "INVALID_TIMEZONE"), 13: ("TIME_WITHOUT_ZONE",), 14: ("RULE_LENGTH", "INVALID_RULE"),
    }


ALARMS = schemas.ALARM + ", completed_at timestamp, cancelled_at timestamp, updated_at timestamp"


def alarm(i, status="ACTIVE", rule=None, zone="Asia/Seoul"):
    return (i, 1, None, "GUIDE_CHECK", None, "t", None, AT(2026, 8, 20, 8), rule, zone, AT(2026, 8, 20, 8), status, None, None, None, None)


def test_actions(spark):
    alarms = spark.createDataFrame([alarm(1, rule="FREQ=DAILY"), alarm(2), alarm(3, "PAUSED"), alarm(4, "COMPLETED"), alarm(5), alarm(6), alarm(7, rule="FREQ=DAILY;COUNT=1")], ALARMS)
    actions = spark.createDataFrame([(1, "SKIP"), (2, "SKIP"), (3, "SKIP"), (4, "COMPLETE"), (5, "COMPLETE"), (7, "SKIP"), (9, "PAUSE")], "id int, action string")
    found = machines.act(alarms, actions, F.lit(AT(2026, 8, 20, 9)))
    day = "2026-08-20 08:00"
    assert sorted(text_of(found["alarms"], "id", "status", "next_trigger_at", "last_triggered_at")) == [
        (1, "ACTIVE", "2026-08-21 08:00", day), (2, "ACTIVE", day, day), (3, "PAUSED", day, None), (4, "COMPLETED", day, None), (5, "COMPLETED", day, None), (6, "ACTIVE", day, None), (7, "ACTIVE", day, day),
    ]
    assert {(r.alarm_id, r.event_type) for r in found["events"].collect()} == {(1, "SKIPPED"), (2, "SKIPPED"), (5, "COMPLETED"), (7, "SKIPPED")}
    assert {(r.id, r.status) for r in found["refused"].collect()} == {(3, "PAUSED"), (9, None)}


def test_skips_of_a_fold(spark):
    rows = [("FREQ=DAILY", 2, "2026-08-21 08:00", "2026-08-22 08:00"), (None, 3, "2026-08-20 08:00", "2026-08-20 08:00"), ("FREQ=DAILY;COUNT=3", 1, "2026-08-20 08:00", "2026-08-21 08:00"), ("FREQ=DAILY;COUNT=3", 3, "2026-08-22 08:00", "2026-08-22 08:00"),
            ("FREQ=DAILY;COUNT=3", 9, "2026-08-22 08:00", "2026-08-22 08:00"), ("FREQ=WEEKLY", 0, None, "2026-08-20 08:00")]
    df = spark.createDataFrame(rows, "rule string, n int, last string, next string").withColumn("s", F.lit(AT(2026, 8, 20, 8)))
    got = df.select("last", "next", machines.after_skips(F.col("rule"), F.col("s"), F.col("s"), F.col("n")).alias("x")).collect()
    assert [(r.x.last_triggered_at and f"{r.x.last_triggered_at:%Y-%m-%d %H:%M}", f"{r.x.next_trigger_at:%Y-%m-%d %H:%M}") for r in got] == [(r.last, r.next) for r in got]


def test_poll_by_zone_and_with_a_bad_rule(spark):
    row = lambda i, rule, zone: (i, 1, None, "GUIDE_CHECK", None, "t", None, AT(2024, 3, 8, 14), rule, zone, AT(2024, 3, 9, 14), "ACTIVE", None)
    alarms = spark.createDataFrame([row(1, "FREQ=DAILY", "America/New_York"), row(2, "FREQ=DAILY", "Asia/Seoul"), row(3, "nonsense", "Asia/Seoul"), row(4, "FREQ=DAILY", "Nowhere")], schemas.ALARM)
    settings = spark.createDataFrame([], "user_id bigint, is_notify_medication boolean, is_notify_schedule boolean, is_notify_guide boolean")
    found = machines.poll(alarms, settings, spark.createDataFrame([(5, 1, "e", True)], schemas.SUBSCRIPTION), F.lit(AT(2024, 3, 9, 15)))
    assert sorted(text_of(found["alarms"], "id", "next_trigger_at")) == [(1, "2024-03-10 13:00"), (2, "2024-03-10 14:00"), (3, "2024-03-09 14:00"), (4, "2024-03-09 14:00")]
    assert found["jobs"].count() == 4


def test_manual_retry_keys_are_read_back(spark):
    jobs = spark.createDataFrame([(1, "alarm:4:6:2026-08-20T08:00:00+00:00", "ALARM", "FAILED", 1, "alarm_events", 50, 3), (2, "k", "ALARM", "CANCELLED", 1, "alarm_events", 50, 3), (3, "k3", "ALARM", "FAILED", 1, "alarm_events", 51, 3), (4, "k4", "ALARM", "FAILED", 1, "alarm_events", 52, 3)],
                                 "id int, idempotency_key string, job_type string, status string, user_id int, reference_table string, reference_id int, max_retry_count int")
    events = spark.createDataFrame([(50, 4, 6, AT(2026, 8, 20, 8)), (51, 4, None, AT(2026, 8, 20, 8)), (52, 4, 7, AT(2026, 8, 20, 8))], "id int, alarm_id int, push_subscription_id int, event_at timestamp")
    children, refused = machines.manual_retry(jobs, events, spark.createDataFrame([(4,)], "id int"), spark.createDataFrame([(6,)], "id int"), F.lit("t1"))
    (child,) = children.collect()
    assert (child.idempotency_key, child.parent_job_id, child.alarm_id, child.subscription_id, child.retry_count) == ("alarm:4:6:2026-08-20T08:00:00+00:00:manual:t1", 1, 4, 6, 0)
    from carelattice.functions import text

    parsed = children.select(text.parse_alarm_key(F.col("idempotency_key")).alias("p")).first().p
    assert (parsed.alarm_id, parsed.subscription_id, parsed.trigger_text) == (4, 6, "2026-08-20T08:00:00+00:00")
    assert {(r.id, r.error) for r in refused.collect()} == {(2, "NOT_FAILED"), (3, "CONTEXT_MISSING"), (4, "TARGET_MISSING")}


JOBS = "id int, idempotency_key string, alarm_id int, subscription_id int, status string, retry_count int, max_retry_count int, started_at timestamp, completed_at timestamp, duration_ms int, available_at timestamp, reference_table string, reference_id string, error_code string, updated_at timestamp"


def test_an_attempt_is_one_change_of_three_tables(spark, tmp_path):
    """After a write that fails nothing has changed; after the replay, and after another one, the tables agree."""
    folder, now = str(tmp_path / "t"), F.lit(AT(2026, 8, 20, 8, 0, 2))
    job = lambda i, sub, retries=0: (i, f"k{i}", 1, sub, "PROCESSING", retries, 1, AT(2026, 8, 20, 8), None, None, None, None, None, None, None)
    commits.publish({
        "jobs": spark.createDataFrame([job(1, 1), job(2, 2), job(3, 1, 1), job(4, 1)], JOBS), "subscriptions": spark.createDataFrame([(1, True, None), (2, True, None)], "id int, is_active boolean, last_used_at timestamp"),
        "events": spark.createDataFrame([], "id string, alarm_id int, push_subscription_id int, event_type string, event_at timestamp, status_code int, error_code string"),
    }, folder, 0)
    alarms = spark.createDataFrame([(1, "ACTIVE")], "id int, status string")
    outcomes = spark.createDataFrame([(1, "SUCCESS", None, 201), (2, "EXPIRED", "GONE", 410), (3, "RETRYABLE", "LATER", 503), (4, "RETRYABLE", "LATER", 429)], "id int, kind string, error_code string, status_code int")
    read = lambda name: commits.current(spark, folder, name)

    def publish(broken=False):
        found = machines.attempt(read("jobs"), alarms, read("subscriptions"), outcomes, now)
        events = read("events").unionByName(found["events"])
        if broken:
            events = events.withColumn("id", F.raise_error(F.lit("disk")).cast("string"))
        return commits.publish({"jobs": found["jobs"], "subscriptions": found["subscriptions"], "events": events}, folder, batch="attempt-7")

    with pytest.raises(Exception, match="disk"):
        publish(broken=True)
    assert commits.versions(spark, folder) == [1] and read("events").count() == 0 and read("jobs").filter("status = 'PROCESSING'").count() == 4
    assert publish() == 2 and publish() == 2
    jobs = {r.id: r for r in read("jobs").collect()}
    assert {i: (j.status, j.retry_count, j.error_code, j.reference_id) for i, j in jobs.items()} == {1: ("COMPLETED", 0, None, "k1#0"), 2: ("FAILED", 0, "GONE", "k2#0"), 3: ("FAILED", 2, "LATER", "k3#2"), 4: ("RETRY_WAITING", 1, "LATER", None)}
    assert jobs[1].duration_ms == 2000 and jobs[4].available_at == AT(2026, 8, 20, 8, 0, 32) and jobs[4].completed_at is None
    assert {(r.id, r.event_type, r.status_code) for r in read("events").collect()} == {("k1#0", "SENT", None), ("k2#0", "FAILED", 410), ("k3#2", "FAILED", 503)}
    assert {(r.id, r.is_active, r.last_used_at) for r in read("subscriptions").collect()} == {(1, True, AT(2026, 8, 20, 8, 0, 2)), (2, False, None)}


def test_attempts_of_lost_alarms_are_cancelled(spark):
    jobs = spark.createDataFrame([(i, f"k{i}", i, 1, "PROCESSING", 0, 1, None, None, None, None, None, None, None, None) for i in (1, 2, 3)] + [(4, "k4", 1, 9, "PROCESSING", 0, 1, *[None] * 8), (5, "k5", 1, 1, "QUEUED", 0, 1, *[None] * 8)], JOBS)
    outcomes = spark.createDataFrame([(i, "SUCCESS", None, 201) for i in range(1, 6)], "id int, kind string, error_code string, status_code int")
    found = machines.attempt(jobs, spark.createDataFrame([(1, "ACTIVE"), (2, "PAUSED")], "id int, status string"), spark.createDataFrame([(1, True, None)], "id int, is_active boolean, last_used_at timestamp"), outcomes, F.lit(AT(2026, 1, 1)))
    assert {(r.id, r.status, r.duration_ms) for r in found["jobs"].collect()} == {(1, "COMPLETED", None), (2, "CANCELLED", None), (3, "CANCELLED", None), (4, "CANCELLED", None), (5, "QUEUED", None)}
    assert found["events"].count() == 1


def test_delays(spark):
    jobs = spark.createDataFrame([(1, "QUEUED", 0), (2, "QUEUED", 60), (3, "QUEUED", None), (4, "QUEUED", -5), (5, "COMPLETED", 0)], "id int, status string, d int")
    queued = machines.enqueue(jobs, F.lit(AT(2026, 1, 1)), F.col("d"))
    assert [r.id for r in machines.available(queued, F.lit(AT(2026, 1, 1))).collect()] == [1, 3, 4]
    assert [r.id for r in machines.available(queued, F.lit(AT(2026, 1, 1, 0, 1))).collect()] == [1, 3, 4, 2]


def test_commits(spark, tmp_path):
    folder = str(tmp_path / "t")
    one = lambda *x: spark.createDataFrame([(i,) for i in x], "x int")
    assert commits.commit(spark, folder) is None
    with pytest.raises(ValueError):
        commits.current(spark, folder, "a")
    assert commits.publish({"a": one(1), "b": one(5)}, folder, 0) == 1
    assert commits.publish({"a": one(2)}, folder, 1, properties={"p": 1}) == 2
    with pytest.raises(commits.Conflict):  # both have seen version 1
        commits.publish({"a": one(3)}, folder, 1)
    read = lambda name, v=None: [r.x for r in commits.current(spark, folder, name, v).collect()]
    assert (read("a"), read("b"), read("a", 1)) == ([2], [5], [1]) and commits.commit(spark, folder).properties == {"p": 1}
    # Another publisher commits while this one is still writing its data.
    real, seen = commits.versions, []

    def versions(s, f):
        found = real(s, f)
        seen.append(found)
        return found[:-1] if len(seen) == 1 else found  # as if version 2 had come after the look

    commits.versions = versions
    try:
        with pytest.raises(commits.Conflict):
            commits.publish({"a": one(7)}, folder)
    finally:
        commits.versions = real
    assert read("a") == [2]
    assert commits.publish({"b": one(6)}, folder, 2) == 3
    assert commits.drop_old(spark, folder, 1) == [1, 2] and (read("a"), read("b")) == ([2], [6])
    names = [p.name for p in (tmp_path / "t").rglob("*") if p.is_dir() and p.parent.name.startswith("data-")]
    assert sorted(names) == ["a", "a", "b"] or sorted(names) == ["a", "b"]


def test_vector_table(spark, tmp_path):
    folder = str(tmp_path / "v")
    meta = lambda doc: (None, None, doc, *[None] * 13)
    points = lambda *rows: spark.createDataFrame([(i, v, "c", meta(d)) for i, v, d in rows], schemas.POINT)
    with pytest.raises(ValueError, match="no vector table"):
        vector_table.check(spark, folder, 2)
    assert vector_table.delete_document(spark, folder, "d") is None
    vector_table.create(spark, folder, 2)
    vector_table.create(spark, folder, 2)
    with pytest.raises(ValueError, match="components"):
        vector_table.create(spark, folder, 3)
    with pytest.raises(ValueError, match="COSINE"):
        vector_table.check(spark, folder, 2, "DOT")
    vector_table.create(spark, str(tmp_path / "w"), 2, vectors=2)
    with pytest.raises(ValueError, match="one vector"):
        vector_table.check(spark, str(tmp_path / "w"), 2)
    vector_table.upsert(points(("a", [1.0, 0.0], "d1"), ("b", [0.0, 1.0], "d2")), folder, 2)
    vector_table.upsert(points(("a", [3.0, 0.0], "d1")), folder, 2, batch="x")
    with pytest.raises(ValueError, match="components"):
        vector_table.upsert(points(("c", [1.0], "d1")), folder, 2)
    with pytest.raises(ValueError, match="blank"):
        vector_table.delete_document(spark, folder, " ")
    assert {r.point_id: list(r.vector) for r in commits.current(spark, folder, "points").collect()} == {"a": [3.0, 0.0], "b": [0.0, 1.0]}
    vector_table.delete_document(spark, folder, " d2 ")
    assert [r.point_id for r in commits.current(spark, folder, "points").collect()] == ["a"]
    schema = "k int, ids array<string>, chunks array<string>, vectors array<array<float>>"
    batches = [(1, ["a", "b"], ["x", "y"], [[1.0, 2.0], [3.0, 4.0]]), (2, ["a"], ["x", "y"], [[1.0, 2.0]]), (3, ["a"], ["x"], [[1.0]]), (4, ["a"], ["x"], [None]), (5, [], [], []), (6, None, [], []), (7, ["a"], ["x"], [[1.0, 2.0], [1.0, 2.0]])]
    good, bad = vector_table.pair(spark.createDataFrame(batches, schema), 2, "k")
    assert {(r.k, r.point_id, r.chunk) for r in good.collect()} == {(1, "a", "x"), (1, "b", "y")}
    assert {(r.k, r.error) for r in bad.collect()} == {(2, "UNEQUAL_LENGTHS"), (3, "WRONG_SIZE"), (4, "WRONG_SIZE"), (6, "NULL_LIST"), (7, "UNEQUAL_LENGTHS")}


def test_upserts_keep_keys_unique(spark):
    old = spark.createDataFrame([("a", 1, "x", True), ("b", 2, "y", False)], "endpoint string, user_id int, note string, is_active boolean")
    new = spark.createDataFrame([("a", 1, "p"), ("a", 1, "q"), ("b", 3, "r"), ("c", 4, "s"), ("c", 4, "t")], "endpoint string, user_id int, note string")
    table, refused = sinks.upsert_owned(old, new, "endpoint", "user_id")
    assert sorted((r.endpoint, r.note, r.is_active) for r in table.collect()) == [("a", "p", True), ("b", "y", False), ("c", "s", True)] and refused.count() == 1
    points = spark.createDataFrame([("a", 1, "old"), ("b", None, "old"), ("c", None, "old")], "k string, v int, t string")
    more = spark.createDataFrame([("a", 1, "new"), ("b", 2, "new"), ("c", None, "new")], "k string, v int, t string")
    assert {(r.k, r.v, r.t) for r in search.upsert(points, more, "k", "v").collect()} == {("a", 1, "new"), ("b", 2, "new"), ("c", None, "new")}
    assert [r.k for r in search.delete_ids(points, [" a ", "a", "", "b"], "k").collect()] == ["c"]


def test_citations_and_guide(spark):
    visits = [(21, AT(2026, 8, 20, 10), "내과", None, None, "검사", "병원"), (None, None, None, None, "2층", None, "병원")]
    context = (1, 100, ["고혈압"], "수술", datetime.date(2026, 8, 1), 7, None, None, "f" * 64, AT(2026, 8, 1), [(1001, "정", "1정", 2, None, 7, None), (None, "b", "", None, None, None, None)], [(11, "b", 2, "PRECAUTION"), (12, "a", 1, None), (None, "c", 1, None)], visits)
    df = spark.createDataFrame([context], schemas.PATIENT_CONTEXT)
    chunks = F.array(F.struct(F.lit("p1").alias("point_id"), F.lit(0.9).alias("score"), F.from_json(F.lit('{"dataset_key": "k", "dataset_version": "v", "document_id": "d", "page_number": 3, "title": "T"}'), schemas.GUIDELINE_METADATA.replace("\n", " ")).alias("metadata")))
    public, none = F.array(F.lit("p")), F.array().cast("array<string>")
    cite = lambda intent, route, info: [r.asDict() for r in assembly.numbered(df, assembly.citations(F.lit(intent), F.lit(route), info, chunks), "user_id").withColumn("ok", quality.source_union()).orderBy("citation_order").collect()]
    both = cite("MEDICATION", "PATIENT_AND_RAG", public)
    assert [(c["citation_order"], c["source_type"], c["medication_id"], c["vector_chunk_id"], c["source_page_number"], c["ok"]) for c in both] == [(1, "PATIENT_SAVED_FIELD", 1001, None, None, True), (2, "PUBLIC_RAG_CHUNK", None, "p1", 3, True)]
    assert len(cite("MEDICATION", "PATIENT_ONLY", public)) == len(cite("MEDICATION", "PATIENT_AND_RAG", none)) == 1
    assert [c["patient_field"] for c in cite("PATIENT_FACT", "PATIENT_ONLY", none)] == ["DIAGNOSIS", "SURGERY", "DISCHARGE_DATE"] and cite("GENERAL", "PATIENT_ONLY", none) == []
    assert [c["follow_up_visit_id"] for c in cite("FOLLOW_UP", "PATIENT_ONLY", none)] == [21]
    g = df.select(assembly.recovery_guide(public, none).alias("g")).first().g
    assert g.medication_guide == ["정 · 1정 · 1일 2회 · 7일", "b"] and g.patient_instructions == ["a", "c", "b"] and g.follow_up_schedule == ["2026-08-20 10:00 · 내과 · 검사 · 병원", "2층"]
    assert (g.public_information, g.lifestyle_guide, g.warning_signs, g.safety_notice) == (["p"], [], [], assembly.NOTICE)


def test_keys_and_references(spark):
    alarms = spark.createDataFrame([(1, 1, "MEDICATION", "A", None), (2, 1, "MEDICATION", "A", None), (3, 1, "GUIDE_CHECK", None, 7), (4, 1, "GUIDE_CHECK", None, 8), (5, 9, "MEDICATION", None, None)], "id int, user_id int, alarm_type string, meal_slot string, care_episode_id int")
    tables = {"alarms": alarms.withColumn("follow_up_visit_id", F.lit(None).cast("int")), "users": spark.createDataFrame([(1, "a")], "id int, email string"), "care_episodes": spark.createDataFrame([(7,)], "id int").withColumns({"user_id": F.lit(1), **{c: F.lit(None).cast("timestamp") for c in ("started_at", "default_end_at", "planned_end_at", "completed_at", "confirmed_at")}, "medication_days": F.lit(400), "source_ocr_job_id": F.lit(None).cast("int"), "confirmation_hash": F.lit(None).cast("string")})}
    got = {(r.table, r.id, r.kind, r.constraint) for r in quality.table_violations(tables).collect()}
    assert got == {("alarms", 1, "UNIQUE", "user_alarm_slot"), ("alarms", 2, "UNIQUE", "user_alarm_slot"), ("alarms", 4, "REFERENCE", "care_episode_id"), ("alarms", 5, "REFERENCE", "user_id"), ("alarms", 5, "CHECK", "meal_slot"), ("care_episodes", 7, "CHECK", "medication_days")}
    assert spark.range(1).select(quality.clean_codes(F.array(F.lit(" a"), F.lit("a "), F.lit(" "), F.lit("b")))).first()[0] == ["a", "b"]


def test_small_readers_and_writers(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (2, "c", 3)], "k int, t string, n int")
    assert [tuple(r) for r in readers.by_key(rows, k=1).collect()] == [(1, "a", 2)] and readers.by_key(rows, k=2, t="x").collect() == []
    sinks.append(rows, str(tmp_path / "t"))
    sinks.append(rows.filter("k = 2"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4
    days = spark.createDataFrame([("2024-05-01",), ("2022-04-30",), ("2022-05-01",), ("2024-05-02",)], "d string").select("d", dates.within_years(F.to_date("d"), F.to_date(F.lit("2024-05-01"))).alias("w"))
    assert {r.d for r in days.collect() if r.w} == {"2024-05-01", "2022-05-01"}
    late = relational.listing(rows, [F.col("n")], 9, 2).first()
    assert (late["items"], late["total"], late["offset"], late["limit"]) == ([], 3, 16, 2)
    assert [x.n for x in relational.listing(rows, [F.desc("n")], 1, 2).first()["items"]] == [3, 2]
