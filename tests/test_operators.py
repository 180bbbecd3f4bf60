"""Operators, rule packs, readers, writers and streams on the documented fixtures."""

import datetime
import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from carelattice import schemas
from carelattice.functions import vectors
from carelattice.operators import machines, quality, relational, search, splitter
from carelattice.plans import assembly, indexing, rules
from carelattice.sources import readers, sinks
from carelattice.streaming import index_jobs, state

AT = datetime.datetime


def one(spark, column, *row, schema):
    return spark.createDataFrame([row], schema).select(column).first()[0]


QUESTIONS = [
    ("아스피린을 오늘부터 끊어도 돼?", ["MEDICATION_CHANGE_REQUEST"]), ("약 복용량을 늘려도 될까?", ["MEDICATION_CHANGE_REQUEST"]), ("제가 뇌졸중인지 진단해줘.", ["DIAGNOSIS_REQUEST"]),
    ("수술을 받아야 하는지 결정해줘.", ["TREATMENT_DECISION_REQUEST"]), ("가슴이 아프고 숨을 쉬기 힘들어.", ["EMERGENCY_SYMPTOM"]), ("아스피린은 언제 먹어?", []), ("다음 외래 진료는 언제야?", []),
    ("퇴원 후 운동 방법을 알려줘.", []), ("내 진단명을 알려줘.", []), ("약을 끊고 수술을 받아야 하는지도 결정해줘.", ["MEDICATION_CHANGE_REQUEST", "TREATMENT_DECISION_REQUEST"]),
]


def test_questions(spark):
    rows = spark.createDataFrame(QUESTIONS + [("  ", [])], "q string, codes array<string>").select("codes", rules.assess_risk(F.col("q")).alias("r")).collect()
    for r in rows[:-1]:
        assert r.r.codes == r.codes and r.r.level == ("HIGH" if r.codes else "LOW")
    assert rows[-1].r is None


NOTICE = " 의사의 진료를 대체하지 않습니다."
ANSWERS = [
    ("약을 끊으세요." + NOTICE, "GENERAL", "MEDICATION_CHANGE_INSTRUCTION"), ("테스트정은 좋습니다. 내일부터 중단하세요." + NOTICE, "GENERAL", "MEDICATION_CHANGE_INSTRUCTION"),
    ("운동을 늘리세요." + NOTICE, "GENERAL", None), ("운동을 늘리세요. 테스트정" + NOTICE, "MEDICATION", "MEDICATION_CHANGE_INSTRUCTION"), ("물을 드세요." + NOTICE, "MEDICATION", "PATIENT_MEDICATION_MISMATCH"),
    ("뇌졸중으로 판단됩니다." + NOTICE, "GENERAL", "DIAGNOSTIC_ASSERTION"), ("입원 치료가 필요합니다." + NOTICE, "GENERAL", "TREATMENT_DECISION"), ("물을 드세요.", "GENERAL", "MISSING_MEDICAL_DISCLAIMER"),
    ("테스트정은 건너뛰어도 돼요" + NOTICE, "LIFESTYLE", "MEDICATION_CHANGE_INSTRUCTION"), ("약속을 변경하고 나서 복용하지 않아도 됩니다" + NOTICE, "GENERAL", "MEDICATION_CHANGE_INSTRUCTION"),
]


def test_answer_guard(spark):
    meds = F.array(F.struct(F.lit("테스트정").alias("name"), F.lit(None).cast("string").alias("dose"), F.lit(None).cast("int").alias("times_per_day"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("int").alias("days")))
    rows = spark.createDataFrame(ANSWERS, "a string, i string, code string").select("a", "code", rules.guard_answer(F.col("a"), F.col("i"), meds).alias("g")).collect()
    assert [(r.a, r.g.code) for r in rows] == [(r.a, r.code) for r in rows]
    assert {r.g.status for r in rows if r.code == "MISSING_MEDICAL_DISCLAIMER"} == {"RESTRICTED"}


def test_guide_guard(spark):
    schema = "t array<string>, n string, c array<string>, d array<string>, l array<string>, e array<string>"
    found = rules.guard_guide(*map(F.col, "tncdle"))
    ok = NOTICE.strip()
    cases = [
        ((["물"], ok, [], [], [], []), "SAFE", []), ((["약을 중단하세요", "수술이 필요합니다", "약을 끊으세요"], ok, [], [], [], []), "BLOCKED", ["MEDICATION_CHANGE_INSTRUCTION", "TREATMENT_DECISION"]),
        ((["약을 중단하세요!"], ok, ["약을  중단하세요."], [], [], []), "SAFE", []), ((["고혈압으로 진단됩니다"], ok, [], ["고혈압"], [], []), "SAFE", []), ((["고혈압으로 진단됩니다"], ok, [], ["암"], [], []), "BLOCKED", ["DIAGNOSTIC_ASSERTION"]),
        ((["물"], "안내", [], [], [], []), "RESTRICTED", ["MISSING_MEDICAL_DISCLAIMER"]), ((["물"], ok, [], [], ["a"], ["b"]), "BLOCKED", ["PATIENT_MEDICATION_MISMATCH"]),
    ]
    for row, status, codes in cases:
        got = one(spark, found, *row, schema=schema)
        assert (got.status, got.codes) == (status, codes)


def test_conflicts(spark):
    status = rules.conflict_status(*map(F.col, "ntme"))
    table = [((0, 1, 0, 0), "NOT_APPLICABLE"), ((2, 0, 1, 1), "NO_CONFLICT"), ((2, 1, 1, 2), "REVIEW_REQUIRED"), ((2, 1, 0, 0), "NO_CONFLICT"), ((2, 1, 0, 2), "PUBLIC_SOURCE_EXCLUDED"), ((2, 1, 0, 1), "PATIENT_DATA_PRIORITY")]
    assert [one(spark, status, *row, schema="n int, t int, m int, e int") for row, _ in table] == [s for _, s in table]


def test_merged_risk(spark):
    merged = rules.merge_risk(F.lit("LOW"), F.array(F.lit("B"), F.lit("A")), F.lit("HIGH"), F.array(F.lit("A")), F.lit("PATIENT_AND_RAG"), F.lit("q"))
    got = spark.range(1).select(merged).first()[0]
    assert (got.level, got.codes, got.route, got.query) == ("HIGH", ["A", "B"], "RESTRICTED", None)


def test_splitter():
    body = "Medication guidance. " * 50 + "\n\n" + "Lifestyle guidance. " * 50
    chunks = splitter.split_text(body, 300, 50)
    assert len(chunks) > 1 and all(0 < len(c) <= 300 for c in chunks)
    assert all(w in " ".join(chunks) for w in ("Medication", "Lifestyle")) and not any("Medication" in c and "Lifestyle" in c for c in chunks)
    assert splitter.split_text("", 10, 2) == [] and splitter.split_text("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]
    assert splitter.split_text("aaa bbb ccc ddd", 8, 4) == ["aaa bbb", "bbb ccc", "ccc ddd"]


@pytest.mark.parametrize(("size", "overlap"), [(0, 0), (10, -1), (10, 10)])
def test_splitter_arguments(spark, size, overlap):
    with pytest.raises(ValueError):
        splitter.split_documents(spark.createDataFrame([("a",)], "text string"), size, overlap)


POINTS = [("p1", [1.0, 0.0, 0.0], "c1", ("STROKE", "MEDICATION")), ("p2", [0.9, 0.1, 0.0], "c2", ("STROKE", None)), ("p3", [0.0, 1.0, 0.0], "c3", ("STROKE", "LIFESTYLE")), ("p4", [1.0, 0.0, 0.0], None, ("STROKE", "MEDICATION"))]


def points(spark):
    return spark.createDataFrame(POINTS, "point_id string, vector array<float>, content string, metadata struct<condition: string, topic: string>")


def test_search(spark):
    good = search.well_formed(points(spark))
    assert [r.point_id for r in search.top_k(good, [1.0, 0.0, 0.0], 5, 0.65).collect()] == ["p1", "p2"]
    assert [r.point_id for r in search.top_k(search.payload_filter(good, **{"metadata.topic": "LIFESTYLE", "metadata.condition": None}), [1.0, 0.0, 0.0], 5, 0.65).collect()] == []
    with pytest.raises(ValueError):
        search.top_k(good, [1.0], 21)
    flat = good.select("point_id", "vector", F.col("metadata.topic").alias("topic"))
    asked = spark.createDataFrame([("q1", [1.0, 0.0, 0.0], "MEDICATION"), ("q2", [1.0, 0.0, 0.0], "WARNING_SIGN")], "query_id string, query_vector array<float>, topic string")
    got = search.relaxed_top_k(asked, flat, "topic").orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.point_id, r.rank, r.strict) for r in got] == [("q1", "p1", 1, True), ("q2", "p1", 1, False), ("q2", "p2", 2, False)]


@pytest.mark.parametrize("threshold", [-0.3, 0.8])
def test_relaxed_search_by_groups(spark, monkeypatch, threshold):
    """Groups of both sides give what all pairs give, to the bit: ties, copies, nulls, zero, tiny, huge and infinite vectors, other sizes."""
    monkeypatch.setattr(search, "GROUP_POINTS", 60, raising=False)
    monkeypatch.setattr(search, "GROUP_QUERIES", 20, raising=False)
    dice, inf, nan = random.Random(4), math.inf, math.nan
    grid = [[float(dice.randint(-2, 2)) for _ in range(6)] for _ in range(70)]
    wide = [[dice.gauss(0, 1) for _ in range(6)] for _ in range(70)]
    odd = [None, [], [1.0] * 5, [1.0] * 5, [2.0] * 5, [0.0] * 6, [nan] + [1.0] * 5, [inf] + [0.0] * 5, [1.0, None] + [1.0] * 4, [1e200] * 6, [1e160, 1.0, 0.0, 0.0, 0.0, 0.0], [1e-170] * 6, [3e-160, 1e-160, 0.0, 0.0, 0.0, 0.0], [1e30] * 6]
    all_of = [*grid, *grid[:30], *([3.0 * x for x in v] for v in wide[:20]), *wide, *odd]
    rows = [(f"p{i}", v, dice.choice(["a", "b", "c", None])) for i, v in enumerate(all_of)]
    flat = spark.createDataFrame(rows, "point_id string, vector array<double>, topic string")
    asked = spark.createDataFrame([(i, v, dice.choice(["a", "b", "none", None])) for i, (_, v, _) in enumerate([*rows[::5], *rows[-len(odd) :]])], "query_id int, query_vector array<double>, topic string")
    got = search.relaxed_top_k(asked, flat, "topic", 4, threshold)
    pairs = flat.crossJoin(asked.withColumnRenamed("topic", "own")).withColumn("score", vectors.cosine(F.col("vector"), F.col("query_vector"))).filter(F.col("score") >= threshold)
    pairs = pairs.withColumn("strict", F.coalesce(F.col("topic") == F.col("own"), F.lit(False))).withColumn("any", F.max("strict").over(Window.partitionBy("query_id"))).filter("strict OR NOT any")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "point_id"))).filter("rank <= 4")
    plain = lambda found: sorted((r.query_id, r.point_id, repr(r.score + 0.0), r.rank, r.strict) for r in found.collect())
    assert plain(got) == plain(ranked.select("query_id", "point_id", "score", "rank", F.col("any").alias("strict")))
    assert {r.strict for r in got.collect()} == {True, False}
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()  # a pair isn't a row


def test_relaxed_search_of_nothing(spark):
    flat = points(spark).select("point_id", "vector", F.col("metadata.topic").alias("topic"))
    asked = spark.createDataFrame([("q1", [1.0, 0.0, 0.0], "MEDICATION"), ("q2", [1.0, 0.0], None), ("q3", None, "MEDICATION")], "query_id string, query_vector array<float>, topic string")
    assert search.relaxed_top_k(asked, flat.limit(0), "topic").count() == search.relaxed_top_k(asked.limit(0), flat, "topic").count() == 0
    assert {r.query_id for r in search.relaxed_top_k(asked, flat, "topic").collect()} == {"q1"}


def test_reindex(spark):
    pages = spark.createDataFrame([("d1", 1, "one two\n\nthree"), ("d1", 2, "  "), ("d1", 3, "four"), ("d1", 3, "four")], "document_id string, page_number int, text string")
    chunks = indexing.chunks_of(pages)
    assert sorted({r.page_number for r in chunks.collect()}) == [1, 3]
    assert [(r.chunks, r.points) for r in indexing.report(chunks).collect()] == [(3, 2)]
    old = spark.createDataFrame([("x", "d1", 0.0), ("y", "d2", 0.0)], "point_id string, document_id string, v double")
    found = indexing.reindex(old, chunks, lambda df: df.withColumn("v", F.lit(1.0)))
    assert {r.point_id for r in found["obsolete"].collect()} == {"x"}
    assert found["table"].groupBy("document_id").count().orderBy("document_id").collect()[0]["count"] == 2 and found["table"].filter("point_id = 'y'").count() == 1


def test_pages_and_limits(spark):
    rows = spark.range(45).select("id", F.lit(1).alias("same"))
    assert [r.id for r in relational.page(rows, [F.desc("same"), F.desc("id")], 2, 20).collect()] == list(range(24, 4, -1))
    for number, size in ((0, 20), (1, 101)):
        with pytest.raises(ValueError):
            relational.page(rows, [F.col("id")], number, size)
    assert relational.in_values(rows, "id", list(range(300)), keep=False).count() == 0
    assert relational.any_column_contains(spark.createDataFrame([("Éunmi 50%", None)], "a string, b string"), "eUNMI 50%", "a", "b").count() == 1


ALARM = (1, 7, 5, "MEDICATION", "MORNING", "t", "m", AT(2026, 8, 20, 8), "FREQ=DAILY", "Asia/Seoul", AT(2026, 8, 20, 8), "ACTIVE", None)


def test_poll(spark):
    alarms = [ALARM, (2, 8, *ALARM[2:]), (3, 9, *ALARM[2:8], None, *ALARM[9:]), (4, 7, *ALARM[2:12], AT(2026, 8, 20, 8)), (5, 7, *ALARM[2:11], "PAUSED", None)]
    settings = spark.createDataFrame([(8, False, True, True), (7, True, True, True)], "user_id bigint, is_notify_medication boolean, is_notify_schedule boolean, is_notify_guide boolean")
    subs = spark.createDataFrame([(1, 7, "e", True), (2, 7, "f", True), (3, 7, "g", False), (4, 8, "h", True)], schemas.SUBSCRIPTION)
    found = machines.poll(spark.createDataFrame(alarms, schemas.ALARM), settings, subs, F.lit(AT(2026, 8, 20, 9)))
    assert {r.idempotency_key for r in found["jobs"].collect()} == {f"alarm:1:{i}:2026-08-20T08:00:00+00:00" for i in (1, 2)}
    assert {(r.alarm_id, r.event_type, r.error_code) for r in found["events"].collect()} == {(2, "SKIPPED", None), (3, "FAILED", "NO_ACTIVE_SUBSCRIPTION")}
    assert {(r.id, r.next_trigger_at, r.last_triggered_at) for r in found["alarms"].collect()} == {(1, AT(2026, 8, 21, 8), AT(2026, 8, 20, 8)), (2, AT(2026, 8, 21, 8), AT(2026, 8, 20, 8)), (3, AT(2026, 8, 20, 8), AT(2026, 8, 20, 8))}


def fold(spark, actions, moves, start, **more):
    rows = spark.createDataFrame([(k, i, a) for k, steps in actions.items() for i, a in enumerate(steps)], "k string, at int, a string")
    return {r.k: tuple(r)[1:] for r in machines.fold_actions(rows, "k", ["at"], "a", moves, start, **more).collect()}


def test_machines(spark):
    got = fold(spark, {"a": ["PAUSE", "RESUME", "SKIP"], "b": ["COMPLETE", "COMPLETE", "CANCEL"], "c": ["CANCEL", "RESUME", "CANCEL"], "d": ["PAUSE", "SKIP", "PAUSE"]}, machines.ALARM_MOVES, "ACTIVE")
    assert got == {"a": ("ACTIVE", 3, 0), "b": ("COMPLETED", 2, 1), "c": ("CANCELLED", 2, 1), "d": ("PAUSED", 1, 2)}
    tries = ["CLAIM", "RETRYABLE"] * 4
    assert fold(spark, {"a": tries, "b": ["CLAIM", "SUCCESS", "CANCEL"], "c": ["CANCEL", "CLAIM"]}, machines.JOB_MOVES, "QUEUED", most_retries=3) == {"a": ("FAILED", 8, 0, 4), "b": ("COMPLETED", 2, 1, 0), "c": ("CANCELLED", 1, 1, 0)}


def test_push_kinds(spark):
    rows = [(None, False, "SUCCESS"), (202, False, "SUCCESS"), (204, False, "PERMANENT_FAILURE"), (404, False, "EXPIRED"), (410, False, "EXPIRED"), (429, False, "RETRYABLE"), (503, False, "RETRYABLE"), (400, False, "PERMANENT_FAILURE"), (None, True, "RETRYABLE")]
    got = spark.createDataFrame(rows, "c int, t boolean, k string").select("k", machines.push_kind(F.col("c"), F.col("t")).alias("g")).collect()
    assert all(r.k == r.g for r in got)


def test_recovery(spark):
    key = "alarm:1:2:2026-08-20T08:00:00+00:00"
    old, now = AT(2026, 8, 20, 8), AT(2026, 8, 20, 9)
    job = lambda i, k=key, status="QUEUED", table=None, ref=None, parent=None, retries=0, kind="ALARM", at=old: (i, k, kind, status, 1, table, ref, at, None, None, None, retries, 3, parent, None, at)
    jobs = [job(1), job(2, table="alarm_events", ref=50), job(3, parent=2, k="y"), job(4, parent=99), job(5, k="broken"), job(6, kind="OCR"), job(7, at=now), job(8, status="RETRY_WAITING", retries=9), job(9, table="alarm_events", ref=77), job(10, k=key + ":manual:z")]
    events = spark.createDataFrame([(50, 4, "FAILED", 6, AT(2026, 8, 20, 8, 30), None, None)], schemas.ALARM_EVENT)
    got = machines.recover(spark.createDataFrame(jobs, schemas.JOB), events, F.lit(now)).collect()
    assert {tuple(r) for r in got} == {(1, 1, 2, old), (10, 1, 2, old), (2, 4, 6, AT(2026, 8, 20, 8, 30)), (3, 4, 6, AT(2026, 8, 20, 8, 30))}


def test_acknowledgements(spark):
    rows = [(1, 1, "DELIVERED"), (1, 2, "SENT"), (1, 3, "DELIVERED"), (1, 4, "DELIVERED"), (2, 1, "SENT")]
    got = {r.k: r for r in machines.acknowledge(spark.createDataFrame(rows, "k int, at int, event_type string"), ["k"], ["at"]).collect()}
    assert got[1].delivered.at == 3 and got[1].refused == 1 and got[2].delivered is None


def test_constraints(spark):
    alarms = spark.createDataFrame([ALARM, (2, *ALARM[1:3], "GUIDE_CHECK", *ALARM[4:])], schemas.ALARM)
    assert [tuple(r) for r in quality.violations(alarms, quality.catalogue()["alarms"], "id").collect()] == [(2, "meal_slot")]
    names = ["id int", "source_type string", "patient_source_kind string", "patient_field string", *(f"{c} bigint" for c in ("medication_id", "care_advice_id", "follow_up_visit_id")), *(f"{c} string" for c in quality.PUBLIC_FIELDS if c != "source_page_number"), "source_page_number int", "citation_order int"]
    row = lambda i, **given: tuple(given.get(n.split()[0], i if n == "id int" else 1 if n.startswith("citation") else None) for n in names)
    public = {"public_dataset_key": "k", "dataset_version": "v", "vector_chunk_id": "c", "source_record_key": "r"}
    rows = [row(1, source_type="PATIENT_SAVED_FIELD", patient_source_kind="MEDICATION", medication_id=4), row(2, source_type="PATIENT_SAVED_FIELD", patient_source_kind="MEDICATION", care_advice_id=4), row(3, source_type="PUBLIC_RAG_CHUNK", **public), row(4, source_type="PUBLIC_RAG_CHUNK", medication_id=3, **public), row(5, source_type="PUBLIC_RAG_CHUNK")]
    got = quality.violations(spark.createDataFrame(rows, ", ".join(names)), quality.catalogue()["sources"], "id").collect()
    assert {tuple(r) for r in got} == {(2, "union"), (4, "union"), (5, "union")}
    jobs = spark.createDataFrame([(1, "j", "a.JSON", 10, 2), (2, " ", "a.txt", 10, 10)], "id int, job_id string, manifest_path string, chunk_size int, chunk_overlap int")
    assert {tuple(r) for r in quality.violations(jobs, quality.catalogue()["index_jobs"], "id").collect()} == {(2, "job_id"), (2, "manifest_path"), (2, "overlap")}
    assert quality.violation_counts(jobs, quality.catalogue()["index_jobs"]).first().asDict() == {"job_id": 1, "manifest_path": 1, "overlap": 1}


CONTEXT = (1, 100, ["고혈압"], "수술", datetime.date(2026, 8, 1), 7, None, None, "f" * 64, AT(2026, 8, 1), [(1001, "테스트정", "1정", 2, None, 7, None)], [(11, "b", 2, "PRECAUTION"), (12, "a", 1, "WARNING_SIGN"), (None, "c", 3, None)], [(21, AT(2026, 8, 20, 10), "내과", None, None, "검사", None)])


def test_assembly(spark):
    context = spark.createDataFrame([CONTEXT], schemas.PATIENT_CONTEXT)
    none = F.array().cast("array<string>")
    say = lambda intent, route="PATIENT_ONLY": context.select(assembly.answer(F.lit(intent), F.lit(route), F.array(F.lit("g")), F.array(F.lit("p")), none)).first()[0]
    assert say("PATIENT_FACT") == f"환자 확정정보\n- 진단명: 고혈압\n- 수술/시술: 수술\n- 퇴원일: 2026-08-01\n\n{assembly.NOTICE}"
    assert say("LIFESTYLE", "PATIENT_AND_RAG") == f"환자 확정정보\n- a\n- b\n- c\n\n공공자료 추가 설명\n- p\n\n{assembly.NOTICE}"
    assert say("GENERAL") == f"안내\n- g\n\n{assembly.NOTICE}" and "- a\n\n" in say("WARNING_SIGN")
    cited = assembly.numbered(context, assembly.patient_citations(F.lit("LIFESTYLE")), "user_id").orderBy("citation_order").collect()
    assert [(r.citation_order, r.kind, r.ref) for r in cited] == [(1, "CARE_ADVICE", "11"), (2, "CARE_ADVICE", "12")]
    terms = assembly.search_terms(F.lit(" stroke "), F.lit("medication"), F.col("diagnoses"), F.transform("medications", lambda m: m["name"]))
    assert context.select(terms).first()[0] == "STROKE 고혈압 테스트정 퇴원 후 복약 주의사항"
    payload = spark.createDataFrame([ALARM], schemas.ALARM).select(assembly.push_payload(F.array(F.lit("a"), F.lit("b")))).first()[0]
    assert '"body":"a, b 복용 시간입니다."' in payload and '"triggerAt":"2026-08-20T08:00:00+00:00"' in payload


def test_readers(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "m.json").write_text('{"documents": [{"file_path": "a.pdf", "document_id": "d1"}]}')
    assert readers.manifest(spark, str(tmp_path / "m.json")).first().file_path == f"{tmp_path}/a.pdf"
    for body in ('{"file_path": "a.pdf", "document_id": "d"}, {"file_path": "a.pdf", "document_id": "d"}', '{"file_path": "b.pdf", "document_id": "d"}', '{"file_path": "m.json", "document_id": "d"}'):
        (tmp_path / "n.json").write_text(f'{{"documents": [{body}]}}')
        with pytest.raises(ValueError):
            readers.manifest(spark, str(tmp_path / "n.json"))
    files = spark.createDataFrame([("a", bytearray(b"one|  |three"))], "path string, content binary")
    assert [(r.page_number, r.text) for r in readers.pages(files, lambda b: b.decode().split("|")).collect()] == [(1, "one"), (3, "three")]
    (tmp_path / "p.json").write_text('{"user_id": 1, "care_episode_id": 100, "diagnoses": ["x"]}')
    assert readers.patient_context(spark, str(tmp_path / "p.json"), 1, 100).first().diagnoses == ["x"]
    with pytest.raises(ValueError):
        readers.patient_context(spark, str(tmp_path / "p.json"), 2, 100)


def test_sinks(spark, tmp_path):
    guides = spark.createDataFrame([(1, 100)], "guide_id int, care_episode_id int")
    sources = spark.createDataFrame([(1, "PATIENT_SAVED_FIELD", "MEDICATION", "7")], "guide_id int, source_type string, kind string, ref string")
    owned = spark.createDataFrame([(100, "MEDICATION", "7")], "care_episode_id int, kind string, ref string")
    done = sinks.publish_guides(guides, sources, owned, str(tmp_path / "g"))
    assert spark.read.parquet(f"{done}/sources").count() == 1
    with pytest.raises(ValueError):
        sinks.publish_guides(guides, sources, owned.filter("false"), str(tmp_path / "h"))
    assert not (tmp_path / "h").exists()
    sinks.write_csv(spark.createDataFrame([(1, 'a"b'), (2, "x\ny")], "id int, t string"), ["id", "t"], str(tmp_path / "c"))
    (file,) = (tmp_path / "c").glob("part-*")
    assert file.read_bytes().decode() == '﻿id,t\r\n1,"a""b"\r\n2,"x\ny"\r\n'
    with pytest.raises(ValueError):
        sinks.write_csv(guides.filter("false"), ["guide_id"], str(tmp_path / "d"))


def test_index_jobs_stream(spark, tmp_path):
    """Success, rejection, retry and dead letter, and no message twice after a restart."""
    inbox = tmp_path / "in"
    inbox.mkdir()
    message = lambda i, **f: {"message_id": i, "fields": {"job_id": i, "job_type": "PUBLIC_GUIDELINE_INDEX", "manifest_path": "m.json", **f}}
    import json

    (inbox / "1.json").write_text("\n".join(json.dumps(m) for m in (message("good"), message("bad", chunk_size="x"), message("fails"))))

    def handle(df):
        failed = F.when(F.col("message_id") == "fails", "IndexError")
        return df.withColumn("failure_type", failed).withColumn("failure_message", F.when(failed.isNotNull(), "no"))

    def go():
        index_jobs.run(readers.messages(spark, str(inbox)), handle, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()

    go()
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
    assert [r.message_id for r in read("done").collect()] == ["good"] and [r.message_id for r in read("rejected").collect()] == ["bad"]
    dead = read("dead").collect()
    assert [r.message_id for r in dead] == ["fails"] and dead[0].fields["original_message_id"] == "fails" and dead[0].fields["failure_type"] == "IndexError"
    (inbox / "2.json").write_text(json.dumps(message("later")))
    go()
    assert sorted(r.message_id for r in read("done").collect()) == ["good", "later"]
