"""Expressions against plain restatements and the documented fixtures."""

import datetime
import hashlib
import json
import re
import uuid

import pytest
from pyspark.sql import functions as F

from carelattice import schemas
from carelattice.functions import collections, dates, identity, text, vectors


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def clean(x):
    x = re.sub(r"[ \t]+", " ", x.replace("\r\n", "\n").replace("\r", "\n"))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", x)).strip()


TEXTS = ["", "  a\t b \r\n\r\n\n\n c  ", "\xa0x　", "a\rb\r\nc", "one\n\n\n\ntwo", "  \n ", "가 나\t\t다!"]


def test_cleaning_and_keys(spark):
    rows = [(t,) for t in TEXTS]
    assert values(spark, text.clean_text(F.col("x")), rows, "x string") == [clean(t) for t in TEXTS]
    assert values(spark, text.collapse_spaces(F.col("x")), rows, "x string") == [re.sub(r"\s+", " ", t).strip() for t in TEXTS]
    assert values(spark, text.space_free_key(F.col("x")), rows, "x string") == [re.sub(r"\s+", "", t).lower() for t in TEXTS]
    assert values(spark, text.punctuation_free_key(F.col("x")), rows, "x string") == [re.sub(r"[\s.,!?]", "", t).lower() for t in TEXTS]
    assert values(spark, text.blank_to_null(F.col("x")), rows, "x string") == [t.strip() or None for t in TEXTS]


def test_medication_and_follow_up_lines(spark):
    m = [((1001, "테스트정", "1정", 2, "아침과 저녁 식사 후 복용", 7, None),), ((2, "b", "", None, None, None, None),)]
    assert values(spark, text.medication_line(F.col("m")), m, f"m {schemas.MEDICATION}") == ["테스트정 · 1정 · 1일 2회 · 아침과 저녁 식사 후 복용 · 7일", "b"]
    v = [((1, datetime.datetime(2026, 8, 20, 10, 0), "내과", None, "", "검사", None),), ((2, None, "내과", None, "", None, "병원"),), ((3, None, None, "의사", "2층", None, "병원"),)]
    assert values(spark, text.follow_up_line(F.col("v")), v, f"v {schemas.FOLLOW_UP}") == ["2026-08-20 10:00 · 내과 · 검사", "내과 · 병원", "의사 · 2층"]


def test_sections(spark):
    body = text.document(text.section("t", F.col("x")), text.section("u", F.array(F.lit(" "))), F.lit("end"))
    assert values(spark, body, [([" a ", "", "b"],), ([],)], "x array<string>") == ["t\n- a\n- b\n\nend", "end"]


def test_formats(spark):
    phones = ["010-1234-5678", "01012345678", "+821012345678", "010-12345678", "+82 10", "01012345678\n"]
    assert values(spark, text.is_phone(F.col("x")), [(p,) for p in phones], "x string") == [True, True, True, False, False, False]
    assert values(spark, text.normalize_phone(F.col("x")), [(p,) for p in phones[:3]], "x string") == ["01012345678"] * 3
    assert values(spark, text.missing_password_classes(F.col("x")), [("Abc1!",), ("Abcdefg1!",), ("가나다라마바사아",)], "x string") == [["short"], [], ["upper", "lower", "digit"]]
    assert values(spark, text.is_email(F.col("x")), [("a@b.c",), ("a b@c.d",), ("a@b",)], "x string") == [True, False, False]


def test_keys_of_alarms(spark):
    keys = ["alarm:1:2:2026-08-20T08:00:00+09:00", "alarm:1:2:2026-08-20T08:00:00+09:00:manual:ff", "x:1:2:3", "alarm:a:2:3", "alarm:1:2"]
    got = values(spark, text.parse_alarm_key(F.col("x")), [(k,) for k in keys], "x string")
    assert [g and tuple(g) for g in got] == [(1, 2, "2026-08-20T08:00:00+09:00")] * 2 + [None] * 3


def test_slots(spark):
    rows = [(2, "아침·저녁 식후"), (1, "저녁 식후"), (None, "식후"), (1, "취침 전"), (3, "아침"), (2, "아침"), (5, "자기 전")]
    got = values(spark, text.default_slots(F.col("n"), F.col("t")), rows, "n int, t string")
    every = ["morning", "lunch", "evening", "bedtime"]
    assert got == [["morning", "evening"], ["evening"], [], ["bedtime"], every[:3], ["morning", "evening"], every]
    assert values(spark, text.is_rising(F.col("x")), [(["08:00", "13:00"],), (["08:00", "08:00"],), ([],)], "x array<string>") == [True, False, True]


def test_literal_patterns(spark):
    rows = [(["a+b", "a+b(c", "d"], "x a+b(c y"), ([], "d")]
    assert values(spark, text.alternatives(F.col("w")), rows, "w array<string>, t string") == [r"a\+b\(c|a\+b|d", None]
    assert values(spark, F.regexp_like("t", F.coalesce(text.alternatives(F.col("w")), F.lit("^$"))), rows, "w array<string>, t string") == [True, False]


def test_csv(spark):
    rows = [(1, 'say "hi"', None), (2, "a,b", "x\r\ny"), (3, "plain", "")]
    assert values(spark, text.csv_line(F.col("a"), F.col("b"), F.col("c")), rows, "a int, b string, c string") == ['1,"say ""hi""",', '2,"a,b","x\r\ny"', "3,plain,"]


def test_occurrences(spark):
    at = datetime.datetime
    rows = [("FREQ=DAILY", at(2026, 8, 20, 8), at(2026, 8, 20, 8)), ("FREQ=WEEKLY", at(2026, 8, 20, 8), at(2026, 8, 26, 9)), ("FREQ=DAILY", at(2026, 8, 20, 8), at(2026, 8, 1)), ("FREQ=DAILY;COUNT=1", at(2026, 8, 20, 8), at(2026, 8, 20, 8)), ("FREQ=MONTHLY;BYMONTHDAY=31", at(2026, 8, 20), at(2026, 9, 1)), (None, at(2026, 8, 20), at(2026, 8, 20))]
    got = values(spark, dates.next_occurrence(F.col("r"), F.col("s"), F.col("a")), rows, "r string, s timestamp, a timestamp")
    assert got == [at(2026, 8, 21, 8), at(2026, 8, 27, 8), at(2026, 8, 20, 8), None, at(2026, 10, 31), None]
    with pytest.raises(ValueError):
        dates.zone("Nowhere/None")
    assert str(dates.zone("Asia/Seoul")) == "Asia/Seoul"


def test_durations_and_windows(spark):
    at = datetime.datetime
    rows = [(at(2026, 1, 1), at(2026, 1, 1, 0, 0, 1, 999_900)), (at(2026, 1, 2), at(2026, 1, 1)), (None, at(2026, 1, 1))]
    assert values(spark, dates.duration_ms(F.col("s"), F.col("e")), rows, "s timestamp, e timestamp") == [1999, 0, None]
    assert values(spark, dates.backoff_seconds(F.col("n")), [(0,), (1,), (2,), (3,)], "n int") == [30, 30, 60, 120]
    day = datetime.date
    assert values(spark, dates.is_of_age(F.col("b"), F.lit(day(2026, 8, 20))), [(day(2012, 8, 19),), (day(2012, 8, 20),)], "b date") == [True, False]
    assert values(spark, dates.iso_text(F.col("t")), [(at(2026, 8, 20, 8),), (at(2026, 8, 20, 8, 0, 0, 120),)], "t timestamp") == ["2026-08-20T08:00:00+00:00", "2026-08-20T08:00:00.000120+00:00"]
    assert values(spark, dates.active_until(F.col("d"), F.lit(7)), [(day(2026, 8, 20),)], "d date") == [day(2026, 8, 26)]


def test_identity(spark):
    names = ["", "a", "한글", "x" * 500]
    assert values(spark, identity.uuid5(F.col("x")), [(n,) for n in names], "x string") == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    schema = "r struct<b: int, a: array<struct<z: string, y: int>>, c: string>"
    rows = [((1, [("가", 2), (None, None)], None),)]
    payload = {"b": 1, "a": [{"z": "가", "y": 2}, {"z": None, "y": None}], "c": None}
    own = hashlib.sha256(json.dumps(payload, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    kind = spark.createDataFrame(rows, schema).schema["r"].dataType
    assert values(spark, identity.context_hash(F.col("r"), kind), rows, schema) == [own]
    assert values(spark, identity.context_hash(F.col("r"), kind, F.lit("")), rows, schema) == [own]
    assert values(spark, identity.context_hash(F.col("r"), kind, F.lit("ff")), rows, schema) == ["ff"]


def test_vectors_and_collections(spark):
    rows = [([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 1.0]), (None, [1.0, 1.0])]
    got = values(spark, vectors.cosine(F.col("a"), F.col("b")), rows, "a array<float>, b array<float>")
    assert abs(got[0] - 0.5**0.5) < 1e-12 and got[1:] == [None] * 3
    assert values(spark, collections.toggle(F.col("x"), F.lit("b")), [(["a", "b"],), (["a"],)], "x array<string>") == [["a"], ["a", "b"]]
    merged = collections.merge_maps(F.col("l"), F.col("r"))
    assert values(spark, merged, [({"a": "1", "b": "2"}, {"b": "3"})], "l map<string,string>, r map<string,string>") == [{"a": "1", "b": "3"}]
    assert values(spark, collections.first_integer(F.col("x")), [("1일 3회",), ("none",)], "x string") == [1, None]
