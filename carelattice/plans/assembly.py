"""Search queries, citations, answers, guides and push payloads from patient records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import collections, dates, text

#: What a topic is called in a search, and the topic of each intent that has one.
TOPIC_LABELS = {"MEDICATION": "퇴원 후 복약 주의사항", "LIFESTYLE": "퇴원 후 생활관리 및 회복", "WARNING_SIGN": "퇴원 후 위험 신호", "FOLLOW_UP": "퇴원 후 추적 진료"}
TOPIC_OF_INTENT = {"MEDICATION": "MEDICATION", "WARNING_SIGN": "WARNING_SIGN", "LIFESTYLE": "LIFESTYLE"}
#: Titles and notices of answers.
TITLES = {"patient": "환자 확정정보", "general": "안내", "public": "공공자료 추가 설명", "lifestyle": "AI 생성 일반 안내"}
NOTICE = "이 안내는 의료진의 진료를 대체하지 않습니다. 복약 변경이나 증상 판단이 필요한 경우 의료진 또는 의료기관에 문의하세요."
RESTRICTED_NOTICE = "안전성 확인이 필요한 추가 안내를 제한했습니다. 사용자가 확인한 복약정보, 의료진 권고사항 및 진료 일정만 제공됩니다."
BLOCKED_NOTICE = "안전성 검사를 통과하지 못해 현재 안내를 제공할 수 없습니다. 의료진 또는 의료기관에 문의하세요."


def search_terms(condition: Column, topic: Column, diagnoses: Column, names: Column, labels: dict[str, str] | None = None) -> Column:
    """Condition, diagnoses, medication names for that topic, and the topic's label: stripped, each once, joined."""
    topic_key, none = text.upper_key(topic), F.array().cast("array<string>")
    terms = F.concat(F.array(text.upper_key(condition)), F.coalesce(diagnoses, none), F.when(topic_key == "MEDICATION", F.coalesce(names, none)).otherwise(none), F.array(collections.lookup(labels or TOPIC_LABELS, topic_key)))
    kept = F.filter(F.transform(terms, text.strip), lambda t: t.isNotNull() & (t != ""))
    return F.array_join(F.array_distinct(kept), " ")


def chat_search(route: Column, query: Column, intent: Column, condition: Column, care_phase: Column) -> Column:
    """The search of a question; null unless its route asks for one and it has a query."""
    topic = F.create_map(*(F.lit(x) for pair in TOPIC_OF_INTENT.items() for x in pair))[intent]
    return F.when((route == "PATIENT_AND_RAG") & query.isNotNull(), F.struct(query.alias("query"), text.upper_key(condition).alias("condition"), text.upper_key(care_phase).alias("care_phase"), topic.alias("topic")))


def patient_lines(intent: Column) -> Column:
    """What an answer may state of a patient (a row of PATIENT_CONTEXT), by the question's intent."""
    facts = F.array_compact(F.array(
        F.when(F.size("diagnoses") > 0, F.concat(F.lit("진단명: "), F.array_join("diagnoses", ", "))),
        F.when(F.col("surgery") != "", F.concat(F.lit("수술/시술: "), F.col("surgery"))),
        F.concat(F.lit("퇴원일: "), F.date_format("discharge_date", "yyyy-MM-dd")),
    ))
    in_order = F.array_sort(F.transform("instructions", lambda x, i: F.struct(x["display_order"], i, x["content"].alias("content"))))
    warnings = F.filter("instructions", lambda x: F.coalesce(x["instruction_type"] == "WARNING_SIGN", F.lit(False)))
    return (
        F.when(intent == "PATIENT_FACT", facts)
        .when(intent == "MEDICATION", F.transform("medications", text.medication_line))
        .when(intent == "FOLLOW_UP", F.filter(F.transform("follow_up_schedules", text.follow_up_line), lambda x: x != ""))
        .when(intent == "LIFESTYLE", F.transform(in_order, lambda x: x["content"]))
        .when(intent == "WARNING_SIGN", F.transform(warnings, lambda x: x["content"]))
        .otherwise(F.array().cast("array<string>"))
    )


def answer(intent: Column, route: Column, general: Column, public: Column, lifestyle: Column) -> Column:
    """The sections that apply, and the notice."""
    return text.document(
        text.section(TITLES["patient"], patient_lines(intent)),
        F.when(intent == "GENERAL", text.section(TITLES["general"], general)),
        F.when(route == "PATIENT_AND_RAG", text.section(TITLES["public"], public)),
        F.when(intent == "LIFESTYLE", text.section(TITLES["lifestyle"], lifestyle)),
        F.lit(NOTICE),
    )


def patient_citations(intent: Column) -> Column:
    """kind and reference of what an answer cites of the patient's record, in order."""
    cite = lambda kind, ids: F.transform(F.filter(ids, lambda i: i.isNotNull()), lambda i: F.struct(F.lit(kind).alias("kind"), i.cast("string").alias("ref")))
    fields = F.array_compact(F.array(F.when(F.size("diagnoses") > 0, "DIAGNOSIS"), F.when(F.col("surgery") != "", "SURGERY"), F.when(F.col("discharge_date").isNotNull(), "DISCHARGE_DATE")))
    return (
        F.when(intent == "PATIENT_FACT", cite("CARE_EPISODE_FIELD", fields))
        .when(intent == "MEDICATION", cite("MEDICATION", F.transform("medications", lambda m: m["medication_id"])))
        .when(intent.isin("LIFESTYLE", "WARNING_SIGN"), cite("CARE_ADVICE", F.transform("instructions", lambda x: x["care_advice_id"])))
        .when(intent == "FOLLOW_UP", cite("FOLLOW_UP_VISIT", F.transform("follow_up_schedules", lambda v: v["follow_up_visit_id"])))
        .otherwise(F.array().cast("array<struct<kind: string, ref: string>>"))
    )


#: A citation of either kind, in the columns that constraints are stated for.
CITATION = """source_type string, patient_source_kind string, patient_field string, medication_id bigint, care_advice_id bigint, follow_up_visit_id bigint,
    public_dataset_key string, dataset_version string, vector_chunk_id string, source_record_key string, source_field string, chunk_type string, source_title string,
    source_organization string, source_url string, source_page_number int, source_license string, similarity_score double"""
_CITED = "array<struct<" + ", ".join(": ".join(f.rsplit(" ", 1)) for f in CITATION.replace("\n", " ").split(", ")) + ">>"


def _citation(**given: Column) -> Column:
    """A citation with these fields; the others are null."""
    kinds = [f.strip().rsplit(" ", 1) for f in CITATION.replace("\n", " ").split(",")]
    return F.struct(*((given[name] if name in given else F.lit(None)).cast(kind).alias(name) for name, kind in kinds))


#: Which column of a citation holds the reference of a kind.
REFERENCE = {"CARE_EPISODE_FIELD": "patient_field", "MEDICATION": "medication_id", "CARE_ADVICE": "care_advice_id", "FOLLOW_UP_VISIT": "follow_up_visit_id"}


def citations(intent: Column, route: Column, public_information: Column, chunks: Column) -> Column:
    """All that an answer cites, in order: of the patient's record, then, where public information was asked for and shown, its chunks.

    ``chunks`` are retrieved points: point_id, score and metadata.
    """
    own = F.transform(patient_citations(intent), lambda c: _citation(
        source_type=F.lit("PATIENT_SAVED_FIELD"), patient_source_kind=c["kind"], **{column: F.when(c["kind"] == kind, c["ref"]) for kind, column in REFERENCE.items()},
    ))
    public = F.transform(chunks, lambda c: _citation(
        source_type=F.lit("PUBLIC_RAG_CHUNK"), public_dataset_key=c["metadata"]["dataset_key"], dataset_version=c["metadata"]["dataset_version"], vector_chunk_id=c["point_id"], source_record_key=c["metadata"]["document_id"],
        source_field=c["metadata"]["section_title"], chunk_type=c["metadata"]["topic"], source_title=c["metadata"]["title"], source_organization=c["metadata"]["organization"], source_url=c["metadata"]["source_url"],
        source_page_number=c["metadata"]["page_number"], source_license=c["metadata"]["license"], similarity_score=c["score"],
    ))
    shown = F.coalesce((route == "PATIENT_AND_RAG") & (F.size(public_information) > 0), F.lit(False))
    return F.concat(own, F.when(shown & chunks.isNotNull(), public).otherwise(F.array().cast(_CITED)))


def recovery_guide(public_information: Column, lifestyle: Column) -> Column:
    """A recovery guide of a patient (a row of PATIENT_CONTEXT): what the record says, what was added to it, and the notice.

    Instructions stand in display_order, those of one order as they came.
    """
    none = F.array().cast("array<string>")
    in_order = F.array_sort(F.transform("instructions", lambda x, i: F.struct(x["display_order"], i, x["content"].alias("content"))))
    return F.struct(
        F.coalesce(F.transform("medications", text.medication_line), none).alias("medication_guide"), F.coalesce(F.transform(in_order, lambda x: x["content"]), none).alias("patient_instructions"),
        F.coalesce(public_information, none).alias("public_information"), F.coalesce(lifestyle, none).alias("lifestyle_guide"), none.alias("warning_signs"),
        F.coalesce(F.transform("follow_up_schedules", text.follow_up_line), none).alias("follow_up_schedule"), F.lit(NOTICE).alias("safety_notice"),
    )


def numbered(df: DataFrame, citations: Column, *keep: str) -> DataFrame:
    """One row per citation with its order from 1."""
    return df.select(*keep, F.posexplode(citations).alias("_at", "_c")).select(*keep, (F.col("_at") + 1).alias("citation_order"), "_c.*")


def push_payload(names: Column) -> Column:
    """The message of an alarm row as JSON; a medication alarm names its medications."""
    named = F.concat(F.array_join(names, ", "), F.lit(" 복용 시간입니다."))
    body = F.when((F.col("alarm_type") == "MEDICATION") & (F.size(names) > 0), named).otherwise(F.coalesce(F.nullif("message", F.lit("")), "title"))
    fields = F.struct(F.col("id").alias("alarmId"), "title", body.alias("body"), F.col("alarm_type").alias("alarmType"), F.col("meal_slot").alias("mealSlot"), dates.iso_text(F.col("next_trigger_at")).alias("triggerAt"))
    return F.to_json(fields, {"ignoreNullFields": "false"})


def low_confidence(fields: dict[str, Column], medications: Column, advices: Column) -> Column:
    """Names of the recognised fields that are unsure, then one entry for each unsure medication and advice."""
    unsure = F.array_compact(F.array(*(F.when(confidence == "low", name) for name, confidence in fields.items())))
    of = lambda rows, name: F.transform(F.filter(rows, lambda r: r["confidence"] == "low"), lambda r: F.lit(name))
    return F.concat(unsure, of(medications, "medication"), of(advices, "advice"))


def from_legacy(m: Column) -> Column:
    """A medication given in older field names: numbers are read from their wording, the note from the instruction."""
    return F.struct(
        F.coalesce(m["name"], m["drug_name"]).alias("name"), m["dose"].alias("dose"),
        F.coalesce(m["times_per_day"], collections.first_integer(m["frequency"])).alias("times_per_day"),
        F.coalesce(m["note"], m["administration_instruction"]).alias("note"), F.coalesce(m["days"], collections.first_integer(m["duration"])).alias("days"),
    )


def visit_from_legacy(v: Column) -> Column:
    """A follow-up visit given in older field names beside or in place of the newer ones: scheduled_at for visit_at, description for purpose."""
    return F.struct(
        v["follow_up_visit_id"].alias("follow_up_visit_id"), F.coalesce(v["visit_at"], v["scheduled_at"]).alias("visit_at"), v["department"].alias("department"), v["doctor_name"].alias("doctor_name"),
        v["place"].alias("place"), F.coalesce(v["purpose"], v["description"]).alias("purpose"), v["institution_name"].alias("institution_name"),
    )
