"""Constraints as data: named conditions, violations, guards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(name: str) -> Column:
    return F.col(name)


def after_or_null(later: str, earlier: str) -> Column:
    return col(later).isNull() | (col(later) >= col(earlier))


def all_or_none(*names: str) -> Column:
    given = sum((col(n).isNotNull().cast("int") for n in names[1:]), col(names[0]).isNotNull().cast("int"))
    return given.isin(0, len(names))


def hex64(name: str) -> Column:
    return col(name).rlike(r"^[0-9a-f]{64}\z")


def when_status(status: str, **needed: dict[str, bool]) -> Column:
    """For each status, which columns must (True) or mustn't (False) be given."""
    ok = F.lit(True)
    for value, columns in needed.items():
        fits = F.lit(True)
        for name, given in columns.items():
            fits = fits & (col(name).isNotNull() if given else col(name).isNull())
        ok = ok & ((col(status) != value) | fits)
    return ok


#: The columns of the two kinds of citations, and the one of each kind of the patient's.
PATIENT_FIELDS = ("patient_source_kind", "patient_field", "medication_id", "care_advice_id", "follow_up_visit_id")
PUBLIC_KEYS = ("public_dataset_key", "dataset_version", "vector_chunk_id", "source_record_key")
PUBLIC_FIELDS = (*PUBLIC_KEYS, "source_field", "chunk_type", "source_title", "source_organization", "source_url", "source_page_number", "source_license", "similarity_score")
KIND_COLUMN = {"CARE_EPISODE_FIELD": "patient_field", "MEDICATION": "medication_id", "CARE_ADVICE": "care_advice_id", "FOLLOW_UP_VISIT": "follow_up_visit_id"}


def _none(names) -> Column:
    return F.coalesce(*(col(n).cast("string") for n in names)).isNull()


def source_union() -> Column:
    """A citation is either of the patient's record, of exactly one kind, or of a public chunk, never both."""
    one_kind = F.lit(False)
    for kind, column in KIND_COLUMN.items():
        others = [c for c in KIND_COLUMN.values() if c != column]
        one_kind = one_kind | ((col("patient_source_kind") == kind) & col(column).isNotNull() & _none(others))
    public = F.lit(True)
    for name in PUBLIC_KEYS:
        public = public & col(name).isNotNull()
    patient_row = (col("source_type") == "PATIENT_SAVED_FIELD") & one_kind & _none(PUBLIC_FIELDS)
    public_row = (col("source_type") == "PUBLIC_RAG_CHUNK") & public & _none(PATIENT_FIELDS)
    return F.coalesce(patient_row | public_row, F.lit(False))


#: The error codes of failed and of cancelled OCR jobs.
FAILURE_CODES = ("OCR_PROVIDER_ERROR", "OCR_PROVIDER_TIMEOUT", "EXTRACTION_FAILED", "VALIDATION_FAILED", "WORKER_INTERRUPTED")
CANCEL_CODES = ("USER_CANCELLED", "REVIEW_EXPIRED")
#: Table -> unique keys: no two rows with all of a key's columns given may have them alike.
UNIQUE_KEYS = {
    "users": {"email": ["email"]},
    "push_subscriptions": {"endpoint": ["endpoint"]},
    "alarms": {"user_alarm_slot": ["user_id", "alarm_type", "meal_slot"]},
    "background_jobs": {"idempotency_key": ["idempotency_key"]},
    "care_advices": {"display_order": ["care_episode_id", "display_order"]},
    "chat_messages": {"sequence_no": ["chat_session_id", "sequence_no"]},
    "chat_sources": {"citation_order": ["chat_message_id", "citation_order"]},
    "guide_sources": {"citation_order": ["recovery_guide_id", "citation_order"]},
    "medication_slots": {"slot": ["medication_id", "slot"]},
}
#: Table -> column -> table whose ``id`` it must name where it is given.
FOREIGN_KEYS = {
    "push_subscriptions": {"user_id": "users"},
    "alarms": {"user_id": "users", "care_episode_id": "care_episodes", "follow_up_visit_id": "follow_up_visits"},
    "alarm_events": {"alarm_id": "alarms", "push_subscription_id": "push_subscriptions"},
    "background_jobs": {"user_id": "users", "parent_job_id": "background_jobs"},
    "care_episodes": {"user_id": "users"},
    "care_advices": {"care_episode_id": "care_episodes"},
    "follow_up_visits": {"care_episode_id": "care_episodes"},
    "medications": {"care_episode_id": "care_episodes"},
    "medication_slots": {"medication_id": "medications"},
    "ocr_jobs": {"care_episode_id": "care_episodes"},
    "recovery_guides": {"care_episode_id": "care_episodes"},
    "chat_sessions": {"user_id": "users", "care_episode_id": "care_episodes"},
    "chat_messages": {"chat_session_id": "chat_sessions", "reply_to_message_id": "chat_messages"},
}


def catalogue() -> dict[str, dict[str, Column]]:
    """Table -> constraint -> condition that every row must meet (null counts as met, as in SQL's CHECK)."""
    return {
        "care_episodes": {
            "end_after_start": after_or_null("default_end_at", "started_at") & after_or_null("planned_end_at", "started_at") & after_or_null("completed_at", "started_at"),
            "medication_days": col("medication_days").isNull() | col("medication_days").between(1, 365),
            "confirmation": all_or_none("source_ocr_job_id", "confirmed_at", "confirmation_hash"),
        },
        "care_advices": {"display_order": col("display_order") >= 1},
        "medications": {
            "times_per_day": col("times_per_day").isNull() | col("times_per_day").between(1, 6),
            "days": col("days").isNull() | col("days").between(1, 365),
            "as_needed_note": col("times_per_day").isNotNull() | col("note").isNotNull(),
        },
        "background_jobs": {"retry_count": col("retry_count") >= 0},
        "alarms": {"meal_slot": (col("alarm_type") == "MEDICATION") == col("meal_slot").isNotNull()},
        "ocr_jobs": {
            "structured_status": col("structured_result").isNull() | (col("status") == "READY_FOR_REVIEW"),
            "ready_payload": when_status("status", READY_FOR_REVIEW={"structured_result": True, "ready_at": True, "expires_at": True}),
            "error_code": F.when(col("status") == "FAILED", F.coalesce(col("error_code").isin(*FAILURE_CODES), F.lit(False)))
            .when(col("status") == "CANCELLED", F.coalesce(col("error_code").isin(*CANCEL_CODES), F.lit(False)))
            .otherwise(col("error_code").isNull()),
            "completed_at": col("status").isin("COMPLETE", "FAILED", "CANCELLED") == col("completed_at").isNotNull(),
            "status_timestamps": when_status(
                "status", QUEUED={"started_at": False, "ready_at": False, "expires_at": False}, PROCESSING={"started_at": True, "ready_at": False, "expires_at": False}, READY_FOR_REVIEW={"started_at": True, "ready_at": True, "expires_at": True}
            ),
            "started_at": after_or_null("started_at", "created_at"),
            "ready_at": col("ready_at").isNull() | (col("started_at").isNotNull() & (col("ready_at") >= col("started_at"))),
            "completed_order": col("completed_at").isNull() | (col("completed_at") >= F.coalesce("started_at", "created_at")),
            "expires_at": col("expires_at").isNull() | col("ready_at").isNull() | (col("expires_at") > col("ready_at")),
        },
        "sources": {"union": source_union(), "citation_order": col("citation_order") >= 1, "page": col("source_page_number").isNull() | (col("source_page_number") >= 1)},
        "recovery_guides": {
            "safety_complete": col("safety_status") != "PENDING",
            "superseded": ((col("status") == "COMPLETED") & col("superseded_at").isNull()) | ((col("status") == "SUPERSEDED") & col("superseded_at").isNotNull()),
            "context_hash": hex64("patient_context_hash"),
        },
        "classifications": {
            "route": col("needs_clarification") == col("route").isNull(),
            "query": (col("route") == "PATIENT_AND_RAG") == col("normalized_query").isNotNull(),
            "reasons": (col("risk_level") != "HIGH") | (F.size("reason_codes") > 0),
        },
        "index_jobs": {
            "job_id": F.trim("job_id") != "",
            "manifest_path": F.endswith(F.lower("manifest_path"), F.lit(".json")),
            "overlap": (col("chunk_size") > 0) & (col("chunk_overlap") >= 0) & (col("chunk_overlap") < col("chunk_size")),
        },
        "history": {"messages": F.size("messages") <= 10, "content": F.forall("messages", lambda m: F.char_length(m["content"]) <= 2000)},
    }


def violations(df: DataFrame, constraints: dict[str, Column], key: str) -> DataFrame:
    """key, constraint: one row for each constraint that a row breaks. One pass; rules are columns, not jobs."""
    broken = F.array_compact(F.array(*(F.when(~ok, name) for name, ok in constraints.items())))
    return df.select(key, F.explode(broken).alias("constraint"))


def all_given(*names: str) -> Column:
    given = F.lit(True)
    for n in names:
        given = given & col(n).isNotNull()
    return given


def key_violations(df: DataFrame, keys: dict[str, list[str]], key: str) -> DataFrame:
    """key, constraint: one row for each row whose unique key another row has too.

    All keys are counted in one shuffle, with partial counts, so a frequent value is no large group; rows then meet the repeated
    values only.
    """
    given = {n: F.when(all_given(*columns), F.to_json(F.struct(*columns))) for n, columns in keys.items()}
    each = F.explode(F.array_compact(F.array(*(F.when(v.isNotNull(), F.struct(F.lit(n).alias("constraint"), v.alias("value"))) for n, v in given.items())))).alias("k")
    listed = df.select(key, each).select(key, "k.*")
    repeated = listed.groupBy("constraint", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return listed.join(repeated, ["constraint", "value"]).select(key, "constraint")


def reference_violations(df: DataFrame, parents: dict[str, DataFrame], references: dict[str, str], key: str) -> DataFrame:
    """key, constraint: one row for each reference (column) that is given but names no row of its table."""
    found = [
        df.filter(col(column).isNotNull()).join(parents[parent].select(col("id").alias(column)), column, "left_anti").select(key, F.lit(column).alias("constraint"))
        for column, parent in references.items() if parent in parents
    ]
    return reduce(DataFrame.unionByName, found) if found else df.select(key, F.lit("").alias("constraint")).filter("false")


def table_violations(tables: dict[str, DataFrame], key: str = "id") -> DataFrame:
    """table, id, kind (CHECK, UNIQUE or REFERENCE), constraint: all that the given tables break of the whole catalogue."""
    checks, found = catalogue(), []
    for name, df in tables.items():
        kinds = {
            "CHECK": violations(df, checks[name], key) if name in checks else None,
            "UNIQUE": key_violations(df, UNIQUE_KEYS[name], key) if name in UNIQUE_KEYS else None,
            "REFERENCE": reference_violations(df, tables, FOREIGN_KEYS[name], key) if name in FOREIGN_KEYS else None,
        }
        found += [v.select(F.lit(name).alias("table"), F.col(key).alias("id"), F.lit(kind).alias("kind"), "constraint") for kind, v in kinds.items() if v is not None]
    return reduce(DataFrame.unionByName, found)


def clean_codes(codes: Column) -> Column:
    """Codes without white space around, without blank and repeated ones, in their order."""
    return F.array_distinct(F.filter(F.transform(codes, lambda c: F.trim(c)), lambda c: F.coalesce(c != "", F.lit(False))))


def violation_counts(df: DataFrame, constraints: dict[str, Column]) -> DataFrame:
    """One row with the number of rows that break each constraint."""
    return df.agg(*(F.count_if(~ok).alias(name) for name, ok in constraints.items()))


def all_absent(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: for each condition, does no row meet it? All guards in one pass."""
    return df.agg(*((F.count_if(c) == 0).alias(name) for name, c in conditions.items()))


def backfill(df: DataFrame, side: DataFrame, key: str, column: str) -> DataFrame:
    """Fill nulls of a column from a side with one row for each key."""
    joined = df.join(side.select(key, F.col(column).alias("_fill")), key, "left")
    return joined.withColumn(column, F.coalesce(column, "_fill")).drop("_fill")
