"""Row types of the care domain, as Spark DDL."""

from __future__ import annotations

MEDICATION = "struct<medication_id: bigint, name: string, dose: string, times_per_day: int, note: string, days: int, prescribed_at: date>"
INSTRUCTION = "struct<care_advice_id: bigint, content: string, display_order: int, instruction_type: string>"
FOLLOW_UP = "struct<follow_up_visit_id: bigint, visit_at: timestamp, department: string, doctor_name: string, place: string, purpose: string, institution_name: string>"

PATIENT_CONTEXT = f"""
    user_id bigint, care_episode_id bigint, diagnoses array<string>, surgery string, discharge_date date, medication_days int,
    medication_start_date date, medication_start_slot string, confirmation_hash string, confirmed_at timestamp,
    medications array<{MEDICATION}>, instructions array<{INSTRUCTION}>, follow_up_schedules array<{FOLLOW_UP}>
"""

GUIDELINE_METADATA = """struct<dataset_key: string, dataset_version: string, document_id: string, title: string, organization: string,
    publication_year: int, country: string, language: string, document_type: string, condition: string, care_phase: string, topic: string,
    section_title: string, page_number: int, source_url: string, license: string>"""

MANIFEST = """documents array<struct<file_path: string, document_id: string, title: string, organization: string, dataset_version: string,
    publication_year: int, language: string, condition: string, care_phase: string, topic: string, source_url: string, license: string>>"""

POINT = f"point_id string, vector array<float>, content string, metadata {GUIDELINE_METADATA}"

ALARM = """id bigint, user_id bigint, care_episode_id bigint, alarm_type string, meal_slot string, title string, message string,
    scheduled_at timestamp, recurrence_rule string, timezone string, next_trigger_at timestamp, status string, last_triggered_at timestamp"""

SUBSCRIPTION = "id bigint, user_id bigint, endpoint string, is_active boolean"

ALARM_EVENT = "id bigint, alarm_id bigint, event_type string, push_subscription_id bigint, event_at timestamp, payload string, error_code string"

JOB = """id bigint, idempotency_key string, job_type string, status string, user_id bigint, reference_table string, reference_id bigint,
    requested_at timestamp, started_at timestamp, completed_at timestamp, duration_ms int, retry_count int, max_retry_count int,
    parent_job_id bigint, error_code string, updated_at timestamp"""

INDEX_MESSAGE = "message_id string, fields map<string, string>"
