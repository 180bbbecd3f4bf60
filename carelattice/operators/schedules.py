"""Requests for alarms: their contract, and the first time after the scheduled one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates

#: What can be wrong with a request, in the order in which it is reported.
REQUEST_ERRORS = ("TITLE_LENGTH", "MESSAGE_LENGTH", "RULE_LENGTH", "MEAL_SLOT_REQUIRED", "MEAL_SLOT_NOT_ALLOWED", "INVALID_TIMEZONE", "TIME_WITHOUT_ZONE", "INVALID_RULE", "NO_OCCURRENCE")
#: An ISO 8601 time that says how far from UTC it is.
AWARE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[+-]\d{2}:?\d{2})$"


def _length(x: Column, least: int, most: int) -> Column:
    return F.char_length(x).between(least, most)


def checked_requests(requests: DataFrame) -> DataFrame:
    """Alarm requests with ``errors``, ``scheduled`` (the time as a timestamp) and ``upcoming`` (the rule's first occurrence after it).

    A request has title, message, alarm_type, meal_slot, scheduled_at (text), recurrence_rule and timezone. All errors of a request are
    listed, none ends the task. Occurrences keep the clock time of the request's zone; without a rule, or with an error in
    zone, time or rule, there is no upcoming one. An empty rule is none.
    """
    rule = F.nullif("recurrence_rule", F.lit(""))
    aware = F.coalesce(F.col("scheduled_at").rlike(AWARE), F.lit(False))
    whole = F.regexp_replace("scheduled_at", r"^(.{16})(Z|[+-])", "$1:00$2")
    timed = requests.withColumns({"_rule": rule, "scheduled": F.when(aware, F.try_to_timestamp(whole)), "_zone": dates.known_zone(F.col("timezone"))})
    timed = timed.withColumn("upcoming", dates.next_occurrence(F.col("_rule"), F.col("scheduled"), F.col("scheduled"), F.col("timezone")))
    timed = timed.withColumn("_valid", dates.rule_is_valid(F.when(F.col("scheduled").isNotNull(), F.col("_rule")), F.col("scheduled")))
    medication, slot = F.col("alarm_type") == "MEDICATION", F.col("meal_slot").isNotNull()
    wrong = {
        "TITLE_LENGTH": ~F.coalesce(_length(F.col("title"), 1, 255), F.lit(False)), "MESSAGE_LENGTH": F.char_length("message") > 500, "RULE_LENGTH": F.char_length("recurrence_rule") > 100,
        "MEAL_SLOT_REQUIRED": medication & ~slot, "MEAL_SLOT_NOT_ALLOWED": ~medication & slot, "INVALID_TIMEZONE": ~F.col("_zone"), "TIME_WITHOUT_ZONE": F.col("scheduled").isNull(),
        "INVALID_RULE": ~F.col("_valid"), "NO_OCCURRENCE": F.col("_valid") & F.col("_zone") & F.col("upcoming").isNull(),
    }
    errors = F.array_compact(F.array(*(F.when(wrong[code], code) for code in REQUEST_ERRORS)))
    return timed.withColumn("errors", errors).drop("_rule", "_zone", "_valid")


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests as new ACTIVE alarms, due at their scheduled time, and the others with their ``errors``."""
    checked = checked_requests(requests)
    good = checked.filter(F.size("errors") == 0).withColumns({"status": F.lit("ACTIVE"), "scheduled_at": F.col("scheduled"), "next_trigger_at": F.col("scheduled"), "last_triggered_at": F.lit(None).cast("timestamp")})
    return good.drop("errors", "scheduled", "upcoming"), checked.filter(F.size("errors") > 0).drop("scheduled", "upcoming")
