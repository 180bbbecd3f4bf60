"""Dates and times: occurrences, durations, back-off, windows and ISO text."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta
from functools import cache
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError, available_timezones

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType, TimestampType

EPOCH = datetime(1970, 1, 1, tzinfo=UTC)
#: Seconds before the first retry; each further one doubles.
RETRY_BASE_SECONDS = 30


def zone(name: str) -> ZoneInfo:
    """The time zone, or ValueError if there is none of that name."""
    try:
        return ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError) as exc:
        raise ValueError(f"unknown time zone: {name}") from exc


@cache
def zone_names() -> list[str]:
    """The time zones that both Python and Spark's Java know; the three short names are fixed offsets that Spark adds to Java's."""
    java = SparkContext._active_spark_context._jvm.java.time.ZoneId.getAvailableZoneIds()
    return sorted(available_timezones() & {*java, "EST", "HST", "MST"})


def known_zone(name: Column) -> Column:
    """Is this the name of a time zone?"""
    return F.coalesce(name.isin(*zone_names()), F.lit(False))


@F.pandas_udf(StructType([StructField("micros", LongType()), StructField("valid", BooleanType())]))
def _next_by_rule(rule: pd.Series, start: pd.Series, after: pd.Series, name: pd.Series) -> pd.DataFrame:
    """By local clocks of the zone; times are microseconds since 1970. A rule that can't be read is not valid; neither it nor an unknown zone fails the task."""
    from dateutil.rrule import rrulestr

    found, known = [], {}
    for r, s, a, z in zip(rule, start, after, name, strict=True):
        if r is None or z is None or pd.isna(s) or pd.isna(a):
            found.append((None, None))
            continue
        try:
            own = ZoneInfo(z)
            local = lambda micros, own=own: (EPOCH + timedelta(microseconds=int(micros))).astimezone(own).replace(tzinfo=None)
            if (r, s, z) not in known:
                known[r, s, z] = rrulestr(r, dtstart=local(s))
            upcoming = known[r, s, z].after(local(a), inc=False)
        except (ValueError, TypeError, KeyError, ZoneInfoNotFoundError):
            found.append((None, False))
            continue
        found.append((upcoming and (upcoming.replace(tzinfo=own) - EPOCH) // timedelta(microseconds=1), True))
    return pd.DataFrame({"micros": pd.Series([x for x, _ in found], dtype="Int64"), "valid": pd.Series([v for _, v in found], dtype=object)})


#: Rules that are plain arithmetic, and their step in days.
PLAIN_RULES = {"FREQ=DAILY": 1, "FREQ=WEEKLY": 7}


def next_plain_occurrence(rule: Column, start: Column, after: Column) -> Column:
    """First occurrence of a plain daily or weekly rule strictly after ``after``, in the session's zone; null for other rules."""
    step = F.when(rule == "FREQ=DAILY", 1).when(rule == "FREQ=WEEKLY", 7)
    passed = F.floor(F.timestamp_diff("DAY", start, after) / step) + 1
    days = F.when(after < start, F.lit(0)).otherwise(passed * step)
    return start + F.make_dt_interval(days.cast("int"))


def next_local_occurrence(rule: Column, start: Column, after: Column, zone_name: Column) -> Column:
    """First occurrence of a plain rule strictly after ``after``, at the same clock time of the zone whatever its offset is then; null for other rules.

    A clock time that a change of offset leaves out is as much later; of one that comes twice the first is meant.
    """
    day = 86_400_000_000
    step = F.when(rule == "FREQ=DAILY", day).when(rule == "FREQ=WEEKLY", 7 * day)
    clock = lambda t: F.unix_micros(F.from_utc_timestamp(t.cast("timestamp"), zone_name))
    passed = F.floor((clock(after) - clock(start)) / step).cast("long") + 1
    at = lambda n: F.to_utc_timestamp(F.timestamp_micros(clock(start) + n * step), zone_name)
    n = F.greatest(passed, F.lit(0).cast("long"))
    # The clock time after ``after`` may be one that has come already, before the clock was set back.
    return F.when(at(n) > after.cast("timestamp"), at(n)).otherwise(at(n + 1))


def next_occurrence(rule: Column, start: Column, after: Column, zone_name: Column | None = None) -> Column:
    """First occurrence strictly after ``after``; null when there is none, no rule, or one that can't be read. Only rules that aren't plain go to Python.

    With ``zone_name`` by that zone's clock; an unknown zone gives null.
    """
    plain = rule.isin(*PLAIN_RULES)
    if zone_name is None:
        return F.when(plain, next_plain_occurrence(rule, start, after)).otherwise(_by_rule(F.when(~plain, rule), start, after, F.current_timezone())["upcoming"])
    fine = F.when(known_zone(zone_name), zone_name)
    return F.when(plain, next_local_occurrence(rule, start, after, fine)).otherwise(_by_rule(F.when(~plain, rule), start, after, fine)["upcoming"])


def _by_rule(rule: Column, start: Column, after: Column, zone_name: Column) -> Column:
    micros = lambda t: F.unix_micros(t.cast("timestamp"))
    found = _next_by_rule(rule, micros(start), micros(after), zone_name)
    return F.struct(F.timestamp_micros(found["micros"]).alias("upcoming"), found["valid"].alias("valid"))


def rule_is_valid(rule: Column, start: Column) -> Column:
    """Can a rule be read? Null without a rule."""
    plain = rule.isin(*PLAIN_RULES)
    return F.when(rule.isNull(), None).when(plain, F.lit(True)).otherwise(F.coalesce(_by_rule(F.when(~plain, rule), start, start, F.lit("UTC"))["valid"], F.lit(False)))


def nth_occurrence(rule: Column, start: Column, following: Column, n: Column) -> Column:
    """last_triggered_at and next_trigger_at after ``n`` occurrences, from ``following`` on, were consumed (n of 1 or more).

    Where the rule ends before, or there is none, the last one that was found stays the next.
    """
    step = F.when(rule == "FREQ=DAILY", 1).when(rule == "FREQ=WEEKLY", 7)
    at = lambda days: (following + F.make_dt_interval(days.cast("int"))).cast("timestamp")
    plain = F.struct(at((n - 1) * step).alias("last_triggered_at"), at(n * step).alias("next_trigger_at"))
    still = F.struct(following.cast("timestamp").alias("last_triggered_at"), following.cast("timestamp").alias("next_trigger_at"))
    other = rule.isNotNull() & ~rule.isin(*PLAIN_RULES)
    steps = _consumed(F.when(other, rule), start.cast("timestamp"), following.cast("timestamp"), n.cast("long"))
    return F.when(rule.isin(*PLAIN_RULES), plain).when(other, steps).otherwise(still)


@F.pandas_udf(StructType([StructField("last_triggered_at", TimestampType()), StructField("next_trigger_at", TimestampType())]))
def _consumed(rule: pd.Series, start: pd.Series, following: pd.Series, n: pd.Series) -> pd.DataFrame:
    from dateutil.rrule import rrulestr

    last, upcoming = [], []
    for r, s, f, k in zip(rule, start, following, n, strict=True):
        if r is None or pd.isna(s) or pd.isna(f) or pd.isna(k):
            last.append(None), upcoming.append(None)
            continue
        # f, where occurrences stand from now on; each skip makes it the last and moves on while the rule has more.
        found = [f.to_pydatetime(), *(x for x, _ in zip(rrulestr(r, dtstart=s.to_pydatetime()).xafter(f.to_pydatetime()), range(int(k)), strict=False))]
        last.append(found[min(int(k), len(found)) - 1]), upcoming.append(found[min(int(k), len(found) - 1)])
    return pd.DataFrame({"last_triggered_at": pd.Series(last, dtype="datetime64[ns]"), "next_trigger_at": pd.Series(upcoming, dtype="datetime64[ns]")})


def duration_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds, never negative; null if it never started."""
    return F.when(start.isNotNull(), F.greatest(F.lit(0), F.timestamp_diff("MILLISECOND", start, end)).cast("int"))


def backoff_seconds(retries: Column, base: int = RETRY_BASE_SECONDS) -> Column:
    """base * 2^(retries - 1), and base before the first retry."""
    return (F.lit(base) * F.pow(F.lit(2), F.greatest(F.lit(0), retries - 1))).cast("bigint")


def plus_seconds(t: Column, seconds: Column) -> Column:
    return t + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def job_is_due(status: Column, requested_at: Column, updated_at: Column, retries: Column, now: Column, poll_seconds: int = 10) -> Column:
    """Queued jobs that were lost, and waiting ones whose back-off has passed; a waiting job never updated is due."""
    stale = plus_seconds(requested_at, F.lit(max(30, 2 * poll_seconds))) <= now
    waited = updated_at.isNull() | (plus_seconds(updated_at, backoff_seconds(retries)) <= now)
    return F.when(status == "QUEUED", stale).when(status == "RETRY_WAITING", waited).otherwise(F.lit(False))


def is_of_age(birthday: Column, today: Column, years: int = 14) -> Column:
    """Born before the day ``years`` years ago."""
    return birthday < F.add_months(today, -12 * years)


def within_years(day: Column, today: Column, years: int = 2) -> Column:
    return day.between(F.add_months(today, -12 * years), today)


def active_until(start: Column, days: Column) -> Column:
    """Last day of a course that starts on ``start`` and lasts ``days`` days."""
    return F.date_add(start, days - 1)


def iso_text(t: Column) -> Column:
    """ISO 8601 with offset; the fraction only where there is one, in six digits."""
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(t, "SSSSSS")
    return F.concat(whole, F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)), F.date_format(t, "xxx"))


def join_day_and_time(day: Column, clock: Column) -> Column:
    """Timestamp of a date and an ``HH:mm[:ss]`` text, midnight if that is null."""
    return F.to_timestamp(F.concat_ws(" ", day.cast("string"), F.coalesce(clock, F.lit("00:00:00"))))


def time_of_day(t: Column) -> Column:
    return F.date_format(t, "HH:mm:ss.SSSSSS")
