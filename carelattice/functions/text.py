"""Text expressions: cleaning, comparison keys, formatting, format checks and schedule slots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = " · "


def strip(x: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def clean_text(x: Column) -> Column:
    """One kind of line break, single blanks, no blanks around line breaks, two line breaks in a row at most."""
    steps = [(r"\r\n|\r", "\n"), (r"[ \t]+", " "), (r" *\n *", "\n"), (r"\n{3,}", "\n\n")]
    return strip(reduce(lambda col, step: F.regexp_replace(col, *step), steps, x))


def collapse_spaces(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def space_free_key(x: Column) -> Column:
    """Lower case without any white space, for comparing sentences."""
    return F.lower(F.regexp_replace(x, r"(?U)\s+", ""))


def punctuation_free_key(x: Column) -> Column:
    """Lower case without white space and ``. , ! ?``."""
    return F.lower(F.regexp_replace(x, r"(?U)[\s.,!?]", ""))


def blank_to_null(x: Column) -> Column:
    return F.nullif(strip(x), F.lit(""))


def upper_key(x: Column) -> Column:
    return F.upper(strip(x))


def join_present(separator: str, *parts: Column) -> Column:
    """The parts that are neither null nor empty, joined."""
    return F.concat_ws(separator, *(F.nullif(p, F.lit("")) for p in parts))


def medication_line(m: Column) -> Column:
    """name · dose · N times a day · note · D days, from a medication struct; absent parts are left out."""
    times = F.concat(F.lit("1일 "), m["times_per_day"].cast("string"), F.lit("회"))
    return F.concat_ws(SEPARATOR, m["name"], F.nullif(m["dose"], F.lit("")), times, F.nullif(m["note"], F.lit("")), F.concat(m["days"].cast("string"), F.lit("일")))


def follow_up_line(v: Column) -> Column:
    """Time · department · doctor · purpose · place, or else the institution, from a follow-up struct."""
    where = F.coalesce(F.nullif(v["place"], F.lit("")), v["institution_name"])
    return join_present(SEPARATOR, F.date_format(v["visit_at"], "yyyy-MM-dd HH:mm"), v["department"], v["doctor_name"], v["purpose"], where)


def section(title: str, lines: Column) -> Column:
    """A titled bullet list of the lines that aren't blank; null if none is left."""
    kept = F.filter(F.transform(lines, strip), lambda line: line != "")
    body = F.array_join(F.transform(kept, lambda line: F.concat(F.lit("- "), line)), "\n")
    return F.when(F.size(kept) > 0, F.concat(F.lit(f"{title}\n"), body))


def document(*sections: Column) -> Column:
    """Sections that are there, with a blank line between."""
    return F.concat_ws("\n\n", *sections)


def normalize_phone(x: Column) -> Column:
    local = F.when(F.startswith(x, F.lit("+82")), F.concat(F.lit("0"), F.substring(x, 4, 1 << 20))).otherwise(x)
    return F.regexp_replace(local, r"(?U)\D", "")


def is_phone(x: Column) -> Column:
    return x.rlike(r"^(?:010-\d{4}-\d{4}|010\d{8}|\+8210\d{8})\z")


def missing_password_classes(x: Column) -> Column:
    """Which of upper, lower, digit, special a password lacks; ``short`` first if it has fewer than 8 characters."""
    classes = {"upper": "[A-Z]", "lower": "[a-z]", "digit": "[0-9]", "special": "[^a-zA-Z0-9]"}
    return F.array_compact(F.array(F.when(F.char_length(x) < 8, "short"), *(F.when(~x.rlike(p), name) for name, p in classes.items())))


def is_email(x: Column) -> Column:
    return x.rlike(r"(?U)^[^\s@]+@[^\s@]+\.[^\s@]+\z")


def has_suffix(x: Column, suffix: str) -> Column:
    return F.endswith(F.lower(x), F.lit(suffix.lower()))


def alarm_key(alarm_id: Column, subscription_id: Column, trigger_text: Column) -> Column:
    """The idempotency key of one delivery of one alarm."""
    return F.concat_ws(":", F.lit("alarm"), alarm_id.cast("string"), subscription_id.cast("string"), trigger_text)


def parse_alarm_key(key: Column) -> Column:
    """alarm_id, subscription_id and trigger text of an idempotency key, cut before ``:manual:``; null if it is none."""
    own = F.element_at(F.split(key, ":manual:", 2), 1)
    pattern = r"^alarm:(\d+):(\d+):(.+)$"
    part = lambda i: F.regexp_extract(own, pattern, i)
    return F.when(own.rlike(pattern), F.struct(part(1).cast("bigint").alias("alarm_id"), part(2).cast("bigint").alias("subscription_id"), part(3).alias("trigger_text")))


def has_disclaimer(x: Column) -> Column:
    """Names a medical professional or visit, and says that it isn't replaced."""
    named = F.contains(x, F.lit("의료진")) | F.contains(x, F.lit("의사")) | F.contains(x, F.lit("진료"))
    return F.coalesce(named & F.contains(x, F.lit("대체")), F.lit(False))


#: The slots of a day in their order, and the wording that names each.
SLOT_PATTERNS = {"morning": "아침|조식|기상", "lunch": "점심|중식", "evening": "저녁|석식", "bedtime": r"취침|자기\s?전|잠자기\s?전|수면\s?전|자기전"}
SLOTS = list(SLOT_PATTERNS)


def slots_of_timing(timing: Column, patterns: dict[str, str] | None = None) -> Column:
    """The slots that a wording names, in the order of the day."""
    return F.array_compact(F.array(*(F.when(timing.rlike(p), slot) for slot, p in (patterns or SLOT_PATTERNS).items())))


def default_slots(times_per_day: Column, timing: Column, patterns: dict[str, str] | None = None) -> Column:
    """The slots of the wording if they are as many as the doses, else the usual ones; none for as-needed doses."""
    named = slots_of_timing(timing, patterns)
    usual = {1: SLOTS[:1], 2: [SLOTS[0], SLOTS[2]], 3: SLOTS[:3]}
    out = F.when(times_per_day.isNull(), F.array().cast("array<string>")).when(F.size(named) == times_per_day, named)
    for n, slots in usual.items():
        out = out.when(times_per_day == n, F.array(*map(F.lit, slots)))
    return out.otherwise(F.array(*map(F.lit, SLOTS)))


def exceeds_slots(times_per_day: Column) -> Column:
    return F.coalesce(times_per_day > len(SLOTS), F.lit(False))


def is_rising(values: Column) -> Column:
    """Each element is greater than the one before it."""
    n = F.size(values)
    return F.when(n < 2, F.lit(True)).otherwise(F.forall(F.zip_with(F.slice(values, F.lit(1), n - 1), F.slice(values, F.lit(2), n - 1), lambda a, b: a < b), lambda x: x))


def frequency_text(times_per_day: Column, note: Column) -> Column:
    """``1일 N회`` with the note, or the as-needed wording where no number is given."""
    regular = F.concat_ws(SEPARATOR, F.concat(F.lit("1일 "), times_per_day.cast("string"), F.lit("회")), F.nullif(note, F.lit("")))
    needed = F.when(F.startswith(note, F.lit("필요 시")), note).otherwise(F.concat_ws(SEPARATOR, F.lit("필요 시"), F.nullif(note, F.lit(""))))
    return F.when(times_per_day.isNotNull(), regular).otherwise(needed)


def quote_pattern(x: Column) -> Column:
    """``x`` as a regular expression that matches it literally."""
    return F.regexp_replace(x, r"([^\p{L}\p{N}\s])", r"\\$1")


def alternatives(words: Column) -> Column:
    """A pattern of the given words, longest first; null without words."""
    longest = F.array_sort(F.array_distinct(words), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.when(F.size(words) > 0, F.array_join(F.transform(longest, quote_pattern), "|"))


def csv_line(*cells: Column) -> Column:
    """One CSV record: cells with quotes, commas or line breaks are quoted, inner quotes doubled, null is empty."""
    def cell(x: Column) -> Column:
        text = F.coalesce(x.cast("string"), F.lit(""))
        return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.concat_ws(",", *map(cell, cells))
