"""State machines as folds over ordered actions, deliveries, retries and acknowledgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, text

#: Alarm action -> status before -> status after. An action without an entry for the status is refused.
ALARM_MOVES = {
    "PAUSE": {"ACTIVE": "PAUSED"},
    "RESUME": {"PAUSED": "ACTIVE"},
    "COMPLETE": {"ACTIVE": "COMPLETED", "PAUSED": "COMPLETED", "COMPLETED": "COMPLETED"},
    "CANCEL": {"ACTIVE": "CANCELLED", "PAUSED": "CANCELLED", "CANCELLED": "CANCELLED"},
    "SKIP": {"ACTIVE": "ACTIVE"},
}
#: Job action -> status before -> status after; RETRYABLE falls to FAILED once the retries are used up.
JOB_MOVES = {
    "CLAIM": {"QUEUED": "PROCESSING", "RETRY_WAITING": "PROCESSING"},
    "SUCCESS": {"PROCESSING": "COMPLETED"},
    "RETRYABLE": {"PROCESSING": "RETRY_WAITING"},
    "PERMANENT_FAILURE": {"PROCESSING": "FAILED"},
    "EXPIRED": {"PROCESSING": "FAILED"},
    "CANCEL": {"QUEUED": "CANCELLED", "RETRY_WAITING": "CANCELLED", "CANCELLED": "CANCELLED"},
}


def next_status(moves: dict[str, dict[str, str]], status: Column, action: Column) -> Column:
    """The status after an action, null where it is refused."""
    pairs = [F.lit(x) for a, steps in moves.items() for before, after in steps.items() for x in (f"{a}:{before}", after)]
    return F.create_map(*pairs)[F.concat_ws(":", action, status)]


def fold_actions(actions: DataFrame, key: str, order: list[str], action: str, moves: dict[str, dict[str, str]], start: str, most_retries: int | None = None, count: str | None = None) -> DataFrame:
    """Each key's final state: key, status, applied, refused, with ``most_retries`` also retries, and with ``count`` (an action) also
    how often that one was applied, as ``n_<action>``: what an alarm's skips are then worth, see ``after_skips``.

    A key's actions are collected in order (they belong to one alarm or job, so they are few) and
    folded by ``aggregate``; keys are independent and the fold stays in the JVM.
    """
    lists = actions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(action).alias("action")))).alias("steps"))
    begin = F.struct(F.lit(start).alias("status"), *(F.lit(0).alias(n) for n in ("applied", "refused", "retries", "counted")))

    def step(state: Column, s: Column) -> Column:
        after = next_status(moves, state["status"], s["action"])
        tried = F.when((s["action"] == "RETRYABLE") & after.isNotNull(), state["retries"] + 1).otherwise(state["retries"])
        counted = F.when((s["action"] == F.lit(count)) & after.isNotNull(), state["counted"] + 1).otherwise(state["counted"])
        if most_retries is not None:
            after = F.when((after == "RETRY_WAITING") & (tried > most_retries), "FAILED").otherwise(after)
        done = after.isNotNull().cast("int")
        return F.struct(
            F.coalesce(after, state["status"]).alias("status"), (state["applied"] + done).alias("applied"), (state["refused"] + 1 - done).alias("refused"), tried.alias("retries"), counted.alias("counted"),
        )

    folded = lists.select(key, F.aggregate("steps", begin, step).alias("s"))
    names = ["status", "applied", "refused", *(["retries"] if most_retries is not None else [])]
    counts = [F.col("s.counted").alias(f"n_{count.lower()}")] if count else []
    return folded.select(key, *(F.col(f"s.{n}").alias(n) for n in names), *counts)


def after_skips(rule: Column, start: Column, following: Column, skips: Column) -> Column:
    """last_triggered_at and next_trigger_at of an alarm that has skipped ``skips`` occurrences from ``following`` on.

    Each skip consumes the next occurrence; the last one that a rule has stays the next, as does that of an alarm without a rule.
    Null last_triggered_at without skips. Plain rules are arithmetic; others go to Python once for each alarm.
    """
    return F.when(skips > 0, dates.nth_occurrence(rule, start, following, skips)).otherwise(F.struct(F.lit(None).cast("timestamp").alias("last_triggered_at"), following.cast("timestamp").alias("next_trigger_at")))


def claim(jobs: DataFrame, job_id: int) -> DataFrame:
    """Jobs with the given one set to PROCESSING if it may be claimed; ``claimed`` tells whether it was."""
    may = (F.col("id") == job_id) & F.col("status").isin("QUEUED", "RETRY_WAITING")
    return jobs.withColumn("claimed", F.coalesce(may, F.lit(False))).withColumn("status", F.when(may, "PROCESSING").otherwise(F.col("status")))


def push_kind(status_code: Column, timed_out: Column) -> Column:
    """What a push attempt's outcome means for its job."""
    return (
        F.when(timed_out, "RETRYABLE").when(status_code.isNull() | (status_code <= 202), "SUCCESS").when(status_code.isin(404, 410), "EXPIRED")
        .when((status_code == 429) | (status_code >= 500), "RETRYABLE").otherwise("PERMANENT_FAILURE")
    )


def push_error(kind: Column) -> Column:
    names = {"EXPIRED": "PUSH_SUBSCRIPTION_EXPIRED", "RETRYABLE": "PUSH_TEMPORARY_ERROR", "PERMANENT_FAILURE": "PUSH_REJECTED"}
    return F.create_map(*(F.lit(x) for pair in names.items() for x in pair))[kind]


#: Which setting switches an alarm type's notifications.
SETTING_OF_TYPE = {"MEDICATION": "is_notify_medication", "FOLLOW_UP_VISIT": "is_notify_schedule", "GUIDE_CHECK": "is_notify_guide"}


def notification_enabled(alarm_type: Column) -> Column:
    """Of an alarm joined to its user's settings: enabled unless a settings row says no."""
    chosen = F.lit(None).cast("boolean")
    for kind, setting in SETTING_OF_TYPE.items():
        chosen = F.when(alarm_type == kind, F.col(setting)).otherwise(chosen)
    return F.coalesce(chosen, F.lit(True))


def is_due(now: Column) -> Column:
    """Active, due, and this occurrence not consumed yet."""
    fresh = F.col("last_triggered_at").isNull() | (F.col("last_triggered_at") < F.col("next_trigger_at"))
    return (F.col("status") == "ACTIVE") & (F.col("next_trigger_at") <= now) & fresh


def _zone(alarms: DataFrame) -> Column | None:
    """The zone whose clock an alarm's rule goes by, where the table has one."""
    return F.col("timezone") if "timezone" in alarms.columns else None


def poll(alarms: DataFrame, settings: DataFrame, subscriptions: DataFrame, now: Column, most: int = 100) -> dict[str, DataFrame]:
    """One tick of the due poller: ``jobs``, ``events`` and the changed ``alarms``.

    A tick takes the first ``most`` due alarms. Suppressed ones give a SKIPPED event, ones without an
    active subscription a FAILED event, others a job for each. Every taken occurrence is
    consumed; a recurrence then moves on one step from it, by the clock of the alarm's ``timezone`` if there is that column.
    A rule or zone that can't be read doesn't move it, and doesn't fail the tick.
    """
    due = alarms.filter(is_due(now)).orderBy("next_trigger_at", "id").limit(most)
    # A tick has at most ``most`` users, so they are broadcast to the large tables, which aren't shuffled.
    users = F.broadcast(due.select("user_id").distinct())
    settings, subscriptions = settings.join(users, "user_id", "left_semi"), subscriptions.join(users, "user_id", "left_semi")
    known = due.join(settings.select("user_id", *SETTING_OF_TYPE.values()), "user_id", "left")
    known = known.withColumn("enabled", notification_enabled(F.col("alarm_type"))).drop(*SETTING_OF_TYPE.values())
    active = subscriptions.filter("is_active").select("user_id", F.col("id").alias("subscription_id"))
    wanted = known.filter("enabled")
    jobs = wanted.join(active, "user_id").select(
        text.alarm_key(F.col("id"), F.col("subscription_id"), dates.iso_text(F.col("next_trigger_at"))).alias("idempotency_key"),
        F.col("id").alias("alarm_id"), "subscription_id", "user_id", F.col("next_trigger_at").alias("trigger_at"), F.lit("QUEUED").alias("status"),
    )
    event = lambda df, kind, reason, code: df.select(F.col("id").alias("alarm_id"), F.lit(kind).alias("event_type"), now.alias("event_at"), F.lit(reason).alias("reason"), F.lit(code).alias("error_code"))
    events = event(known.filter(~F.col("enabled")), "SKIPPED", "USER_NOTIFICATION_DISABLED", None)
    events = events.unionByName(event(wanted.join(active.select("user_id"), "user_id", "left_anti"), "FAILED", None, "NO_ACTIVE_SUBSCRIPTION"))
    upcoming = dates.next_occurrence(F.col("recurrence_rule"), F.col("scheduled_at"), F.col("next_trigger_at"), _zone(due))
    changed = due.withColumn("last_triggered_at", F.col("next_trigger_at")).withColumn("next_trigger_at", F.coalesce(upcoming, "next_trigger_at"))
    return {"jobs": jobs, "events": events, "alarms": changed}


def new_jobs(jobs: DataFrame, existing: DataFrame, order: list[str], key: str = "idempotency_key") -> DataFrame:
    """One job for each key that isn't there yet: the first in order."""
    fresh = jobs.join(existing.select(key), key, "left_anti")
    first = fresh.groupBy(key).agg(F.min_by(F.struct(*jobs.columns), F.struct(*order)).alias("_row"))
    return first.select("_row.*")


def acknowledge(events: DataFrame, key: list[str], order: list[str], kind: str = "event_type") -> DataFrame:
    """For each key: was something SENT, and the first DELIVERED after it. Later ones are answered with the first.

    Columns: key, sent_first (order struct), delivered (order struct of the accepted one), refused (DELIVERED before any SENT).
    """
    at = F.struct(*order)
    sent = events.groupBy(*key).agg(F.min(F.when(F.col(kind) == "SENT", at)).alias("sent_first"))
    both = events.filter(F.col(kind) == "DELIVERED").withColumn("_at", at).join(sent, key)
    ok = F.col("sent_first").isNotNull() & (F.col("_at") > F.col("sent_first"))
    answer = both.groupBy(*key).agg(F.min(F.when(ok, F.col("_at"))).alias("delivered"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("refused"))
    return sent.join(answer, key, "left").withColumn("refused", F.coalesce("refused", F.lit(0)))


def recover(jobs: DataFrame, events: DataFrame, now: Column, most: int = 100, poll_seconds: int = 10) -> DataFrame:
    """Jobs to enqueue again: id, alarm_id, subscription_id, trigger_at.

    Only alarm jobs that are due. The context is the event that the job (or its parent) refers to,
    with the event's time, else what its key says; a reference that leads nowhere gives no row.
    """
    due = dates.job_is_due(F.col("status"), F.col("requested_at"), F.col("updated_at"), F.col("retry_count"), now, poll_seconds)
    chosen = jobs.filter((F.col("job_type") == "ALARM") & due).orderBy("requested_at", "id").limit(most)
    return resolve_context(chosen, jobs, events)


def resolve_context(chosen: DataFrame, jobs: DataFrame, events: DataFrame) -> DataFrame:
    """Alarm, subscription and trigger time of each chosen job, by two lookups and the parsed key. ``chosen`` is a limited list, whose
    keys are broadcast to the tables of jobs and events."""
    wanted = F.broadcast(chosen.select(F.col("parent_job_id").alias("id")).distinct())
    parents = jobs.join(wanted, "id", "left_semi").select(F.col("id").alias("parent_job_id"), F.struct("reference_table", "reference_id", "idempotency_key").alias("parent"))
    own = chosen.join(parents, "parent_job_id", "left").filter(F.col("parent_job_id").isNull() | F.col("parent").isNotNull())
    use = F.coalesce("parent", F.struct("reference_table", "reference_id", "idempotency_key"))
    own = own.select("id", use.alias("r"))
    named = F.when(F.col("r.reference_table") == "alarm_events", F.col("r.reference_id"))
    facts = events.select(F.col("id").alias("event_id"), F.struct("alarm_id", F.col("push_subscription_id").alias("subscription_id"), F.col("event_at").alias("trigger_at")).alias("e"))
    own = own.withColumn("event_id", named)
    facts = facts.join(F.broadcast(own.select("event_id").distinct()), "event_id", "left_semi")
    own = own.join(facts, "event_id", "left")
    key = text.parse_alarm_key(F.col("r.idempotency_key"))
    parsed = F.when(F.col("event_id").isNull(), key)
    return own.select(
        "id", F.coalesce("e.alarm_id", parsed["alarm_id"]).alias("alarm_id"), F.coalesce("e.subscription_id", parsed["subscription_id"]).alias("subscription_id"),
        F.coalesce("e.trigger_at", F.try_to_timestamp(parsed["trigger_text"])).alias("trigger_at"),
    ).filter(F.col("alarm_id").isNotNull() & F.col("subscription_id").isNotNull() & F.col("trigger_at").isNotNull())


def deactivate_expired(subscriptions: DataFrame, attempts: DataFrame, key: str, kind: str = "kind") -> DataFrame:
    """Subscriptions, those inactive that a push found EXPIRED. Attempts are reduced to one row a key before they meet the table."""
    expired = attempts.filter(F.col(kind) == "EXPIRED").select(key).distinct().withColumn("_expired", F.lit(True))
    joined = subscriptions.join(expired, key, "left")
    return joined.withColumn("is_active", F.col("is_active") & F.col("_expired").isNull()).drop("_expired")


def act(alarms: DataFrame, actions: DataFrame, now: Column) -> dict[str, DataFrame]:
    """One action for each alarm: the whole table of ``alarms`` after it, the ``events`` that it leaves, and the ``refused`` actions.

    ``actions(id, action)`` holds at most one row an alarm. COMPLETE and SKIP leave an event, but for a COMPLETE of what is completed
    already. SKIP consumes the next occurrence: it becomes the last one, and the rule's following one, where there is one, the next;
    the alarm stays ACTIVE. An action that the status doesn't allow, or of an alarm that isn't there, is refused and changes nothing.
    """
    joined = alarms.join(actions.select("id", F.col("action").alias("_action")), "id", "left")
    joined = joined.withColumn("_after", next_status(ALARM_MOVES, F.col("status"), F.col("_action")))
    done = F.col("_after").isNotNull() & ((F.col("_action") == "SKIP") | (F.col("_after") != F.col("status")))
    skip = done & (F.col("_action") == "SKIP")
    upcoming = dates.next_occurrence(F.when(skip, F.col("recurrence_rule")), F.col("scheduled_at"), F.col("next_trigger_at"), _zone(alarms))
    stamp = lambda name, action: F.when(done & (F.col("_action") == action), now).otherwise(F.col(name))
    changed = joined.withColumns({
        "last_triggered_at": F.when(skip, F.col("next_trigger_at")).otherwise(F.col("last_triggered_at")), "next_trigger_at": F.when(skip, F.coalesce(upcoming, "next_trigger_at")).otherwise(F.col("next_trigger_at")),
        "completed_at": stamp("completed_at", "COMPLETE"), "cancelled_at": stamp("cancelled_at", "CANCEL"), "updated_at": F.when(done & F.col("_action").isin("COMPLETE", "CANCEL", "SKIP"), now).otherwise(F.col("updated_at")),
        "status": F.coalesce("_after", "status"),
    })
    kind = F.create_map(F.lit("COMPLETE"), F.lit("COMPLETED"), F.lit("SKIP"), F.lit("SKIPPED"))[F.col("_action")]
    events = joined.filter(done & kind.isNotNull()).select(F.col("id").alias("alarm_id"), kind.alias("event_type"), now.alias("event_at"))
    known = alarms.select("id", "status")
    refused = actions.join(known, "id", "left").filter(next_status(ALARM_MOVES, F.col("status"), F.col("action")).isNull()).select("id", "action", "status")
    return {"alarms": changed.select(*alarms.columns), "events": events, "refused": refused}


#: Why a job can't be retried by hand, in the order in which it is found out.
RETRY_ERRORS = ("NOT_FAILED", "NO_RETRY_HANDLER", "CONTEXT_MISSING", "TARGET_MISSING")


def manual_retry(jobs: DataFrame, events: DataFrame, alarms: DataFrame, subscriptions: DataFrame, token: Column) -> tuple[DataFrame, DataFrame]:
    """Child jobs of ``jobs`` that somebody wants to retry, and (id, error) of those that can't be.

    Only a FAILED job of type ALARM that refers to an alarm event, whose subscription and alarm are there, may be. The child extends
    its parent's key by ``:manual:`` and ``token``, which must differ between two retries of one job; it starts without retries, and its
    columns alarm_id, subscription_id and trigger_at say what to deliver. The wanted jobs drive each lookup; the larger tables are read by key.
    """
    facts = events.select(F.col("id").alias("reference_id"), F.struct("alarm_id", F.col("push_subscription_id").alias("subscription_id"), F.col("event_at").alias("trigger_at")).alias("_event"))
    found = jobs.join(facts, "reference_id", "left").withColumns({"alarm_id": F.col("_event.alarm_id"), "subscription_id": F.col("_event.subscription_id"), "trigger_at": F.col("_event.trigger_at")})
    found = found.join(alarms.select(F.col("id").alias("alarm_id"), F.lit(True).alias("_alarm")), "alarm_id", "left")
    found = found.join(subscriptions.select(F.col("id").alias("subscription_id"), F.lit(True).alias("_subscription")), "subscription_id", "left")
    handled = F.coalesce((F.col("job_type") == "ALARM") & (F.col("reference_table") == "alarm_events"), F.lit(False))
    error = (
        F.when(~F.coalesce(F.col("status") == "FAILED", F.lit(False)), RETRY_ERRORS[0]).when(~handled, RETRY_ERRORS[1])
        .when(F.col("_event").isNull() | F.col("subscription_id").isNull(), RETRY_ERRORS[2]).when(F.col("_alarm").isNull() | F.col("_subscription").isNull(), RETRY_ERRORS[3])
    )
    found = found.withColumn("error", error)
    children = found.filter("error IS NULL").select(
        F.concat(F.col("idempotency_key"), F.lit(":manual:"), token).alias("idempotency_key"), "job_type", F.lit("QUEUED").alias("status"), "user_id", F.lit(0).alias("retry_count"), "max_retry_count",
        F.col("id").alias("parent_job_id"), "alarm_id", "subscription_id", "trigger_at",
    )
    return children, found.filter("error IS NOT NULL").select("id", "error")


def enqueue(jobs: DataFrame, now: Column, delay_seconds: Column | int = 0) -> DataFrame:
    """Jobs as they enter the queue: requested ``now``, available ``delay_seconds`` later. No or a negative delay is none."""
    delay = F.greatest(F.coalesce(delay_seconds if isinstance(delay_seconds, Column) else F.lit(delay_seconds), F.lit(0)), F.lit(0))
    return jobs.withColumns({"requested_at": now, "available_at": now + F.make_dt_interval(secs=delay)})


def available(jobs: DataFrame, now: Column, most: int = 100) -> DataFrame:
    """The first ``most`` jobs that a worker may take now: waiting ones whose time has come. One without available_at may be taken at once."""
    come = F.col("available_at").isNull() | (F.col("available_at") <= now)
    return jobs.filter(F.col("status").isin("QUEUED", "RETRY_WAITING") & come).orderBy(F.coalesce("available_at", "requested_at"), "id").limit(most)


def attempt(jobs: DataFrame, alarms: DataFrame, subscriptions: DataFrame, outcomes: DataFrame, now: Column, base_seconds: int = dates.RETRY_BASE_SECONDS) -> dict[str, DataFrame]:
    """What one push attempt of each claimed job leads to, as one change of three tables: ``jobs``, ``events`` and ``subscriptions``.

    ``outcomes(id, kind, error_code, status_code)`` has one row for each attempted job (``kind`` by ``push_kind``); ``jobs`` carry alarm_id and
    subscription_id. A job that isn't PROCESSING or wasn't attempted is left alone. One whose alarm isn't ACTIVE, or whose subscription isn't
    active or is gone, is CANCELLED without an event. SUCCESS completes the job, leaves a SENT event and marks the subscription as used.
    RETRYABLE waits, twice as long each time, until max_retry_count is passed, then fails. Failures leave a FAILED event; EXPIRED ones
    also deactivate the subscription. An event's identifier is its job's key and attempt, so an attempt that is published again is the same event,
    and the job refers to it. Publish the three together (``sources.commits.publish``).
    """
    joined = jobs.join(outcomes.select("id", *(F.col(c).alias(f"_{c}") for c in ("kind", "error_code", "status_code"))), "id", "left")
    joined = joined.join(alarms.select(F.col("id").alias("alarm_id"), F.col("status").alias("_alarm")), "alarm_id", "left")
    joined = joined.join(subscriptions.select(F.col("id").alias("subscription_id"), F.col("is_active").alias("_active")), "subscription_id", "left")
    tried = F.col("_kind").isNotNull() & (F.col("status") == "PROCESSING")
    lost = ~(F.coalesce(F.col("_alarm") == "ACTIVE", F.lit(False)) & F.coalesce(F.col("_active"), F.lit(False)))
    again = (F.col("_kind") == "RETRYABLE") & (F.col("retry_count") + 1 <= F.col("max_retry_count"))
    after = F.when(~tried, None).when(lost, "CANCELLED").when(F.col("_kind") == "SUCCESS", "COMPLETED").when(again, "RETRY_WAITING").otherwise("FAILED")
    joined = joined.withColumn("_after", after)
    over = F.col("_after").isin("CANCELLED", "COMPLETED", "FAILED")
    final = F.col("_after").isin("COMPLETED", "FAILED")
    retries = F.when((F.col("_kind") == "RETRYABLE") & F.col("_after").isin("RETRY_WAITING", "FAILED"), F.col("retry_count") + 1).otherwise(F.col("retry_count"))
    event_id = F.concat_ws("#", "idempotency_key", retries.cast("string"))
    kept = lambda condition, value, name: F.when(condition, value).otherwise(F.col(name))
    waits = dates.plus_seconds(now, dates.backoff_seconds(retries, base_seconds).cast("double"))
    changed = joined.select(
        "id", "idempotency_key", "alarm_id", "subscription_id", kept(F.col("_after").isNotNull(), F.col("_after"), "status").alias("status"), retries.alias("retry_count"), "max_retry_count", "started_at",
        kept(over, now, "completed_at").alias("completed_at"), kept(over, dates.duration_ms(F.col("started_at"), now), "duration_ms").alias("duration_ms"),
        kept(F.col("_after") == "RETRY_WAITING", waits, "available_at").alias("available_at"),
        kept(final, F.lit("alarm_events"), "reference_table").alias("reference_table"), kept(final, event_id, "reference_id").alias("reference_id"),
        kept(final | (F.col("_after") == "RETRY_WAITING"), F.when(F.col("_after") != "COMPLETED", F.col("_error_code")), "error_code").alias("error_code"),
        kept(F.col("_after").isNotNull(), now, "updated_at").alias("updated_at"),
    )
    events = joined.filter(final).select(
        event_id.alias("id"), "alarm_id", F.col("subscription_id").alias("push_subscription_id"), F.when(F.col("_after") == "COMPLETED", "SENT").otherwise("FAILED").alias("event_type"), now.alias("event_at"),
        F.when(F.col("_after") == "FAILED", F.col("_status_code")).alias("status_code"), F.when(F.col("_after") == "FAILED", F.col("_error_code")).alias("error_code"),
    )
    # One row a subscription before its table is met, however many jobs it had.
    met = joined.filter(final).groupBy("subscription_id").agg(F.max(F.col("_after") == "COMPLETED").alias("_used"), F.max((F.col("_kind") == "EXPIRED")).alias("_expired"))
    known = subscriptions.join(met.withColumnRenamed("subscription_id", "id"), "id", "left")
    known = known.withColumns({"is_active": F.col("is_active") & ~F.coalesce("_expired", F.lit(False)), "last_used_at": F.when(F.coalesce("_used", F.lit(False)), now).otherwise(F.col("last_used_at"))})
    return {"jobs": changed, "events": events, "subscriptions": known.select(*subscriptions.columns)}
