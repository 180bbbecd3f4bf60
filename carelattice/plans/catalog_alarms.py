"""Registered queries: requests for alarms, actions on them, push attempts, retries and message streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import machines, schedules
from ..sources.readers import table
from ..streaming import retries, state
from .catalog_events import _drain

NOW = "2024-02-01 00:00:00"
ACTIONS = ("PAUSE", "RESUME", "COMPLETE", "SKIP", "CANCEL", "OTHER")
#: Time slices that the event table is read in as a stream, each in a batch of its own.
SLICES = 4


def _now():
    return F.to_timestamp(F.lit(NOW))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _second():
    return F.date_trunc("SECOND", "ts").cast("timestamp")


def _shown(*names: str):
    return [F.date_format(n, "yyyy-MM-dd HH:mm:ss").alias(n) for n in names]


def _alarms(events: DataFrame) -> DataFrame:
    """Events as alarms of all statuses, with a daily rule, a weekly one, one without a further occurrence, or none."""
    status = F.when(F.col("event_type") == "click", "PAUSED").when(F.col("event_type") == "error", "CANCELLED").when(F.col("event_type") == "purchase", "COMPLETED").otherwise("ACTIVE")
    rule = F.when(F.col("event_id") % 4 == 0, "FREQ=DAILY").when(F.col("event_id") % 4 == 1, "FREQ=WEEKLY").when(F.col("event_id") % 4 == 2, "FREQ=DAILY;COUNT=1")
    never = F.lit(None).cast("timestamp")
    return events.select(
        F.col("event_id").alias("id"), status.alias("status"), rule.alias("recurrence_rule"), _second().alias("scheduled_at"), _second().alias("next_trigger_at"), F.lit("UTC").alias("timezone"),
        *(never.alias(n) for n in ("last_triggered_at", "completed_at", "cancelled_at", "updated_at")),
    )


def skip_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every alarm is asked to skip; those that are active consume their next occurrence."""
    alarms = _alarms(_events(spark, sf_dir))
    done = machines.act(alarms, alarms.select("id", F.lit("SKIP").alias("action")), _now())["alarms"]
    return done.select(F.col("id").alias("event_id"), "status", *_shown("next_trigger_at", "last_triggered_at"))


def alarm_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All kinds of actions on alarms of all statuses: the alarm after it, the event it left, and whether it was refused."""
    events = _events(spark, sf_dir)
    action = F.element_at(F.array(*map(F.lit, ACTIONS)), (F.col("user_id") % len(ACTIONS) + 1).cast("int"))
    found = machines.act(_alarms(events), events.select(F.col("event_id").alias("id"), action.alias("action")), _now())
    left = found["events"].select(F.col("alarm_id").alias("id"), "event_type").join(found["refused"].select("id", F.lit(True).alias("refused")), "id", "full")
    rows = found["alarms"].join(left, "id", "left").withColumn("refused", F.coalesce("refused", F.lit(False)))
    return rows.select("id", "status", "event_type", "refused", *_shown("completed_at", "cancelled_at", "updated_at"))


def alarm_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of all actions of an alarm, and where its skips have brought it."""
    events = _events(spark, sf_dir)
    alarm = (F.col("event_id") % 1000).alias("alarm_id")
    step = F.when(F.col("event_type") == "view", "SKIP").when(F.col("event_type") == "click", "PAUSE").when(F.col("event_type") == "signup", "RESUME").otherwise("OTHER")
    folded = machines.fold_actions(events.select(alarm, "ts", "event_id", step.alias("step")), "alarm_id", ["ts", "event_id"], "step", machines.ALARM_MOVES, "ACTIVE", count="SKIP")
    first = events.groupBy(alarm).agg(F.min(_second()).alias("start"))
    rule = F.when(F.col("alarm_id") % 4 == 0, "FREQ=DAILY").when(F.col("alarm_id") % 4 == 1, "FREQ=WEEKLY").when(F.col("alarm_id") % 4 == 2, "FREQ=DAILY;COUNT=3")
    at = machines.after_skips(rule, F.col("start"), F.col("start"), F.col("n_skip"))
    return folded.join(first, "alarm_id").withColumn("at", at).select("alarm_id", "status", "n_skip", "refused", *(F.date_format(f"at.{n}", "yyyy-MM-dd HH:mm:ss").alias(n) for n in ("last_triggered_at", "next_trigger_at")))


def manual_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every job is asked to be retried: its child, or why there is none."""
    events = _events(spark, sf_dir)
    status = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "click", "CANCELLED").otherwise("COMPLETED")
    jobs = events.select(
        F.col("event_id").alias("id"), F.concat(F.lit("alarm:1:2:"), F.col("event_id")).alias("idempotency_key"), F.when(F.col("event_id") % 5 == 0, "OCR").otherwise("ALARM").alias("job_type"), status.alias("status"), "user_id",
        F.when(F.col("event_id") % 7 != 0, "alarm_events").alias("reference_table"), (F.col("event_id") * 2).alias("reference_id"), F.lit(3).alias("max_retry_count"),
    )
    facts = events.select(F.col("event_id").alias("id"), F.col("user_id").alias("alarm_id"), F.when(F.col("event_id") % 11 != 0, F.col("event_id") % 9).alias("push_subscription_id"), _second().alias("event_at"))
    alarms = events.select(F.col("user_id").alias("id")).distinct().filter("id % 10 <> 3")
    subscriptions = events.select((F.col("event_id") % 9).alias("id")).distinct().filter("id <> 8")
    children, refused = machines.manual_retry(jobs, facts, alarms, subscriptions, F.md5(F.col("id").cast("string")))
    shown = children.select(F.col("parent_job_id").alias("id"), F.lit(None).cast("string").alias("error"), "idempotency_key", "alarm_id", "subscription_id", *_shown("trigger_at"))
    return shown.unionByName(refused, allowMissingColumns=True)


def push_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One attempt of every claimed job: what becomes of jobs, events and subscriptions, in one list."""
    events = _events(spark, sf_dir)
    status = F.when(F.col("event_type").isin("view", "click", "signup"), "PROCESSING").otherwise("QUEUED")
    never = F.lit(None).cast("timestamp")
    jobs = events.select(
        F.col("event_id").alias("id"), F.concat(F.lit("k"), "event_id").alias("idempotency_key"), F.col("user_id").alias("alarm_id"), (F.col("event_id") % 50).alias("subscription_id"), status.alias("status"),
        (F.col("event_id") % 4).cast("int").alias("retry_count"), F.lit(2).alias("max_retry_count"), _second().alias("started_at"), never.alias("completed_at"), F.lit(None).cast("int").alias("duration_ms"), never.alias("available_at"),
        F.lit(None).cast("string").alias("reference_table"), F.lit(None).cast("string").alias("reference_id"), F.lit(None).cast("string").alias("error_code"), never.alias("updated_at"),
    )
    code = F.element_at(F.array(*map(F.lit, (201, 201, 404, 410, 429, 503, 400))), (F.col("event_id") % 7 + 1).cast("int"))
    kind = machines.push_kind(code, F.lit(False))
    outcomes = events.select(F.col("event_id").alias("id"), kind.alias("kind"), machines.push_error(kind).alias("error_code"), code.alias("status_code"))
    alarms = events.select(F.col("user_id").alias("id")).distinct().withColumn("status", F.when(F.col("id") % 5 == 0, "PAUSED").otherwise("ACTIVE"))
    subscriptions = events.select((F.col("event_id") % 50).alias("id")).distinct().withColumns({"is_active": F.col("id") % 9 != 0, "last_used_at": never})
    found = machines.attempt(jobs, alarms, subscriptions, outcomes, _now())
    none = F.lit(None).cast("string")
    wait = (F.unix_timestamp("available_at") - F.unix_timestamp("updated_at")).cast("string")
    rows = found["jobs"].select(F.lit("job").alias("what"), F.col("id").cast("string").alias("id"), "status", F.col("retry_count").cast("long").alias("n"), F.coalesce("error_code", "reference_id").alias("detail"), wait.alias("wait"), F.col("duration_ms").isNotNull().alias("flag"))
    rows = rows.unionByName(found["events"].select(F.lit("event").alias("what"), "id", F.col("event_type").alias("status"), F.col("status_code").cast("long").alias("n"), F.col("error_code").alias("detail"), none.alias("wait"), F.lit(True).alias("flag")))
    return rows.unionByName(found["subscriptions"].select(F.lit("subscription").alias("what"), F.col("id").cast("string").alias("id"), none.alias("status"), F.lit(None).cast("long").alias("n"), F.date_format("last_used_at", "yyyy-MM-dd").alias("detail"), none.alias("wait"), F.col("is_active").alias("flag")))


def delayed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs enqueued with a delay of up to two hours: the first hundred that a worker may take an hour later."""
    jobs = _events(spark, sf_dir).select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "FAILED").otherwise("QUEUED").alias("status"), ((F.col("event_id") * 37) % 120 * 60).cast("int").alias("delay"))
    queued = machines.enqueue(jobs, _now(), F.when(F.col("delay") > 0, F.col("delay")))
    ready = machines.available(queued, _now() + F.expr("INTERVAL '1' HOUR"))
    return ready.select("id", *_shown("available_at"))


def alarm_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests from three zones around their change of clocks, some of them faulty in each way."""
    n = F.col("event_id")
    zone = F.element_at(F.array(*map(F.lit, ("America/New_York", "Europe/Berlin", "Asia/Seoul", "Mars/Base"))), (F.when(n % 17 == 0, 4).otherwise(n % 3 + 1)).cast("int"))
    # From 2024-03-08 on, by the minute: over the change of New York and, with weekly rules, that of Berlin.
    at = F.to_timestamp(F.lit("2024-03-08 00:00:00")) + F.make_dt_interval(mins=(n % 30000).cast("int"))
    written = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    given = F.when(n % 13 == 0, written).when(n % 2 == 0, F.concat(written, F.lit("Z"))).otherwise(F.concat(F.date_format(at + F.expr("INTERVAL '9' HOUR"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00")))
    rule = F.when(n % 5 == 0, "FREQ=WEEKLY").when(n % 5 == 1, "FREQ=DAILY;COUNT=1").when(n % 19 == 2, "FREQ=SOMETIMES").when(n % 5 < 4, "FREQ=DAILY")
    kind = F.when(n % 4 == 0, "GUIDE_CHECK").otherwise("MEDICATION")
    requests = _events(spark, sf_dir).select(
        n.alias("id"), F.when(n % 23 == 0, "").otherwise("t").alias("title"), F.when(n % 29 == 0, F.repeat(F.lit("m"), 501)).alias("message"), kind.alias("alarm_type"), F.when((n % 4 > 0) != (n % 31 == 0), "MORNING").alias("meal_slot"),
        given.alias("scheduled_at"), rule.alias("recurrence_rule"), zone.alias("timezone"),
    )
    checked = schedules.checked_requests(requests)
    return checked.select("id", F.array_join("errors", ",").alias("errors"), *_shown("scheduled", "upcoming"))


def stream_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages that come in four slices of time: the last outcome of each. Errors always fail, clicks fail twice, purchases once, views break the contract."""
    from .catalog_events import stream_folder

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", retries.STATE_STORE)
    events = _events(spark, sf_dir)
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    span = (high - low).total_seconds() / SLICES
    place = F.least(F.lit(SLICES - 1), F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(low).cast("timestamp"))) / F.lit(span * 1e6)))
    fails = F.when(F.col("event_type") == "error", 9).when(F.col("event_type") == "click", 2).when(F.col("event_type") == "purchase", 1).otherwise(0)
    fields = F.create_map(F.lit("job_id"), F.when(F.col("event_type") != "view", F.col("event_id").cast("string")), F.lit("job_type"), F.lit("PUBLIC_GUIDELINE_INDEX"), F.lit("manifest_path"), F.lit("m.json"), F.lit("fails"), fails.cast("string"))
    messages = events.select(F.concat(F.lit("m"), "event_id").alias("message_id"), F.col("ts").cast("timestamp").alias("at"), fields.alias("fields"), place.alias("slice"))
    folder = stream_folder(spark)
    for i in range(SLICES):  # the stream starts again when a slice has come, so that each slice is a batch, of as many files as it has
        messages.filter(F.col("slice") == i).drop("slice").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("message_id string, at timestamp, fields map<string, string>").parquet(f"{folder}/in")
        retries.write_outcomes(retries.attempts(stream, _fails_at_first, time_col="at"), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    last = retries.last_outcomes(spark.read.parquet(f"{folder}/out").select("message_id", "outcome", "attempt", "failure_message"))
    return last.select("message_id", "outcome", "attempt", "failure_message")


def _fails_at_first(message_id: str, fields: dict, number: int) -> None:
    if number <= int(fields["fails"]):
        raise RuntimeError(f"attempt {number}")


def stream_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fold of ``alarm_skips`` as a stream whose state is bounded: each alarm's last row."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", retries.STATE_STORE)
    stream = spark.readStream.schema(_events(spark, sf_dir).schema).parquet(f"{sf_dir}/events.parquet*")
    step = F.when(F.col("event_type") == "view", "SKIP").when(F.col("event_type") == "click", "PAUSE").when(F.col("event_type") == "signup", "RESUME").otherwise("OTHER")
    actions = stream.select((F.col("event_id") % 1000).alias("alarm_id"), "event_id", F.col("ts").cast("timestamp").alias("at"), step.alias("step"))
    rows = _drain(spark, state.run_actions(actions, "alarm_id", "event_id", "step", time_col="at", keep_seconds=90 * 24 * 3600), "update")
    total = F.col("applied") + F.col("refused")
    return rows.groupBy("alarm_id").agg(*(F.max_by(c, total).alias(c) for c in ("status", "skipped", "refused")))


QUERIES = {f.__name__: f for f in (skip_occurrence, alarm_actions, alarm_skips, manual_retry, push_attempts, delayed_jobs, alarm_requests, stream_retries, stream_skips)}

_SECOND = "strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S')"
_FOLD = """
        WITH a AS (
            SELECT event_id % 1000 AS alarm_id, date_trunc('second', min(ts)) AS start, list(CASE event_type WHEN 'view' THEN 'SKIP' WHEN 'click' THEN 'PAUSE' WHEN 'signup' THEN 'RESUME' ELSE 'OTHER' END ORDER BY ts, event_id) AS steps
            FROM events GROUP BY 1
        ), f AS (
            SELECT alarm_id, start, list_reduce(list_prepend({'s': 'ACTIVE', 'k': 0, 'r': 0, 'a': ''}, list_transform(steps, lambda x: {'s': '', 'k': 0, 'r': 0, 'a': x})),
                lambda x, y: {
                    's': CASE WHEN x.s = 'ACTIVE' AND y.a = 'PAUSE' THEN 'PAUSED' WHEN x.s = 'PAUSED' AND y.a = 'RESUME' THEN 'ACTIVE' ELSE x.s END,
                    'k': x.k + CASE WHEN x.s = 'ACTIVE' AND y.a = 'SKIP' THEN 1 ELSE 0 END,
                    'r': x.r + CASE WHEN (x.s = 'ACTIVE' AND y.a IN ('PAUSE', 'SKIP')) OR (x.s = 'PAUSED' AND y.a = 'RESUME') THEN 0 ELSE 1 END, 'a': ''}) AS v FROM a
        )"""
SQL = {
    "skip_occurrence": f"""
        SELECT event_id, CASE event_type WHEN 'click' THEN 'PAUSED' WHEN 'error' THEN 'CANCELLED' WHEN 'purchase' THEN 'COMPLETED' ELSE 'ACTIVE' END AS status,
            strftime(date_trunc('second', ts) + INTERVAL 1 DAY * CASE WHEN event_type IN ('click', 'error', 'purchase') THEN 0 WHEN event_id % 4 = 0 THEN 1 WHEN event_id % 4 = 1 THEN 7 ELSE 0 END, '%Y-%m-%d %H:%M:%S') AS next_trigger_at,
            CASE WHEN event_type NOT IN ('click', 'error', 'purchase') THEN {_SECOND} END AS last_triggered_at FROM events""",
    "alarm_actions": """
        WITH a AS (
            SELECT event_id AS id, CASE event_type WHEN 'click' THEN 'PAUSED' WHEN 'error' THEN 'CANCELLED' WHEN 'purchase' THEN 'COMPLETED' ELSE 'ACTIVE' END AS s,
                ['PAUSE', 'RESUME', 'COMPLETE', 'SKIP', 'CANCEL', 'OTHER'][user_id % 6 + 1] AS action FROM events
        ), b AS (
            SELECT *, CASE WHEN action = 'PAUSE' AND s = 'ACTIVE' THEN 'PAUSED' WHEN action = 'RESUME' AND s = 'PAUSED' THEN 'ACTIVE' WHEN action = 'COMPLETE' AND s <> 'CANCELLED' THEN 'COMPLETED'
                WHEN action = 'SKIP' AND s = 'ACTIVE' THEN 'ACTIVE' WHEN action = 'CANCEL' AND s <> 'COMPLETED' THEN 'CANCELLED' END AS t FROM a
        ), c AS (SELECT *, t IS NOT NULL AND action = 'SKIP' AS skipped, t = 'COMPLETED' AND s <> 'COMPLETED' AS completed, t = 'CANCELLED' AND s <> 'CANCELLED' AS cancelled FROM b)
        SELECT id, coalesce(t, s) AS status, CASE WHEN completed THEN 'COMPLETED' WHEN skipped THEN 'SKIPPED' END AS event_type, t IS NULL AS refused,
            CASE WHEN completed THEN '2024-02-01 00:00:00' END AS completed_at, CASE WHEN cancelled THEN '2024-02-01 00:00:00' END AS cancelled_at,
            CASE WHEN completed OR cancelled OR skipped THEN '2024-02-01 00:00:00' END AS updated_at FROM c""",
    "alarm_skips": _FOLD + """, g AS (
            SELECT alarm_id, v.s AS status, v.k AS n_skip, v.r AS refused, start,
                CASE alarm_id % 4 WHEN 0 THEN v.k WHEN 1 THEN 7 * v.k WHEN 2 THEN least(v.k, 2) ELSE 0 END AS ahead,
                CASE alarm_id % 4 WHEN 0 THEN v.k - 1 WHEN 1 THEN 7 * (v.k - 1) WHEN 2 THEN least(v.k - 1, 2) ELSE 0 END AS behind FROM f
        )
        SELECT alarm_id, status, n_skip, refused, strftime(start + INTERVAL 1 DAY * ahead, '%Y-%m-%d %H:%M:%S') AS next_trigger_at,
            CASE WHEN n_skip > 0 THEN strftime(start + INTERVAL 1 DAY * behind, '%Y-%m-%d %H:%M:%S') END AS last_triggered_at FROM g""",
    "stream_skips": _FOLD + " SELECT alarm_id, v.s AS status, v.k AS skipped, v.r AS refused FROM f",
    "manual_retry": f"""
        WITH j AS (
            SELECT j.event_id AS id, j.event_type, e.user_id AS alarm_id, CASE WHEN e.event_id % 11 <> 0 THEN e.event_id % 9 END AS subscription_id, e.event_id AS ref, strftime(date_trunc('second', e.ts), '%Y-%m-%d %H:%M:%S') AS due
            FROM events j LEFT JOIN events e ON e.event_id = 2 * j.event_id
        ), c AS (
            SELECT *, CASE WHEN event_type <> 'error' THEN 'NOT_FAILED' WHEN id % 5 = 0 OR id % 7 = 0 THEN 'NO_RETRY_HANDLER' WHEN ref IS NULL OR subscription_id IS NULL THEN 'CONTEXT_MISSING'
                WHEN alarm_id % 10 = 3 OR subscription_id = 8 THEN 'TARGET_MISSING' END AS error FROM j
        )
        SELECT id, error, CASE WHEN error IS NULL THEN 'alarm:1:2:' || id || ':manual:' || md5(id::VARCHAR) END AS idempotency_key, CASE WHEN error IS NULL THEN alarm_id END AS alarm_id,
            CASE WHEN error IS NULL THEN subscription_id END AS subscription_id, CASE WHEN error IS NULL THEN due END AS trigger_at FROM c""",
    "push_attempts": """
        WITH a AS (
            SELECT event_id AS id, user_id % 5 <> 0 AND (event_id % 50) % 9 <> 0 AS reachable, event_type IN ('view', 'click', 'signup') AS claimed, event_id % 4 AS r, event_id % 50 AS sub, [201, 201, 404, 410, 429, 503, 400][event_id % 7 + 1] AS code FROM events
        ), k AS (SELECT *, CASE WHEN code = 201 THEN 'SUCCESS' WHEN code IN (404, 410) THEN 'EXPIRED' WHEN code IN (429, 503) THEN 'RETRYABLE' ELSE 'PERMANENT_FAILURE' END AS kind FROM a),
        s AS (
            SELECT *, CASE WHEN NOT claimed THEN 'QUEUED' WHEN NOT reachable THEN 'CANCELLED' WHEN kind = 'SUCCESS' THEN 'COMPLETED' WHEN kind = 'RETRYABLE' AND r < 2 THEN 'RETRY_WAITING' ELSE 'FAILED' END AS status,
                CASE kind WHEN 'EXPIRED' THEN 'PUSH_SUBSCRIPTION_EXPIRED' WHEN 'RETRYABLE' THEN 'PUSH_TEMPORARY_ERROR' WHEN 'PERMANENT_FAILURE' THEN 'PUSH_REJECTED' END AS error FROM k
        ), t AS (SELECT *, CASE WHEN kind = 'RETRYABLE' AND status IN ('RETRY_WAITING', 'FAILED') THEN r + 1 ELSE r END AS tries FROM s)
        SELECT 'job' AS what, id::VARCHAR AS id, status, tries AS n, CASE WHEN status IN ('FAILED', 'RETRY_WAITING') THEN error WHEN status = 'COMPLETED' THEN 'k' || id || '#' || tries END AS detail,
            CASE WHEN status = 'RETRY_WAITING' THEN CAST(30 * 2 ** (tries - 1) AS INT)::VARCHAR END AS wait, status IN ('CANCELLED', 'COMPLETED', 'FAILED') AS flag FROM t
        UNION ALL SELECT 'event', 'k' || id || '#' || tries, CASE status WHEN 'COMPLETED' THEN 'SENT' ELSE 'FAILED' END, CASE WHEN status = 'FAILED' THEN code END, CASE WHEN status = 'FAILED' THEN error END, NULL, true FROM t WHERE status IN ('COMPLETED', 'FAILED')
        UNION ALL SELECT 'subscription', sub::VARCHAR, NULL, NULL, CASE WHEN bool_or(status = 'COMPLETED') THEN '2024-02-01' END, NULL, sub % 9 <> 0 AND NOT bool_or(status = 'FAILED' AND kind = 'EXPIRED') FROM t GROUP BY sub""",
    "delayed_jobs": """
        SELECT event_id AS id, strftime(TIMESTAMP '2024-02-01' + INTERVAL 1 MINUTE * ((event_id * 37) % 120), '%Y-%m-%d %H:%M:%S') AS available_at FROM events
        WHERE event_type <> 'error' AND (event_id * 37) % 120 <= 60 ORDER BY (event_id * 37) % 120, event_id LIMIT 100""",
    "alarm_requests": """
        WITH r AS (
            SELECT event_id AS id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE ['America/New_York', 'Europe/Berlin', 'Asia/Seoul'][event_id % 3 + 1] END AS zone,
                CASE WHEN event_id % 13 <> 0 THEN TIMESTAMP '2024-03-08' + INTERVAL 1 MINUTE * (event_id % 30000) END AS asked,
                CASE WHEN event_id % 5 = 0 THEN 7 WHEN event_id % 5 = 1 THEN 0 WHEN event_id % 19 = 2 THEN -1 WHEN event_id % 5 < 4 THEN 1 END AS days, event_id % 4 <> 0 AS medication, (event_id % 4 > 0) <> (event_id % 31 = 0) AS slot FROM events
        ), n AS (
            SELECT *, CASE WHEN days > 0 AND asked IS NOT NULL AND zone IS NOT NULL THEN timezone('UTC', timezone(zone, timezone(zone, timezone('UTC', asked)) + INTERVAL 1 DAY * days)) END AS upcoming FROM r
        )
        SELECT id, array_to_string(list_filter([
                CASE WHEN id % 23 = 0 THEN 'TITLE_LENGTH' END, CASE WHEN id % 29 = 0 THEN 'MESSAGE_LENGTH' END, CASE WHEN medication AND NOT slot THEN 'MEAL_SLOT_REQUIRED' END, CASE WHEN NOT medication AND slot THEN 'MEAL_SLOT_NOT_ALLOWED' END,
                CASE WHEN zone IS NULL THEN 'INVALID_TIMEZONE' END, CASE WHEN asked IS NULL THEN 'TIME_WITHOUT_ZONE' END, CASE WHEN days = -1 AND asked IS NOT NULL THEN 'INVALID_RULE' END,
                CASE WHEN days = 0 AND asked IS NOT NULL AND zone IS NOT NULL THEN 'NO_OCCURRENCE' END], lambda x: x IS NOT NULL), ',') AS errors,
            strftime(asked, '%Y-%m-%d %H:%M:%S') AS scheduled, strftime(upcoming, '%Y-%m-%d %H:%M:%S') AS upcoming FROM n""",
    "stream_retries": """
        WITH b AS (SELECT min(ts) AS low, max(ts) AS high, epoch_us(max(ts)) - epoch_us(min(ts)) AS width FROM events),
        s AS (SELECT event_id, event_type, ts, least(3, floor((epoch_us(ts) - epoch_us(low)) / (width / 4)))::INT AS slice FROM events, b),
        w AS (SELECT slice + 1 AS batch, max(epoch_ms(ts)) AS mark FROM s GROUP BY slice),
        m AS (SELECT *, CASE event_type WHEN 'error' THEN 9 WHEN 'click' THEN 2 WHEN 'purchase' THEN 1 WHEN 'view' THEN NULL ELSE 0 END AS fails FROM s),
        two AS (SELECT m.*, (SELECT min(batch) FROM w WHERE batch > slice AND mark >= epoch_ms(m.ts) + 60000) AS second FROM m),
        three AS (SELECT two.*, (SELECT min(w.batch) FROM w, w v WHERE v.batch = two.second AND w.batch > two.second AND w.mark >= v.mark + 60000) AS third FROM two),
        n AS (SELECT *, least(coalesce(fails + 1, 0), CASE WHEN third IS NOT NULL THEN 3 WHEN second IS NOT NULL THEN 2 ELSE 1 END) AS attempt FROM three)
        SELECT 'm' || event_id AS message_id, CASE WHEN fails IS NULL THEN 'rejected' WHEN attempt > fails THEN 'done' WHEN attempt = 3 THEN 'dead' ELSE 'pending' END AS outcome,
            CASE WHEN fails IS NULL THEN 0 ELSE attempt END AS attempt, CASE WHEN attempt <= fails THEN 'attempt ' || attempt END AS failure_message FROM n""",
}
