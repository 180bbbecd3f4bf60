"""Registered queries: alarms, jobs, deliveries and message streams over the event table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import machines, relational
from ..sources.readers import table
from ..streaming import state
from ..streaming.retries import STATE_STORE

NOW = "2024-01-16 00:00:00"
ACTION_OF = {"signup": "RESUME", "click": "PAUSE", "view": "SKIP", "purchase": "COMPLETE", "error": "CANCEL"}
STEP_OF = {"view": "CLAIM", "click": "RETRYABLE", "signup": "SUCCESS", "purchase": "PERMANENT_FAILURE", "error": "CANCEL"}
PRIORITY = ["view", "click", "signup", "purchase", "error"]


def _now():
    return F.to_timestamp_ntz(F.lit(NOW))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _named(mapping: dict[str, str]):
    return F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))[F.col("event_type")]


def max_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _events(spark, sf_dir).withColumn("p", relational.priority(F.col("event_type"), PRIORITY))
    return ranked.groupBy("user_id").agg(F.max_by("event_type", "p").alias("top"), F.max("p").alias("priority"))


def first_n_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = (F.col("ts") >= _now()) & (F.col("event_type") == "error")
    return relational.first_due(_events(spark, sf_dir), due, [F.col("ts"), F.col("event_id")]).select("event_id", "user_id")


def poly_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of events, some of a manual retry and some broken, parsed back."""
    key = text.alarm_key(F.col("event_id"), F.col("user_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    marked = F.when(F.col("event_id") % 3 == 0, F.concat(key, F.lit(":manual:ab:c"))).when(F.col("event_id") % 7 == 0, F.concat(F.lit("x"), key)).otherwise(key)
    parsed = text.parse_alarm_key(marked)
    return _events(spark, sf_dir).select("event_id", parsed["alarm_id"].alias("alarm_id"), parsed["subscription_id"].alias("subscription_id"), parsed["trigger_text"].alias("trigger_text"))


def backoff_due(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "QUEUED").when(F.col("event_type") == "click", "RETRY_WAITING").otherwise("COMPLETED")
    retries = (F.col("event_id") % 4).cast("int")
    updated = F.when(F.col("event_id") % 11 != 0, F.col("ts"))
    due = dates.job_is_due(status, F.col("ts"), updated, retries, _now())
    found = _events(spark, sf_dir).select("event_id", status.alias("status"), dates.backoff_seconds(retries).alias("backoff"), due.alias("due"))
    return found.filter("due")


def duration_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = dates.plus_seconds(F.col("ts"), F.col("value"))
    start = F.when(F.col("event_id") % 5 != 0, F.col("ts"))
    return _events(spark, sf_dir).select("event_id", dates.duration_ms(start, F.date_trunc("SECOND", end).cast("timestamp_ntz")).alias("duration_ms"))


def rrule_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = F.when(F.col("event_id") % 3 == 0, "FREQ=DAILY").when(F.col("event_id") % 3 == 1, "FREQ=WEEKLY")
    start = F.to_timestamp_ntz(F.lit("2023-12-30 08:00:00"))
    following = dates.next_plain_occurrence(rule, start, F.col("ts"))
    return _events(spark, sf_dir).select("event_id", F.date_format(following, "yyyy-MM-dd HH:mm:ss").alias("next_at"))


def rrule_general(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that arithmetic doesn't cover, by Arrow batches."""
    rule = F.when(F.col("event_id") % 2 == 0, "FREQ=WEEKLY;BYDAY=MO,TH").otherwise("FREQ=MONTHLY;BYMONTHDAY=15;COUNT=3")
    at = lambda c: c.cast("timestamp")
    following = dates.next_occurrence(rule, at(F.to_timestamp_ntz(F.lit("2023-12-30 08:00:00"))), at(F.date_trunc("HOUR", "ts")))
    return _events(spark, sf_dir).select("event_id", F.date_format(following, "yyyy-MM-dd HH:mm:ss").alias("next_at"))


def _alarms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    events = _events(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, machines.SETTING_OF_TYPE)), (F.col("event_id") % 3 + 1).cast("int"))
    alarms = events.select(
        F.col("event_id").alias("id"), "user_id", kind.alias("alarm_type"), F.when(F.col("event_type") == "error", "PAUSED").otherwise("ACTIVE").alias("status"),
        F.col("ts").alias("scheduled_at"), F.date_trunc("SECOND", "ts").cast("timestamp_ntz").alias("next_trigger_at"), F.when(F.col("event_type") == "view", F.col("ts")).alias("last_triggered_at"),
        F.when(F.col("event_id") % 2 == 0, "FREQ=DAILY").alias("recurrence_rule"),
    )
    users = events.select("user_id").distinct()
    settings = users.filter("user_id % 4 <> 0").select("user_id", *(((F.col("user_id") % 3) != i).alias(s) for i, s in enumerate(machines.SETTING_OF_TYPE.values())))
    pushes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 200).cast("long").alias("user_id"), (F.col("c_custkey") % 3 != 0).alias("is_active"))
    return alarms, settings, pushes.filter("user_id % 5 <> 0")


def due_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tick's jobs and events, in one list."""
    found = machines.poll(*_alarms(spark, sf_dir), _now())
    jobs = found["jobs"].select("alarm_id", F.lit("JOB").alias("kind"), "subscription_id", F.lit(None).cast("string").alias("why"))
    events = found["events"].select("alarm_id", F.col("event_type").alias("kind"), F.lit(None).cast("long").alias("subscription_id"), F.coalesce("reason", "error_code").alias("why"))
    return jobs.unionByName(events)


def due_poll_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alarms that one tick has changed."""
    changed = machines.poll(*_alarms(spark, sf_dir), _now())["alarms"]
    return changed.select("id", F.date_format("last_triggered_at", "yyyy-MM-dd HH:mm:ss").alias("last_at"), F.date_format("next_trigger_at", "yyyy-MM-dd HH:mm:ss").alias("next_at"))


def alarm_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = _events(spark, sf_dir).select((F.col("event_id") % 1000).alias("alarm_id"), "ts", "event_id", _named(ACTION_OF).alias("step"))
    return machines.fold_actions(actions, "alarm_id", ["ts", "event_id"], "step", machines.ALARM_MOVES, "ACTIVE")


def job_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = _events(spark, sf_dir).select((F.col("event_id") % 500).alias("job_id"), "ts", "event_id", _named(STEP_OF).alias("step"))
    return machines.fold_actions(steps, "job_id", ["ts", "event_id"], "step", machines.JOB_MOVES, "QUEUED", most_retries=1)


def push_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(F.lit(None).cast("int"), *map(F.lit, (200, 202, 204, 404, 410, 429, 500, 503))), (F.col("event_id") % 9 + 1).cast("int"))
    kind = machines.push_kind(code, F.col("event_id") % 13 == 0)
    return _events(spark, sf_dir).select("event_id", kind.alias("kind"), machines.push_error(kind).alias("error"))


def idempotent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = _events(spark, sf_dir).select(text.alarm_key(F.col("user_id"), F.col("event_id") % 50, F.date_format("ts", "yyyy-MM-dd")).alias("idempotency_key"), "event_id", "ts")
    existing = keyed.filter("event_id % 10 = 0").select("idempotency_key")
    return machines.new_jobs(keyed, existing, ["ts", "event_id"]).select("idempotency_key", "event_id")


def delivery_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "SENT").when(F.col("event_type") == "click", "DELIVERED").otherwise("OTHER")
    events = _events(spark, sf_dir).select("user_id", (F.col("event_id") % 3).alias("push_id"), "event_id", kind.alias("event_type"))
    found = machines.acknowledge(events, ["user_id", "push_id"], ["event_id"])
    return found.select("user_id", "push_id", F.col("sent_first.event_id").alias("sent"), F.col("delivered.event_id").alias("delivered"), "refused")


def recover_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waiting jobs made from events, with the context of their event, their parent's, or their key."""
    events = _events(spark, sf_dir)
    key = text.alarm_key(F.col("event_id"), F.col("user_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    refers = F.col("event_id") % 4 == 1
    jobs = events.select(
        F.col("event_id").alias("id"), key.alias("idempotency_key"), F.lit("ALARM").alias("job_type"), F.when(F.col("event_type") == "view", "QUEUED").otherwise("COMPLETED").alias("status"),
        F.when(refers, "alarm_events").alias("reference_table"), F.when(refers, F.col("event_id") * 2).alias("reference_id"), F.col("ts").alias("requested_at"), F.col("ts").alias("updated_at"),
        F.lit(0).alias("retry_count"), F.when(F.col("event_id") % 4 == 2, F.col("event_id") - 1).alias("parent_job_id"),
    )
    facts = events.select(F.col("event_id").alias("id"), F.col("user_id").alias("alarm_id"), (F.col("event_id") % 9).alias("push_subscription_id"), F.col("ts").cast("timestamp").alias("event_at"))
    return machines.recover(jobs, facts, _now()).select("id", "alarm_id", "subscription_id", F.date_format("trigger_at", "yyyy-MM-dd HH:mm:ss").alias("trigger_at"))


def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type, from the event table read as a stream until its end."""
    schema = _events(spark, sf_dir).schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    keyed = stream.select(F.concat_ws(":", "user_id", "event_type").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return _drain(spark, state.first_of_key(keyed, "key", "ts", "365 days").select("key"), "append")


def stream_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alarm machine as keyed state over the event stream: each alarm's last status."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    schema = _events(spark, sf_dir).schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parquet*")
    actions = stream.select((F.col("event_id") % 1000).alias("alarm_id"), "event_id", F.col("ts").cast("timestamp").alias("at"), _named(ACTION_OF).alias("step"))
    rows = _drain(spark, state.run_actions(actions, "alarm_id", "event_id", "step", time_col="at", keep_seconds=90 * 24 * 3600), "update")
    total = F.col("applied") + F.col("refused")
    return rows.groupBy("alarm_id").agg(*(F.max_by(c, total).alias(c) for c in ("status", "applied", "refused")))


def stream_folder(spark: SparkSession) -> str:
    """A new folder for a stream's files in the one that ``spark.checkpoint.dir`` names; a local one where that is unset in local mode, else ValueError."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{named.rstrip('/')}/streams/{uuid.uuid4().hex}" if named else tempfile.mkdtemp(prefix="carelattice-")


def _drain(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream until its input ends and return what it has put out."""
    out, checkpoint = (f"{stream_folder(spark)}/{name}" for name in ("out", "checkpoint"))
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}")
    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).drop("batch")


QUERIES = {
    f.__name__: f
    for f in (
        max_priority, first_n_due, poly_reference, backoff_due, duration_ms, rrule_next, rrule_general, due_poll, due_poll_alarms, alarm_fold, job_fold,
        push_results, idempotent_jobs, delivery_ack, recover_jobs, stream_dedup, stream_actions,
    )
}


def _case(mapping: dict[str, str]) -> str:
    return "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


def _fold(key: int, name: str, steps: dict[str, str], moves: dict[str, dict[str, str]], start: str, retries: int | None) -> str:
    """The fold as a list_reduce over encoded states ``status|applied|refused|retries``."""
    part = lambda i: f"split_part(s, '|', {i})"
    arms = " ".join(f"WHEN a = '{a}' AND {part(1)} = '{b}' THEN '{c}'" for a, table_ in moves.items() for b, c in table_.items())
    after = f"(CASE {arms} END)"
    tried = f"(CAST({part(4)} AS INT) + CASE WHEN a = 'RETRYABLE' AND {after} IS NOT NULL THEN 1 ELSE 0 END)"
    final = after if retries is None else f"(CASE WHEN {after} = 'RETRY_WAITING' AND {tried} > {retries} THEN 'FAILED' ELSE {after} END)"
    step = f"coalesce({final}, {part(1)}) || '|' || (CAST({part(2)} AS INT) + CASE WHEN {after} IS NULL THEN 0 ELSE 1 END) || '|' || (CAST({part(3)} AS INT) + CASE WHEN {after} IS NULL THEN 1 ELSE 0 END) || '|' || {tried}"
    more = "" if retries is None else ", CAST(split_part(f, '|', 4) AS INT) AS retries"
    return f"""
        WITH l AS (SELECT event_id % {key} AS {name}, list({_case(steps)} ORDER BY ts, event_id) AS steps FROM events GROUP BY 1),
        f AS (SELECT {name}, list_reduce(list_concat(['{start}|0|0|0'], steps), lambda s, a: {step}) AS f FROM l)
        SELECT {name}, split_part(f, '|', 1) AS status, CAST(split_part(f, '|', 2) AS INT) AS applied, CAST(split_part(f, '|', 3) AS INT) AS refused{more} FROM f"""


_DUE = f"""
    WITH a AS (
        SELECT event_id AS id, user_id, event_id % 3 AS kind, date_trunc('second', ts) AS next_at, event_id % 2 = 0 AS daily, ts AS start FROM events
        WHERE event_type <> 'error' AND event_type <> 'view' AND date_trunc('second', ts) <= TIMESTAMP '{NOW}' ORDER BY date_trunc('second', ts), event_id LIMIT 100
    )"""
SQL = {
    "rrule_general": """
        WITH e AS (SELECT event_id, date_trunc('hour', ts) AS h, date_trunc('day', ts) AS d FROM events),
        c AS (
            SELECT event_id, h, unnest(CASE WHEN event_id % 2 = 0 THEN list_filter(list_transform(range(9), lambda i: d + INTERVAL 1 DAY * i + INTERVAL 8 HOUR), lambda x: dayofweek(x) IN (1, 4))
                ELSE [TIMESTAMP '2024-01-15 08:00:00', TIMESTAMP '2024-02-15 08:00:00', TIMESTAMP '2024-03-15 08:00:00'] END) AS x FROM e
        )
        SELECT event_id, strftime(min(x) FILTER (WHERE x > h), '%Y-%m-%d %H:%M:%S') AS next_at FROM c GROUP BY event_id""",
    "max_priority": """SELECT user_id, max_by(event_type, p) AS top, max(p) AS priority FROM (
        SELECT *, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 5 END AS p FROM events) GROUP BY user_id""",
    "first_n_due": f"SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '{NOW}' AND event_type = 'error' ORDER BY ts, event_id LIMIT 100",
    "poly_reference": """SELECT event_id, CASE WHEN ok THEN event_id END AS alarm_id, CASE WHEN ok THEN user_id END AS subscription_id, CASE WHEN ok THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS trigger_text
        FROM (SELECT *, event_id % 3 = 0 OR event_id % 7 <> 0 AS ok FROM events)""",
    "backoff_due": f"""
        WITH j AS (SELECT event_id, ts, CASE event_type WHEN 'view' THEN 'QUEUED' WHEN 'click' THEN 'RETRY_WAITING' END AS status,
            CAST(30 * power(2, greatest(0, event_id % 4 - 1)) AS BIGINT) AS backoff FROM events WHERE event_type IN ('view', 'click'))
        SELECT event_id, status, backoff, true AS due FROM j WHERE (status = 'QUEUED' AND ts <= TIMESTAMP '{NOW}' - INTERVAL 30 SECOND)
            OR (status = 'RETRY_WAITING' AND (event_id % 11 = 0 OR ts + to_seconds(backoff) <= TIMESTAMP '{NOW}'))""",
    "duration_ms": """SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN CAST(greatest(0, trunc((epoch_us(date_trunc('second', ts + to_microseconds(CAST(round(value * 1000000) AS BIGINT)))) - epoch_us(ts)) / 1000)) AS INT) END AS duration_ms FROM events""",
    "rrule_next": """SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(TIMESTAMP '2023-12-30 08:00:00' + to_days(CAST(d + 1 AS INT)), '%Y-%m-%d %H:%M:%S')
        WHEN 1 THEN strftime(TIMESTAMP '2023-12-30 08:00:00' + to_days(CAST((d // 7 + 1) * 7 AS INT)), '%Y-%m-%d %H:%M:%S') END AS next_at
        FROM (SELECT *, datesub('day', TIMESTAMP '2023-12-30 08:00:00', ts) AS d FROM events)""",
    "due_poll": _DUE + """,
        k AS (SELECT a.*, user_id % 4 = 0 OR user_id % 3 <> kind AS enabled FROM a),
        p AS (SELECT c_custkey AS sub, c_custkey % 200 AS user_id FROM customer WHERE c_custkey % 3 <> 0 AND (c_custkey % 200) % 5 <> 0)
        SELECT id AS alarm_id, 'JOB' AS kind, sub AS subscription_id, NULL AS why FROM k JOIN p USING (user_id) WHERE enabled
        UNION ALL SELECT id, 'SKIPPED', NULL, 'USER_NOTIFICATION_DISABLED' FROM k WHERE NOT enabled
        UNION ALL SELECT id, 'FAILED', NULL, 'NO_ACTIVE_SUBSCRIPTION' FROM k WHERE enabled AND user_id NOT IN (SELECT user_id FROM p)""",
    "due_poll_alarms": _DUE + """
        SELECT id, strftime(next_at, '%Y-%m-%d %H:%M:%S') AS last_at,
            strftime(CASE WHEN daily THEN CASE WHEN next_at < start THEN start ELSE start + INTERVAL 1 DAY END ELSE next_at END, '%Y-%m-%d %H:%M:%S') AS next_at FROM a""",
    "alarm_fold": _fold(1000, "alarm_id", ACTION_OF, machines.ALARM_MOVES, "ACTIVE", None),
    "job_fold": _fold(500, "job_id", STEP_OF, machines.JOB_MOVES, "QUEUED", 1),
    "push_results": """
        WITH c AS (SELECT event_id, event_id % 13 = 0 AS late, [NULL, 200, 202, 204, 404, 410, 429, 500, 503][event_id % 9 + 1] AS code FROM events),
        k AS (SELECT event_id, CASE WHEN late THEN 'RETRYABLE' WHEN code IS NULL OR code <= 202 THEN 'SUCCESS' WHEN code IN (404, 410) THEN 'EXPIRED' WHEN code = 429 OR code >= 500 THEN 'RETRYABLE' ELSE 'PERMANENT_FAILURE' END AS kind FROM c)
        SELECT event_id, kind, CASE kind WHEN 'EXPIRED' THEN 'PUSH_SUBSCRIPTION_EXPIRED' WHEN 'RETRYABLE' THEN 'PUSH_TEMPORARY_ERROR' WHEN 'PERMANENT_FAILURE' THEN 'PUSH_REJECTED' END AS error FROM k""",
    "idempotent_jobs": """
        WITH k AS (SELECT 'alarm:' || user_id || ':' || event_id % 50 || ':' || strftime(ts, '%Y-%m-%d') AS idempotency_key, event_id, ts FROM events)
        SELECT idempotency_key, arg_min(event_id, ts) AS event_id FROM k WHERE idempotency_key NOT IN (SELECT idempotency_key FROM k WHERE event_id % 10 = 0) GROUP BY 1""",
    "delivery_ack": """
        WITH e AS (SELECT user_id, event_id % 3 AS push_id, event_id, event_type FROM events), s AS (SELECT user_id, push_id, min(event_id) FILTER (WHERE event_type = 'view') AS sent FROM e GROUP BY ALL)
        SELECT s.user_id, s.push_id, any_value(sent) AS sent, min(event_id) FILTER (WHERE event_type = 'click' AND event_id > sent) AS delivered,
            count(*) FILTER (WHERE event_type = 'click' AND NOT coalesce(event_id > sent, false)) AS refused FROM s JOIN e USING (user_id, push_id) GROUP BY s.user_id, s.push_id""",
    "recover_jobs": f"""
        WITH c AS (SELECT * FROM events WHERE event_type = 'view' AND ts <= TIMESTAMP '{NOW}' - INTERVAL 30 SECOND ORDER BY ts, event_id LIMIT 100),
        r AS (SELECT c.event_id AS id, p.event_id AS use, p.user_id, p.ts FROM c JOIN events p ON p.event_id = CASE WHEN c.event_id % 4 = 2 THEN c.event_id - 1 ELSE c.event_id END)
        SELECT id, CASE WHEN use % 4 = 1 THEN e.user_id ELSE use END AS alarm_id, CASE WHEN use % 4 = 1 THEN e.event_id % 9 ELSE r.user_id END AS subscription_id,
            strftime(CASE WHEN use % 4 = 1 THEN e.ts ELSE r.ts END, '%Y-%m-%d %H:%M:%S') AS trigger_at
        FROM r LEFT JOIN events e ON use % 4 = 1 AND e.event_id = use * 2 WHERE use % 4 <> 1 OR e.event_id IS NOT NULL""",
    "stream_dedup": "SELECT DISTINCT user_id || ':' || event_type AS key FROM events",
    "stream_actions": _fold(1000, "alarm_id", ACTION_OF, machines.ALARM_MOVES, "ACTIVE", None).replace("ORDER BY ts, event_id", "ORDER BY event_id"),
}
