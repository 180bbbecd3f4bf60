"""Registered queries: records as they come in, their states, and what an answer is given as."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import collections
from ..operators import machines, relational
from ..sources.readers import confirmed_only, diagnosis_list, table, visit_time
from ..streaming import index_jobs
from . import assembly, rules

def expired_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as push subscriptions, events as push attempts; an expired push deactivates its subscription."""
    events = table(spark, sf_dir, "events")
    code = F.when((F.col("event_type") == "error") & (F.col("event_id") % 5 == 0), 410).when(F.col("event_type") == "error", 503).otherwise(201)
    attempts = events.select("user_id", machines.push_kind(code, F.col("event_id") % 17 == 0).alias("kind"))
    subscriptions = events.select("user_id").distinct().withColumn("is_active", F.col("user_id") % 10 != 0)
    return machines.deactivate_expired(subscriptions, attempts, "user_id")


def claim_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "view", "QUEUED").when(F.col("event_type") == "click", "RETRY_WAITING").otherwise("COMPLETED")
    return machines.claim(table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), status.alias("status")), 7)


def used_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many kinds of events each user has, and which, as a sorted list without repeats."""
    kinds = table(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("n_kinds"), F.collect_set("event_type").alias("kinds"))
    return kinds.select("user_id", "n_kinds", F.array_join(collections.sorted_unique(F.col("kinds")), ",").alias("kinds"))


def reshape_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested record loses one field and has another one replaced."""
    record = F.struct("o_orderstatus", "o_orderpriority", "o_totalprice")
    changed = record.dropFields("o_totalprice").withField("o_orderstatus", F.lower("o_orderstatus"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(changed).alias("record"))


def low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unsure fields of each order, then one entry for each unsure line."""
    sure = lambda c: F.when(c, "low").otherwise("high")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(F.struct(sure(F.col("l_quantity") < 10).alias("confidence"))).alias("lines"))
    none = F.array().cast("array<struct<confidence:string>>")
    rows = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").withColumn("lines", F.coalesce("lines", none))
    fields = {"priority": sure(F.col("o_orderpriority") == "5-LOW"), "status": sure(F.col("o_orderkey") % 3 == 0)}
    return rows.select("o_orderkey", F.array_join(assembly.low_confidence(fields, F.col("lines"), none), ",").alias("unsure"))


def from_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as medications in older field names, some with the newer ones beside them."""
    n, q = F.col("l_linenumber"), F.col("l_quantity").cast("int")
    old = F.struct(
        F.when(n % 2 == 0, F.concat(F.lit("new"), n)).alias("name"), F.concat(F.lit("old"), n).alias("drug_name"), F.lit(None).cast("string").alias("dose"),
        F.when(n % 3 == 0, n.cast("int")).alias("times_per_day"), F.concat(F.lit("daily "), q.cast("string"), F.lit(" times")).alias("frequency"),
        F.when(n % 5 == 0, "note").alias("note"), F.col("l_returnflag").alias("administration_instruction"),
        F.lit(None).cast("int").alias("days"), F.when(n != 4, F.concat(q.cast("string"), F.lit(" days"))).alias("duration"),
    )
    m = assembly.from_legacy(old)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", m["name"].alias("name"), m["times_per_day"].alias("times_per_day"), m["note"].alias("note"), m["days"].alias("days"))


def finish_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("turn") % 3 == 0, "RESTRICTED").when(F.col("turn") % 3 == 1, "BLOCKED").otherwise("SAFE")
    done = rules.finish_answer(status, F.array(F.lit("A"), F.col("role")), F.array(F.lit("B"), F.lit("A")), F.col("role"), F.lit("restricted"), F.lit("blocked"), F.array("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", done["answer"].alias("answer"), F.array_join(done["codes"], ",").alias("codes"), F.size(done["sources"]).alias("n_sources"))


def diagnoses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A one-element list of each segment, an empty one where it is blank; and the time of a visit."""
    named = F.when(F.col("c_custkey") % 4 == 0, " ").when(F.col("c_custkey") % 4 == 1, F.lit(None)).otherwise(F.concat(F.lit(" "), "c_mktsegment"))
    found = diagnosis_list(named)
    return table(spark, sf_dir, "customer").select("c_custkey", F.size(found).alias("n"), F.array_join(found, ",").alias("diagnoses"))


def confirmed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a time and a hash of confirmation, and the others, marked."""
    event = F.col("event_id")
    records = table(spark, sf_dir, "events").select("event_id", F.when(event % 3 != 0, F.col("ts")).alias("confirmed_at"), F.when(event % 4 == 0, "").when(event % 4 != 1, F.md5(event.cast("string"))).alias("confirmation_hash"))
    good, bad = confirmed_only(records)
    return good.select("event_id", F.lit(True).alias("accepted")).unionByName(bad.select("event_id", F.lit(False).alias("accepted")))


def reject_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of customers with money, and the others, marked."""
    rich = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    good, bad = relational.reject_missing(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), rich, ["o_custkey"])
    return good.select("o_orderkey", F.lit(True).alias("accepted")).unionByName(bad.select("o_orderkey", F.lit(False).alias("accepted")))


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed messages with their fields and what happened."""
    fields = F.create_map(F.lit("user_id"), F.col("user_id").cast("string"), F.lit("failure_type"), F.lit("old"))
    failed = table(spark, sf_dir, "events").filter("event_type = 'error'").select(F.concat(F.lit("m-"), "event_id").alias("message_id"), fields.alias("fields"), F.lit("HandlerError").alias("failure_type"), F.concat(F.lit("event "), "event_id").alias("failure_message"))
    f = F.col("fields")
    return index_jobs.dead_letters(failed).select("message_id", f["user_id"].alias("user_id"), f["original_message_id"].alias("original"), f["failure_type"].alias("failure_type"), f["failure_message"].alias("failure_message"))


def guard_guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn as a guide: lines that differ from the expected ones block it, a notice without the disclaimer restricts it."""
    none = F.array().cast("array<string>")
    notice = F.when(F.col("turn") % 2 == 0, "이 안내는 의사의 진료를 대체하지 않습니다").otherwise("ok")
    lines = F.array(F.when(F.col("turn") % 3 == 0, "a").otherwise("b"))
    found = rules.guard_guide(F.array("role"), notice, none, none, lines, F.array(F.lit("b")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", found["status"].alias("status"), F.array_join(found["codes"], ",").alias("codes"))


def visit_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day and clock time of each event, put together again."""
    day, clock = F.to_date("ts"), F.date_format("ts", "HH:mm")
    return table(spark, sf_dir, "events").select("event_id", F.date_format(visit_time(day, clock), "yyyy-MM-dd HH:mm").alias("visit_at"))


QUERIES = {
    f.__name__: f
    for f in (
        expired_subscriptions, claim_job, used_slots, reshape_record, low_confidence, from_legacy, finish_answer, diagnoses,
        confirmed_records, reject_missing, dead_letters, guard_guides, visit_times,
    )
}
SQL = {
    "expired_subscriptions": """
        SELECT user_id, user_id % 10 <> 0 AND NOT bool_or(event_type = 'error' AND event_id % 5 = 0 AND event_id % 17 <> 0) AS is_active FROM events GROUP BY user_id""",
    "claim_job": """
        SELECT event_id AS id, event_id = 7 AND event_type IN ('view', 'click') AS claimed,
            CASE WHEN event_id = 7 AND event_type IN ('view', 'click') THEN 'PROCESSING' WHEN event_type = 'view' THEN 'QUEUED' WHEN event_type = 'click' THEN 'RETRY_WAITING' ELSE 'COMPLETED' END AS status
        FROM events""",
    "used_slots": "SELECT user_id, count(DISTINCT event_type) AS n_kinds, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY user_id",
    "reshape_record": """SELECT o_orderkey, '{"o_orderstatus":"' || lower(o_orderstatus) || '","o_orderpriority":"' || o_orderpriority || '"}' AS record FROM orders""",
    "low_confidence": """
        WITH l AS (SELECT l_orderkey, count(*) FILTER (l_quantity < 10) AS n FROM lineitem GROUP BY 1)
        SELECT o_orderkey, array_to_string(list_concat(list_filter([CASE WHEN o_orderpriority = '5-LOW' THEN 'priority' END, CASE WHEN o_orderkey % 3 = 0 THEN 'status' END], lambda x: x IS NOT NULL),
            list_transform(range(coalesce(n, 0)), lambda i: 'medication')), ',') AS unsure FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""",
    "from_legacy": """
        SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN 'new' ELSE 'old' END || l_linenumber AS name,
            CASE WHEN l_linenumber % 3 = 0 THEN l_linenumber ELSE CAST(l_quantity AS INT) END AS times_per_day,
            CASE WHEN l_linenumber % 5 = 0 THEN 'note' ELSE l_returnflag END AS note, CASE WHEN l_linenumber <> 4 THEN CAST(l_quantity AS INT) END AS days FROM lineitem""",
    "finish_answer": """
        SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'restricted' WHEN 1 THEN 'blocked' ELSE role END AS answer,
            CASE WHEN turn % 3 = 0 THEN 'B,A,' || role ELSE 'A,' || role END AS codes, CASE WHEN turn % 3 = 1 THEN 0 ELSE 1 END AS n_sources FROM conversations""",
    "diagnoses": """
        SELECT c_custkey, CASE WHEN c_custkey % 4 > 1 THEN 1 ELSE 0 END AS n, CASE WHEN c_custkey % 4 > 1 THEN c_mktsegment ELSE '' END AS diagnoses FROM customer""",
    "confirmed_records": "SELECT event_id, event_id % 3 <> 0 AND event_id % 4 > 1 AS accepted FROM events",
    "reject_missing": "SELECT o_orderkey, o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) AS accepted FROM orders",
    "dead_letters": """
        SELECT 'm-' || event_id AS message_id, CAST(user_id AS VARCHAR) AS user_id, 'm-' || event_id AS original, 'HandlerError' AS failure_type, 'event ' || event_id AS failure_message
        FROM events WHERE event_type = 'error'""",
    "guard_guides": """
        SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'BLOCKED' WHEN turn % 2 = 1 THEN 'RESTRICTED' ELSE 'SAFE' END AS status,
            CASE WHEN turn % 3 = 0 THEN 'PATIENT_MEDICATION_MISMATCH' WHEN turn % 2 = 1 THEN 'MISSING_MEDICAL_DISCLAIMER' ELSE '' END AS codes FROM conversations""",
    "visit_times": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS visit_at FROM events",
}
