"""Registered queries: citations and guides of patients made from orders, vector batches, and the constraint catalogue over derived tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import text
from ..operators import quality, relational
from ..sources import vector_table
from ..sources.readers import table
from . import assembly

INTENTS = ("PATIENT_FACT", "MEDICATION", "LIFESTYLE", "FOLLOW_UP", "GENERAL")


def _patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as patients: their lines are medications, instructions and visits, and those of more than 25 pieces public chunks."""
    order, n = F.col("o_orderkey"), F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), F.struct(n, "l_partkey", "l_suppkey", "l_shipdate", "l_quantity").alias("place"),
        F.struct(F.when(n % 2 == 1, F.col("l_partkey")).cast("long").alias("medication_id"), F.concat(F.lit("M"), "l_partkey").alias("name"), F.lit("1").alias("dose"), n.cast("int").alias("times_per_day"), F.lit(None).cast("string").alias("note"), F.col("l_quantity").cast("int").alias("days"), F.lit(None).cast("date").alias("prescribed_at")).alias("m"),
        F.struct((F.col("l_orderkey") * 10 + n).cast("long").alias("care_advice_id"), F.concat(F.lit("do "), "l_returnflag").alias("content"), (F.col("l_quantity").cast("int") % 3).alias("display_order"), F.lit(None).cast("string").alias("instruction_type")).alias("i"),
        F.struct(F.col("l_suppkey").cast("long").alias("follow_up_visit_id"), F.col("l_shipdate").cast("timestamp").alias("visit_at"), F.when(n % 3 == 0, "dept").alias("department"), F.lit(None).cast("string").alias("doctor_name"), F.when(n % 2 == 0, F.when(n % 4 == 0, "").otherwise("place")).alias("place"), F.lit("visit").alias("purpose"), F.when(n != 5, "clinic").alias("institution_name")).alias("v"),
        F.when(F.col("l_quantity") > 25, F.struct(F.concat_ws("-", F.lit("p"), "l_partkey").alias("point_id"), (F.col("l_discount").cast("double") + 0.5).alias("score"), _metadata().alias("metadata"))).alias("c"),
    )
    child = lambda name, out: F.transform(F.array_sort(F.collect_list(F.struct("place", name))), lambda x: x[name]).alias(out)
    grouped = lines.groupBy("o_orderkey").agg(child("m", "medications"), child("i", "instructions"), child("v", "follow_up_schedules"), F.filter(child("c", "x"), lambda x: x.isNotNull()).alias("chunks"))
    return table(spark, sf_dir, "orders").join(grouped, "o_orderkey").select(
        "o_orderkey", F.when(order % 2 == 0, F.array("o_orderpriority")).otherwise(F.array().cast("array<string>")).alias("diagnoses"), F.when(order % 3 == 0, "").otherwise(F.col("o_orderstatus")).alias("surgery"),
        F.to_date("o_orderdate").alias("discharge_date"), "medications", "instructions", "follow_up_schedules", "chunks", F.element_at(F.array(*map(F.lit, INTENTS)), (order % 5 + 1).cast("int")).alias("intent"),
        F.when(order % 3 != 1, "PATIENT_AND_RAG").otherwise("PATIENT_ONLY").alias("route"), F.when(order % 7 != 0, F.array(F.lit("public"))).otherwise(F.array().cast("array<string>")).alias("public_information"),
    )


def _metadata():
    values = {"dataset_key": F.lit("guides"), "dataset_version": F.lit("v1"), "document_id": F.concat(F.lit("d"), "l_suppkey"), "title": F.col("l_returnflag"), "page_number": F.col("l_linenumber").cast("int")}
    fields = [f.strip().split(": ") for f in schemas.GUIDELINE_METADATA.replace("\n", " ").removeprefix("struct<").removesuffix(">").split(",")]
    return F.struct(*(values.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in fields))


def _cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = assembly.citations(F.col("intent"), F.col("route"), F.col("public_information"), F.col("chunks"))
    return assembly.numbered(_patients(spark, sf_dir), cited, "o_orderkey")


def chat_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered citations of each answer, and whether each meets the constraints of citations."""
    rows = _cited(spark, sf_dir)
    kind = F.coalesce("patient_source_kind", F.lit("PUBLIC"))
    reference = F.coalesce("patient_field", *(F.col(c).cast("string") for c in ("medication_id", "care_advice_id", "follow_up_visit_id")), "vector_chunk_id")
    return rows.select("o_orderkey", "citation_order", kind.alias("kind"), reference.alias("reference"), "source_title", "source_page_number", F.round("similarity_score", 2).alias("similarity_score"), quality.source_union().alias("sound"))


def recovery_guide(spark: SparkSession, sf_dir: str) -> DataFrame:
    guide = assembly.recovery_guide(F.col("public_information"), F.array("route"))
    shown = lambda name: F.array_join(F.col(f"g.{name}"), "|").alias(name)
    names = ("medication_guide", "patient_instructions", "public_information", "lifestyle_guide", "follow_up_schedule")
    return _patients(spark, sf_dir).select("o_orderkey", guide.alias("g")).select("o_orderkey", *map(shown, names), F.size("g.warning_signs").alias("n_warnings"))


def visit_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as visits in older and newer field names, as the lines that a guide shows."""
    n, at = F.col("l_linenumber"), F.col("l_shipdate").cast("timestamp")
    none = F.lit(None).cast("string")
    old = F.struct(
        F.col("l_suppkey").cast("long").alias("follow_up_visit_id"), F.when(n % 2 == 0, at).alias("visit_at"), F.when(n != 3, at + F.expr("INTERVAL '1' DAY")).alias("scheduled_at"), none.alias("department"), F.col("l_returnflag").alias("doctor_name"),
        F.when(n > 4, "").otherwise(F.when(n > 2, "room")).alias("place"), F.when(n % 3 == 0, "check").alias("purpose"), F.when(n != 5, "older").alias("description"), F.when(n != 6, "clinic").alias("institution_name"),
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", n, "l_partkey", text.follow_up_line(assembly.visit_from_legacy(old)).alias("line"))


def order_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of orders and one past the end, each with the total."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    page = lambda number: relational.listing(orders, [F.desc("o_orderdate"), F.desc("o_orderkey")], number, 50)
    return page(2).unionByName(page(1_000_000)).select("offset", F.size("items").alias("n"), "total", F.array_join(F.transform("items", lambda x: x["o_orderkey"].cast("string")), ",").alias("orders"))


def vec_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in batches of ten, some with a list too short or a vector cut: the points of the batches that are taken, and the errors of the others."""
    n = F.floor(F.col("vec_id") / 10).cast("long")
    rows = table(spark, sf_dir, "embeddings").select(n.alias("batch"), "vec_id", F.when(F.col("vec_id") % 130 == 5, F.slice("embedding", 1, 63)).otherwise(F.col("embedding")).alias("vector"))
    lists = rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("vec_id", "vector"))).alias("x"))
    ids = F.transform("x", lambda r: F.concat(F.lit("p"), r["vec_id"]))
    batches = lists.select("batch", F.when(F.col("batch") % 7 == 0, F.slice(ids, F.lit(1), F.size(ids) - 1)).otherwise(ids).alias("ids"), F.transform("x", lambda r: F.concat(F.lit("chunk "), r["vec_id"])).alias("chunks"), F.when(F.col("batch") % 11 != 3, F.transform("x", lambda r: r["vector"])).alias("vectors"))
    points, refused = vector_table.pair(batches, 64, "batch")
    shown = points.select("batch", "point_id", "chunk", F.size("vector").alias("size"), F.lit(None).cast("string").alias("error"))
    return shown.unionByName(refused, allowMissingColumns=True)


def ocr_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as OCR jobs that break each of the nine checks somewhere."""
    n, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    later = lambda seconds: ts + F.make_dt_interval(secs=F.lit(seconds))
    status = F.element_at(F.array(*map(F.lit, ("QUEUED", "PROCESSING", "READY_FOR_REVIEW", "COMPLETE", "FAILED", "CANCELLED"))), (n % 6 + 1).cast("int"))
    ready = n % 6 == 2
    jobs = table(spark, sf_dir, "events").select(
        n.alias("id"), status.alias("status"), ts.alias("created_at"), F.when(ready != (n % 31 == 0), "{}").alias("structured_result"),
        F.when((n % 6 > 0) != (n % 37 == 0), F.when(n % 41 == 0, later(-5)).otherwise(later(1))).alias("started_at"),
        F.when(ready != (n % 43 == 0), F.when(n % 47 == 0, later(0)).otherwise(later(2))).alias("ready_at"), F.when(ready != (n % 53 == 0), F.when(n % 59 == 0, later(2)).otherwise(later(3))).alias("expires_at"),
        F.when(F.col("status").isin("COMPLETE", "FAILED", "CANCELLED") != (n % 61 == 0), F.when(n % 67 == 0, later(-9)).otherwise(later(4))).alias("completed_at"),
        F.when(n % 71 == 0, "OTHER").when(F.col("status") == "FAILED", "EXTRACTION_FAILED").when(F.col("status") == "CANCELLED", "USER_CANCELLED").alias("error_code"),
    )
    return quality.violations(jobs, quality.catalogue()["ocr_jobs"], "id")


def key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as users and subscriptions, orders as jobs: what breaks unique and foreign keys."""
    customers, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    key, order = F.col("c_custkey"), F.col("o_orderkey")
    tables = {
        "users": customers.filter(key % 10 != 3).select(key.alias("id"), F.when(key % 8 != 0, F.concat(F.lit("u"), F.floor(key / 2 * F.when(key % 50 < 10, 1).otherwise(2)))).alias("email")),
        "push_subscriptions": customers.select(key.alias("id"), F.when(key % 9 != 0, key).alias("user_id"), F.concat(F.lit("e"), key % 1000).alias("endpoint")),
        "background_jobs": orders.select(order.alias("id"), F.concat(F.lit("k"), "o_custkey", F.lit(":"), "o_orderdate").alias("idempotency_key"), F.lit(None).cast("long").alias("user_id"), F.when(order % 4 == 0, order + 1).alias("parent_job_id"), F.lit(0).alias("retry_count")),
    }
    return quality.table_violations(tables)


def record_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as episodes, advices, medications, guides, classifications and histories: the row checks of each table."""
    n, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    at = lambda when, shift: F.when(when, ts + F.make_dt_interval(days=F.lit(shift)))
    rows = table(spark, sf_dir, "events").select(n.alias("id"), "event_type", ts.alias("ts"))
    n, ts = F.col("id"), F.col("ts")
    tables = {
        "care_episodes": rows.select("id", ts.alias("started_at"), at(n % 3 == 0, 1).alias("default_end_at"), at(n % 5 == 0, -1).alias("planned_end_at"), at(n % 7 == 0, 2).alias("completed_at"), F.when(n % 2 == 0, n % 400).alias("medication_days"), F.when(n % 4 != 0, n).alias("source_ocr_job_id"), at(n % 12 != 0, 0).alias("confirmed_at"), F.when(n % 4 != 0, "h").alias("confirmation_hash")),
        "care_advices": rows.select("id", F.lit(None).cast("long").alias("care_episode_id"), (n % 6).alias("display_order")),
        "medications": rows.select("id", F.lit(None).cast("long").alias("care_episode_id"), F.when(n % 3 != 0, n % 8).alias("times_per_day"), F.when(n % 5 != 0, n % 367).alias("days"), F.when(n % 2 == 0, "note").alias("note")),
        "recovery_guides": rows.select("id", F.lit(None).cast("long").alias("care_episode_id"), F.when(n % 9 == 0, "PENDING").otherwise("SAFE").alias("safety_status"), F.when(n % 2 == 0, "COMPLETED").otherwise("SUPERSEDED").alias("status"), at(n % 2 != (n % 10 == 0).cast("int"), 1).alias("superseded_at"), F.when(n % 11 == 0, F.upper(F.sha2(n.cast("string"), 256))).otherwise(F.sha2(n.cast("string"), 256)).alias("patient_context_hash")),
        "classifications": rows.select("id", (n % 3 == 0).alias("needs_clarification"), F.when(n % 4 != 0, F.when(n % 2 == 0, "PATIENT_AND_RAG").otherwise("GENERAL")).alias("route"), F.when(n % 5 != 0, "q").alias("normalized_query"), F.when(n % 6 == 0, "HIGH").otherwise("LOW").alias("risk_level"), quality.clean_codes(F.array(F.when(n % 12 == 0, " ").otherwise(" A "), F.when(n % 12 == 0, "").otherwise("A"))).alias("reason_codes")),
        "history": rows.select("id", F.transform(F.sequence(F.lit(1), (n % 12 + 1).cast("int")), lambda i: F.struct(F.repeat(F.lit("x"), (n % 700 * 3).cast("int")).alias("content"))).alias("messages")),
    }
    return quality.table_violations(tables)


QUERIES = {f.__name__: f for f in (chat_citations, recovery_guide, visit_aliases, order_listing, vec_pairs, ocr_violations, key_violations, record_violations)}

_LINES = """
        WITH p AS (
            SELECT *, ['PATIENT_FACT', 'MEDICATION', 'LIFESTYLE', 'FOLLOW_UP', 'GENERAL'][o_orderkey % 5 + 1] AS intent, o_orderkey % 3 <> 1 AS rag, o_orderkey % 7 <> 0 AS shown
            FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)
        ), l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity) AS place FROM lineitem)"""


def _broken(table_name: str, kind: str, checks: dict[str, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT '{table_name}' AS \"table\", id, '{kind}' AS kind, '{name}' AS \"constraint\" FROM {source} WHERE NOT ({ok})" for name, ok in checks.items())


_AT = lambda s: f"ts + INTERVAL ({s}) SECOND"
SQL = {
    "chat_citations": _LINES + """, c AS (
            SELECT o_orderkey, 0 AS part, 1 AS i, 'CARE_EPISODE_FIELD' AS kind, 'DIAGNOSIS' AS reference, NULL AS title, NULL AS page, NULL AS score FROM p WHERE intent = 'PATIENT_FACT' AND o_orderkey % 2 = 0
            UNION ALL SELECT o_orderkey, 0, 2, 'CARE_EPISODE_FIELD', 'SURGERY', NULL, NULL, NULL FROM p WHERE intent = 'PATIENT_FACT' AND o_orderkey % 3 <> 0 AND o_orderstatus <> ''
            UNION ALL SELECT o_orderkey, 0, 3, 'CARE_EPISODE_FIELD', 'DISCHARGE_DATE', NULL, NULL, NULL FROM p WHERE intent = 'PATIENT_FACT'
            UNION ALL SELECT o_orderkey, 0, place, 'MEDICATION', l_partkey::VARCHAR, NULL, NULL, NULL FROM p JOIN l ON l_orderkey = o_orderkey WHERE intent = 'MEDICATION' AND l_linenumber % 2 = 1
            UNION ALL SELECT o_orderkey, 0, place, 'CARE_ADVICE', (l_orderkey * 10 + l_linenumber)::VARCHAR, NULL, NULL, NULL FROM p JOIN l ON l_orderkey = o_orderkey WHERE intent = 'LIFESTYLE'
            UNION ALL SELECT o_orderkey, 0, place, 'FOLLOW_UP_VISIT', l_suppkey::VARCHAR, NULL, NULL, NULL FROM p JOIN l ON l_orderkey = o_orderkey WHERE intent = 'FOLLOW_UP'
            UNION ALL SELECT o_orderkey, 1, place, 'PUBLIC', 'p-' || l_partkey, l_returnflag, l_linenumber, round(l_discount::DOUBLE + 0.5, 2) FROM p JOIN l ON l_orderkey = o_orderkey WHERE rag AND shown AND l_quantity > 25
        )
        SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY part, i)::INT AS citation_order, kind, reference, title AS source_title, page::INT AS source_page_number, score AS similarity_score, true AS sound FROM c""",
    "recovery_guide": _LINES + """
        SELECT o_orderkey, string_agg('M' || l_partkey || ' · 1 · 1일 ' || l_linenumber || '회 · ' || l_quantity::INT || '일', '|' ORDER BY place) AS medication_guide,
            string_agg('do ' || l_returnflag, '|' ORDER BY l_quantity::INT % 3, place) AS patient_instructions, CASE WHEN any_value(shown) THEN 'public' ELSE '' END AS public_information,
            CASE WHEN any_value(rag) THEN 'PATIENT_AND_RAG' ELSE 'PATIENT_ONLY' END AS lifestyle_guide,
            string_agg(concat_ws(' · ', strftime(l_shipdate, '%Y-%m-%d %H:%M'), CASE WHEN l_linenumber % 3 = 0 THEN 'dept' END, 'visit',
                CASE WHEN l_linenumber % 4 = 2 THEN 'place' WHEN l_linenumber <> 5 THEN 'clinic' END), '|' ORDER BY place) AS follow_up_schedule, 0 AS n_warnings
        FROM p JOIN l ON l_orderkey = o_orderkey GROUP BY o_orderkey""",
    "visit_aliases": """
        SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(' · ', CASE WHEN l_linenumber % 2 = 0 THEN strftime(l_shipdate, '%Y-%m-%d %H:%M') WHEN l_linenumber <> 3 THEN strftime(l_shipdate + INTERVAL 1 DAY, '%Y-%m-%d %H:%M') END, l_returnflag,
            CASE WHEN l_linenumber % 3 = 0 THEN 'check' WHEN l_linenumber <> 5 THEN 'older' END, CASE WHEN l_linenumber IN (3, 4) THEN 'room' WHEN l_linenumber <> 6 THEN 'clinic' END) AS line FROM lineitem""",
    "order_listing": """
        WITH p AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders)
        SELECT 50 AS "offset", count(*) AS n, (SELECT count(*) FROM orders) AS total, string_agg(o_orderkey::VARCHAR, ',' ORDER BY place) AS orders FROM p WHERE place BETWEEN 51 AND 100
        UNION ALL SELECT 49999950, 0, (SELECT count(*) FROM orders), ''""",
    "vec_pairs": """
        WITH b AS (SELECT vec_id // 10 AS batch, count(*) AS n, bool_or(vec_id % 130 = 5) AS cut FROM embeddings GROUP BY 1),
        e AS (SELECT *, CASE WHEN batch % 11 = 3 THEN 'NULL_LIST' WHEN batch % 7 = 0 THEN 'UNEQUAL_LENGTHS' WHEN cut THEN 'WRONG_SIZE' END AS error FROM b)
        SELECT batch, 'p' || vec_id AS point_id, 'chunk ' || vec_id AS chunk, 64 AS size, NULL AS error FROM embeddings JOIN e ON batch = vec_id // 10 WHERE error IS NULL
        UNION ALL SELECT batch, NULL, NULL, NULL, error FROM e WHERE error IS NOT NULL""",
    "ocr_violations": f"""
        WITH s AS (SELECT event_id AS id, ts, ['QUEUED', 'PROCESSING', 'READY_FOR_REVIEW', 'COMPLETE', 'FAILED', 'CANCELLED'][event_id % 6 + 1] AS status, event_id % 6 = 2 AS ready FROM events),
        j AS (
            SELECT id, status, ts AS created, CASE WHEN ready <> (id % 31 = 0) THEN 1 END AS result, CASE WHEN (id % 6 > 0) <> (id % 37 = 0) THEN {_AT("CASE WHEN id % 41 = 0 THEN -5 ELSE 1 END")} END AS started,
                CASE WHEN ready <> (id % 43 = 0) THEN {_AT("CASE WHEN id % 47 = 0 THEN 0 ELSE 2 END")} END AS ready_at, CASE WHEN ready <> (id % 53 = 0) THEN {_AT("CASE WHEN id % 59 = 0 THEN 2 ELSE 3 END")} END AS expires,
                CASE WHEN (id % 6 > 2) <> (id % 61 = 0) THEN {_AT("CASE WHEN id % 67 = 0 THEN -9 ELSE 4 END")} END AS completed,
                CASE WHEN id % 71 = 0 THEN 'OTHER' WHEN status = 'FAILED' THEN 'EXTRACTION_FAILED' WHEN status = 'CANCELLED' THEN 'USER_CANCELLED' END AS error FROM s
        )
        SELECT id, unnest(list_filter([
            CASE WHEN result IS NOT NULL AND status <> 'READY_FOR_REVIEW' THEN 'structured_status' END,
            CASE WHEN status = 'READY_FOR_REVIEW' AND (result IS NULL OR ready_at IS NULL OR expires IS NULL) THEN 'ready_payload' END,
            CASE WHEN CASE status WHEN 'FAILED' THEN error <> 'EXTRACTION_FAILED' WHEN 'CANCELLED' THEN error <> 'USER_CANCELLED' ELSE error IS NOT NULL END THEN 'error_code' END,
            CASE WHEN (status IN ('COMPLETE', 'FAILED', 'CANCELLED')) <> (completed IS NOT NULL) THEN 'completed_at' END,
            CASE WHEN (status = 'QUEUED' AND (started IS NOT NULL OR ready_at IS NOT NULL OR expires IS NOT NULL)) OR (status = 'PROCESSING' AND (started IS NULL OR ready_at IS NOT NULL OR expires IS NOT NULL))
                OR (status = 'READY_FOR_REVIEW' AND (started IS NULL OR ready_at IS NULL OR expires IS NULL)) THEN 'status_timestamps' END,
            CASE WHEN started < created THEN 'started_at' END, CASE WHEN ready_at IS NOT NULL AND (started IS NULL OR ready_at < started) THEN 'ready_at' END,
            CASE WHEN completed < coalesce(started, created) THEN 'completed_order' END, CASE WHEN expires <= ready_at THEN 'expires_at' END], lambda x: x IS NOT NULL)) AS "constraint" FROM j""",
    "key_violations": """
        WITH u AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 8 <> 0 THEN 'u' || floor(c_custkey / 2 * CASE WHEN c_custkey % 50 < 10 THEN 1 ELSE 2 END)::BIGINT END AS email FROM customer WHERE c_custkey % 10 <> 3),
        s AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 <> 0 THEN c_custkey END AS user_id, c_custkey % 1000 AS endpoint FROM customer),
        k AS (SELECT o_orderkey AS id, o_custkey, o_orderdate, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey + 1 END AS parent FROM orders)
        SELECT 'users' AS "table", id, 'UNIQUE' AS kind, 'email' AS "constraint" FROM u WHERE email IS NOT NULL QUALIFY count(*) OVER (PARTITION BY email) > 1
        UNION ALL (SELECT 'push_subscriptions', id, 'UNIQUE', 'endpoint' FROM s QUALIFY count(*) OVER (PARTITION BY endpoint) > 1)
        UNION ALL SELECT 'push_subscriptions', id, 'REFERENCE', 'user_id' FROM s WHERE user_id NOT IN (SELECT id FROM u)
        UNION ALL (SELECT 'background_jobs', id, 'UNIQUE', 'idempotency_key' FROM k QUALIFY count(*) OVER (PARTITION BY o_custkey, o_orderdate) > 1)
        UNION ALL SELECT 'background_jobs', id, 'REFERENCE', 'parent_job_id' FROM k WHERE parent NOT IN (SELECT id FROM k)""",
    "record_violations": "WITH e AS (SELECT event_id AS id, ts FROM events) " + " UNION ALL ".join((
        _broken("care_episodes", "CHECK", {"end_after_start": "id % 5 <> 0", "medication_days": "id % 2 <> 0 OR id % 400 BETWEEN 1 AND 365", "confirmation": "id % 4 <> 0 OR id % 12 = 0"}, "e"),
        _broken("care_advices", "CHECK", {"display_order": "id % 6 > 0"}, "e"),
        _broken("medications", "CHECK", {"times_per_day": "id % 3 = 0 OR id % 8 BETWEEN 1 AND 6", "days": "id % 5 = 0 OR id % 367 BETWEEN 1 AND 365", "as_needed_note": "id % 3 <> 0 OR id % 2 = 0"}, "e"),
        _broken("recovery_guides", "CHECK", {"safety_complete": "id % 9 <> 0", "superseded": "id % 10 <> 0", "context_hash": "id % 11 <> 0"}, "e"),
        _broken("classifications", "CHECK", {"route": "(id % 3 = 0) = (id % 4 = 0)", "query": "id % 4 = 0 OR (id % 2 = 0) = (id % 5 <> 0)", "reasons": "id % 12 <> 0"}, "e"),
        _broken("history", "CHECK", {"messages": "id % 12 < 10", "content": "id % 700 * 3 <= 2000"}, "e"),
    )),
}
