"""Registered queries: listings, joins, counts and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import quality, relational
from ..sources import sinks
from ..sources.readers import table


def page_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    found = relational.page_with_total(orders, [F.desc("o_orderdate"), F.desc("o_orderkey")], number=3)
    return found.select("o_orderkey", "o_custkey", "total")


def optional_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = relational.where_given(table(spark, sf_dir, "orders"), o_orderstatus="O", o_orderpriority=["1-URGENT", "2-HIGH"], o_custkey=None)
    orders = relational.between_given(orders, "o_totalprice", 1000.0, 100000.0)
    orders = relational.in_values(orders, "o_custkey", list(range(0, 50)), keep=False)
    return orders.select("o_orderkey", "o_custkey", "o_totalprice")


def keyword_any_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return relational.any_column_contains(customers, "N_1", "n_name", "c_mktsegment").select("c_custkey", "n_name", "c_mktsegment")


def keyword_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.joined_columns_contain(table(spark, sf_dir, "customer"), " 7 Building ", "c_name", "c_mktsegment").select("c_custkey", "c_name")


def date_halfopen(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relational.on_days(table(spark, sf_dir, "events"), "ts", "2024-01-03", "2024-01-05")
    return found.select("event_id", "user_id", "event_type")


def owner_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = relational.owned_by(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), table(spark, sf_dir, "customer"), "c_custkey", F.col("c_nationkey") == 7)
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return lines.join(orders.select("o_orderkey"), "o_orderkey", "left_semi").select("o_orderkey", "l_linenumber", "l_partkey", "l_quantity")


def slot_semi_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    return relational.owned_by(table(spark, sf_dir, "part"), lines, "p_partkey", F.col("l_quantity") == 50).select("p_partkey", "p_name")


def left_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = relational.with_default(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id", {"quality": 0, "toxic": 1})
    return found.select("doc_id", "quality", "toxic")


def left_count_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return relational.with_count(table(spark, sf_dir, "customer").select("c_custkey"), orders, "c_custkey", "open_orders", F.col("o_orderstatus") == "O")


def _urgent(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return relational.fan_out(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), urgent, "c_custkey")


def fanout_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urgent(spark, sf_dir)[0]


def fanout_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _urgent(spark, sf_dir)[1]


def anti_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without an urgent order."""
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey")
    return relational.missing_ids(table(spark, sf_dir, "customer"), urgent, "c_custkey")


def nested_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    parts = (lines, ["l_linenumber", "l_partkey", "l_suppkey"], F.concat_ws(":", "l_linenumber", "l_partkey"))
    suppliers = (lines.select("o_orderkey", "l_suppkey").distinct(), ["l_suppkey"], F.col("l_suppkey").cast("string"))
    found = relational.assemble(orders, "o_orderkey", parts=parts, suppliers=suppliers)
    return found.select("o_orderkey", F.array_join("parts", ",").alias("parts"), F.array_join("suppliers", ",").alias("suppliers"))


def exists_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    poor = table(spark, sf_dir, "supplier").filter("s_acctbal < 1000").select(F.col("s_nationkey").alias("n_nationkey"), F.lit(True).alias("has_poor")).distinct()
    return relational.with_default(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), poor, "n_nationkey", {"has_poor": False})


def keeps_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.keeps_one(table(spark, sf_dir, "supplier"), (F.col("s_nationkey") == 3) & (F.col("s_acctbal") > 0))


def dup_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.duplicates(table(spark, sf_dir, "documents").select(F.md5("text").alias("text_md5")), "text_md5")


def chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("line").alias("distinct_lines"))


def group_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(relational.ordered_list(["turn"], F.col("role")).alias("roles"))
    return turns.select("conv_id", F.array_join("roles", ",").alias("roles"))


def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Constraints of the catalogue's kinds over orders and events."""
    orders = table(spark, sf_dir, "orders")
    rules = {
        "price_range": F.col("o_totalprice").between(1000.0, 450000.0),
        "status_priority": (F.col("o_orderstatus") == "F") | (F.col("o_orderpriority") != "1-URGENT"),
        "date_order": F.col("o_orderdate") >= F.to_timestamp_ntz(F.lit("1995-06-01 00:00:00")),
        "key_text": F.col("o_orderpriority").rlike("^[0-9]-"),
    }
    return quality.violations(orders, rules, "o_orderkey")


def migration_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return quality.all_absent(part, long_name=F.char_length("p_name") > 12, no_brand=F.col("p_brand").isNull(), too_large=F.col("p_size") > 50, cheap=F.col("p_retailprice") < 901)


def backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 3 != 0, F.lit(-1)).cast("int").alias("c_nationkey"))
    return quality.backfill(orders, table(spark, sf_dir, "customer"), "c_custkey", "c_nationkey").select("o_orderkey", "c_nationkey")


def ts_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.to_date("ts").cast("string").alias("day"), dates.time_of_day(F.col("ts")).alias("time"))


def ts_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    clock = F.when(F.col("event_id") % 4 != 0, F.date_format("ts", "HH:mm:ss"))
    return table(spark, sf_dir, "events").select("event_id", F.date_format(dates.join_day_and_time(F.to_date("ts"), clock), "yyyy-MM-dd HH:mm:ss").alias("at"))


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoted = table(spark, sf_dir, "conversations").withColumn("role", F.concat(F.lit('"'), "role", F.lit('"')))
    return sinks.csv_lines(quoted, "conv_id", "turn", "role", "text")


def partial_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    changes = customers.filter("c_custkey % 5 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.lit("NEW")).alias("c_mktsegment"), F.lit(None).cast("int").alias("c_nationkey"))
    return sinks.partial_update(customers, changes, "c_custkey")


def upsert_owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "customer").select(F.col("c_name").alias("endpoint"), F.col("c_nationkey").alias("user_id"), (F.col("c_acctbal") > 0).alias("is_active"))
    changes = table(spark, sf_dir, "supplier").select(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("endpoint"), F.col("s_nationkey").alias("user_id"))
    kept, refused = sinks.upsert_owned(base, changes, "endpoint", "user_id")
    return kept.withColumn("refused", F.lit(False)).unionByName(refused.withColumn("is_active", F.lit(None).cast("boolean")).withColumn("refused", F.lit(True)))


def format_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phone numbers and passwords made from order keys."""
    orders = table(spark, sf_dir, "orders")
    phone = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "+8210").otherwise("010"), F.lpad(F.col("o_orderkey").cast("string"), 8, "0"))
    lacks = text.missing_password_classes(F.concat("o_orderpriority", F.col("o_orderkey").cast("string")))
    return orders.select("o_orderkey", text.normalize_phone(phone).alias("phone"), text.is_phone(F.substring(phone, 1, 12)).alias("ok_short"), F.array_join(lacks, ",").alias("lacks"))


QUERIES = {
    f.__name__: f
    for f in (
        page_stable, optional_filters, keyword_any_column, keyword_concat, date_halfopen, owner_semi, slot_semi_distinct, left_default, left_count_zero,
        fanout_inner, fanout_missing, anti_ids, nested_assembly, exists_flag, keeps_one, dup_detect, chunk_totals, group_ids, constraint_violations,
        migration_guards, backfill, ts_split, ts_join, csv_lines, partial_update, upsert_owned, format_checks,
    )
}
SQL = {
    "page_stable": "SELECT o_orderkey, o_custkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40",
    "optional_filters": """SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
        AND o_totalprice BETWEEN 1000 AND 100000 AND o_custkey NOT BETWEEN 0 AND 49""",
    "keyword_any_column": """SELECT c_custkey, n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey
        WHERE contains(lower(strip_accents(n_name)), 'n_1') OR contains(lower(strip_accents(c_mktsegment)), 'n_1')""",
    "keyword_concat": "SELECT c_custkey, c_name FROM customer WHERE contains(lower(concat_ws(' ', c_name, c_mktsegment)), '7 building')",
    "date_halfopen": "SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-06'",
    "owner_semi": """SELECT l_orderkey AS o_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
        WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 7))""",
    "slot_semi_distinct": "SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity = 50)",
    "left_default": "SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 1) AS toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "left_count_zero": "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O') AS open_orders FROM customer",
    "fanout_inner": "SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'",
    "fanout_missing": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "anti_ids": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "nested_assembly": """SELECT o_orderkey, p.parts, s.suppliers FROM orders
        LEFT JOIN (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts FROM lineitem GROUP BY l_orderkey) p ON p.l_orderkey = o_orderkey
        LEFT JOIN (SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_suppkey) AS suppliers FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) GROUP BY l_orderkey) s ON s.l_orderkey = o_orderkey""",
    "exists_flag": "SELECT n_nationkey, n_name, EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal < 1000) AS has_poor FROM nation",
    "keeps_one": "SELECT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = 3 AND s_acctbal > 0) AS holds",
    "dup_detect": "SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
    "chunk_totals": "SELECT doc_id, count(*) AS lines, count(DISTINCT line) AS distinct_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id",
    "group_ids": "SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id",
    "constraint_violations": """
        SELECT o_orderkey, 'price_range' AS "constraint" FROM orders WHERE NOT o_totalprice BETWEEN 1000 AND 450000
        UNION ALL SELECT o_orderkey, 'status_priority' FROM orders WHERE NOT (o_orderstatus = 'F' OR o_orderpriority <> '1-URGENT')
        UNION ALL SELECT o_orderkey, 'date_order' FROM orders WHERE o_orderdate < TIMESTAMP '1995-06-01'
        UNION ALL SELECT o_orderkey, 'key_text' FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[0-9]-')""",
    "migration_guards": """SELECT NOT EXISTS (SELECT 1 FROM part WHERE length(p_name) > 12) AS long_name, NOT EXISTS (SELECT 1 FROM part WHERE p_brand IS NULL) AS no_brand,
        NOT EXISTS (SELECT 1 FROM part WHERE p_size > 50) AS too_large, NOT EXISTS (SELECT 1 FROM part WHERE p_retailprice < 901) AS cheap""",
    "backfill": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN -1 ELSE c_nationkey END AS c_nationkey FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "ts_split": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M:%S.%f') AS time FROM events",
    "ts_join": "SELECT event_id, CASE WHEN event_id % 4 <> 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') ELSE strftime(ts, '%Y-%m-%d') || ' 00:00:00' END AS at FROM events",
    "csv_lines": "SELECT conv_id || ',' || turn || ',\"\"\"' || role || '\"\"\",' || CASE WHEN regexp_matches(text, '[\",\\r\\n]') THEN '\"' || replace(text, '\"', '\"\"') || '\"' ELSE text END AS value FROM conversations",
    "partial_update": "SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, c_nationkey FROM customer",
    "upsert_owned": """
        WITH c AS (SELECT replace(s_name, 'Supplier', 'Customer') AS endpoint, s_nationkey AS user_id FROM supplier),
        k AS (SELECT c.*, c_nationkey IS NOT NULL AND c_nationkey <> user_id AS taken FROM c LEFT JOIN customer ON c_name = endpoint)
        SELECT endpoint, user_id, CASE WHEN taken THEN NULL ELSE true END AS is_active, taken AS refused FROM k
        UNION ALL SELECT c_name, c_nationkey, c_acctbal > 0, false FROM customer WHERE c_name NOT IN (SELECT endpoint FROM k WHERE NOT taken)""",
    "format_checks": """
        WITH p AS (SELECT *, lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS d, o_orderpriority || CAST(o_orderkey AS VARCHAR) AS w FROM orders)
        SELECT o_orderkey, '010' || d AS phone, o_orderkey % 3 <> 0 AND length(d) = 8 AS ok_short,
            concat_ws(',', CASE WHEN length(w) < 8 THEN 'short' END, CASE WHEN NOT regexp_matches(w, '[A-Z]') THEN 'upper' END, CASE WHEN NOT regexp_matches(w, '[a-z]') THEN 'lower' END,
                CASE WHEN NOT regexp_matches(w, '[0-9]') THEN 'digit' END, CASE WHEN NOT regexp_matches(w, '[^a-zA-Z0-9]') THEN 'special' END) AS lacks FROM p""",
}
