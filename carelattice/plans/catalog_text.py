"""Registered queries: cleaning, keys, formatting, chunks, identifiers and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import collections, identity, text
from ..operators import splitter
from ..sources.readers import table
from . import assembly

#: White space as DuckDB's patterns must list it.
SPACE = r"\x09-\x0D\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
SLOT_WORDS = {"morning": "SMALL|ECONOMY", "lunch": "MEDIUM|ECONOMY", "evening": "LARGE", "bedtime": "PROMO|LARGE"}


def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = text.clean_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(cleaned).alias("cleaned_md5"), F.char_length(cleaned).cast("long").alias("n_chars"))


def clean_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.clean_text(F.col("html"))).alias("cleaned_md5"))


def normalize_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", text.upper_key(F.concat(F.lit(" "), "role", F.lit("\n"))).alias("role_key"), F.md5(text.collapse_spaces(x)).alias("spaced"),
        F.md5(text.space_free_key(x)).alias("tight"), F.md5(text.punctuation_free_key(x)).alias("plain"),
    )


def medication_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = F.nullif(F.col("p_size") % 5, F.lit(0))
    m = F.struct(F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")).otherwise("").alias("dose"), times.alias("times_per_day"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("note"), F.nullif(F.col("p_size") % 7, F.lit(0)).alias("days"))
    parts = table(spark, sf_dir, "part").select("p_partkey", m.alias("m"))
    return parts.select("p_partkey", text.medication_line(F.col("m")).alias("line"), text.frequency_text(F.col("m.times_per_day"), F.col("m.note")).alias("frequency"))


def section_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as two titled lists, by role, with a closing notice."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    said = lambda role: F.transform(F.filter("turns", lambda t: t["role"] == role), lambda t: t["text"])
    body = text.document(text.section("asked", said("user")), text.section("answered", said("assistant")), F.lit("notice"))
    return turns.select("conv_id", F.md5(body).alias("body_md5"))


def slot_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    times = F.when(F.col("p_size") % 9 != 0, F.col("p_size") % 9)
    slots = text.default_slots(times, F.concat_ws(" ", "p_type", F.when(F.col("p_partkey") % 2 == 0, "MEDIUM")), SLOT_WORDS)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(slots, ",").alias("slots"), text.exceeds_slots(times).alias("exceeds"))


def chunk_recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = splitter.split_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return chunks.select("doc_id", "chunk_index", F.char_length("chunk").alias("n_chars"), F.md5("chunk").alias("chunk_md5"))


def search_query_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    topic = F.when(F.col("doc_id") % 2 == 0, "medication").otherwise(" lifestyle ")
    query = assembly.search_terms(F.col("lang"), topic, F.array("source", F.lit(" "), "source"), F.array(F.concat(F.lit("d"), F.col("doc_id").cast("string"))), {"LIFESTYLE": "daily life"})
    return docs.select("doc_id", query.alias("query"))


def context_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment")).alias("c_mktsegment"), "c_nationkey")
    row = F.struct(*customers.columns)
    kind = customers.select(row.alias("r")).schema["r"].dataType
    confirmed = F.when(F.col("c_custkey") % 10 == 0, F.lit("f" * 64)).otherwise("")
    return customers.select("c_custkey", identity.context_hash(row, kind, confirmed).alias("hash"))


def point_id_v5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", identity.uuid5(F.col("text")).alias("point_id"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k int")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum(parsed["k"]).alias("k"), F.count_if(parsed["k"].isNull()).alias("malformed"))


def map_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = F.create_map(F.lit("type"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string"))
    right = F.create_map(F.lit("user"), F.concat(F.lit("u"), F.col("user_id").cast("string")), F.lit("k"), F.get_json_object("props", "$.k"))
    merged = collections.flatten_map(collections.merge_maps(left, right))
    label = collections.lookup({"click": "pressed", "view": "seen"}, F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(merged, "|").alias("entries"), label.alias("label"))


def toggle_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = text.slots_of_timing(F.col("p_type"), SLOT_WORDS)
    toggled = collections.in_canonical_order(collections.toggle(named, F.lit("morning")), text.SLOTS)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(toggled, ",").alias("slots"))


QUERIES = {
    f.__name__: f
    for f in (
        clean_text, clean_html, normalize_keys, medication_line, section_assembly, slot_assign, chunk_recursive, search_query_build, context_hash,
        point_id_v5, json_props, map_merge, toggle_slots,
    )
}
_CLEAN = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\\r\\n|\\r', chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), "
    "'^[" + SPACE.replace("{", "{{").replace("}", "}}") + "]+|[" + SPACE.replace("{", "{{").replace("}", "}}") + "]+$', '', 'g')"
)
_SLOTS = "list_filter(['morning', 'lunch', 'evening', 'bedtime'], lambda s: (s = 'morning' AND regexp_matches({t}, 'SMALL|ECONOMY')) OR (s = 'lunch' AND regexp_matches({t}, 'MEDIUM|ECONOMY')) OR (s = 'evening' AND contains({t}, 'LARGE')) OR (s = 'bedtime' AND regexp_matches({t}, 'PROMO|LARGE')))"
_BULLETS = "string_agg(CASE WHEN role = '{role}' AND trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> '' THEN '- ' || trim(text, ' ' || chr(10) || chr(9) || chr(13)) END, chr(10) ORDER BY turn)"
SQL = {
    "clean_text": f"SELECT doc_id, md5(c) AS cleaned_md5, length(c) AS n_chars FROM (SELECT doc_id, {_CLEAN.format(x='text')} AS c FROM documents)",
    "clean_html": f"SELECT page_id, md5({_CLEAN.format(x='html')}) AS cleaned_md5 FROM pages",
    "normalize_keys": f"""SELECT conv_id, turn, upper(role) AS role_key, md5(regexp_replace(regexp_replace(text, '[{SPACE}]+', ' ', 'g'), '^ | $', '', 'g')) AS spaced,
        md5(lower(regexp_replace(text, '[{SPACE}]+', '', 'g'))) AS tight, md5(lower(regexp_replace(text, '[{SPACE}.,!?]', '', 'g'))) AS plain FROM conversations""",
    "medication_line": """
        WITH p AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 3 <> 0 THEN p_brand END AS dose, nullif(p_size % 5, 0) AS t, CASE WHEN p_size > 25 THEN p_type END AS note, nullif(p_size % 7, 0) AS days FROM part)
        SELECT p_partkey, concat_ws(' · ', p_name, dose, '1일 ' || t || '회', note, days || '일') AS line,
            CASE WHEN t IS NOT NULL THEN concat_ws(' · ', '1일 ' || t || '회', note) ELSE concat_ws(' · ', '필요 시', note) END AS frequency FROM p""",
    "section_assembly": f"""SELECT conv_id, md5(concat_ws(chr(10) || chr(10), 'asked' || chr(10) || {_BULLETS.format(role="user")}, 'answered' || chr(10) || {_BULLETS.format(role="assistant")}, 'notice')) AS body_md5
        FROM conversations GROUP BY conv_id""",
    "slot_assign": f"""
        WITH p AS (SELECT p_partkey, nullif(p_size % 9, 0) AS n, p_type || CASE WHEN p_partkey % 2 = 0 THEN ' MEDIUM' ELSE '' END AS t FROM part),
        s AS (SELECT *, {_SLOTS.format(t="t")} AS named FROM p)
        SELECT p_partkey, CASE WHEN n IS NULL THEN '' WHEN len(named) = n THEN array_to_string(named, ',') WHEN n = 1 THEN 'morning' WHEN n = 2 THEN 'morning,evening'
            WHEN n = 3 THEN 'morning,lunch,evening' ELSE 'morning,lunch,evening,bedtime' END AS slots, coalesce(n > 4, false) AS exceeds FROM s""",
    "search_query_build": """SELECT doc_id, upper(lang) || ' ' || source || CASE WHEN doc_id % 2 = 0 THEN ' d' || doc_id || ' MEDICATION' ELSE ' daily life' END AS query FROM documents""",
    "context_hash": """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN repeat('f', 64) ELSE sha256('{"c_custkey":' || c_custkey || ',"c_mktsegment":' ||
        CASE WHEN c_custkey % 4 <> 0 THEN '"' || c_mktsegment || '"' ELSE 'null' END || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}') END AS hash FROM customer""",
    "point_id_v5": """
        WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(text)) AS d FROM documents)
        SELECT doc_id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' ||
            substr('89ab', CAST(('0x' || substr(d, 17, 1)) AS INT) % 4 + 1, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS point_id FROM h""",
    "json_props": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS INT)) AS BIGINT) AS k, count(*) FILTER (WHERE json_extract(props, '$.k') IS NULL) AS malformed FROM events GROUP BY event_type",
    "map_merge": """SELECT event_id, 'k|' || json_extract_string(props, '$.k') || '|type|' || event_type || '|user|u' || user_id AS entries,
        CASE event_type WHEN 'click' THEN 'pressed' WHEN 'view' THEN 'seen' ELSE event_type END AS label FROM events""",
    "toggle_slots": f"""
        WITH s AS (SELECT p_partkey, {_SLOTS.format(t="p_type")} AS named FROM part)
        SELECT p_partkey, array_to_string(CASE WHEN list_contains(named, 'morning') THEN list_filter(named, lambda x: x <> 'morning') ELSE list_concat(['morning'], named) END, ',') AS slots FROM s""",
}
