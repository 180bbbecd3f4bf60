"""Registered queries: risk rules, guards, routing, conflicts and citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import collections
from ..operators import relational
from ..sources.readers import table
from . import assembly, rules

#: A pack for the tables' languages, in patterns that Java and RE2 read alike; the domain's own is rules.INPUT_RISKS.
NEUTRAL = (
    rules.Rule("ENGLISH", (r"(?:^|[ \n])the[ \n]", r"(?:^|[ \n])with[ \n]")),
    rules.Rule("FRENCH", (r"(?:^|[ \n])(?:que|dans) [^\n]{0,20}l[ea][ \n]",)),
    rules.Rule("GERMAN", (r"(?:^|[ \n])(?:und|nicht)[ \n]",)),
    rules.Rule("LONG_LINE", (r"[^\n]{200}",)),
)


def _sql_codes(pack: tuple[rules.Rule, ...]) -> str:
    cases = (f"CASE WHEN {' OR '.join(f"regexp_matches(text, '{p}')" for p in rule.patterns)} THEN '{rule.code}' END" for rule in pack)
    return f"list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL)"


_SQL_CODES = _sql_codes(NEUTRAL)


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def risk_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    risk = rules.assess_risk(F.col("text"), NEUTRAL)
    level = relational.higher(risk["level"], F.when(F.col("role") == "system", "CAUTION").otherwise(F.lit("LOW")), rules.RISK_LEVELS)
    return _turns(spark, sf_dir).select("conv_id", "turn", level.alias("level"), F.array_join(risk["codes"], ",").alias("codes"))


#: What turns are made to ask, and the codes that each wording must give.
ASKED = (
    ("", ""), ("약을 끊어도 되나요?", "MEDICATION_CHANGE_REQUEST"), ("아스피린 용량을 줄여도 되나요", "MEDICATION_CHANGE_REQUEST"), ("무슨 병인가요?", "DIAGNOSIS_REQUEST"), ("진단해 주세요", "DIAGNOSIS_REQUEST"),
    ("수술을 받아야 하나요", "TREATMENT_DECISION_REQUEST"), ("입원 치료를 결정", "TREATMENT_DECISION_REQUEST"), ("가슴이 너무 아프고 숨 쉬기 힘들어요", "EMERGENCY_SYMPTOM"), ("갑자기 말이 안 나와요", "EMERGENCY_SYMPTOM"),
    ("약을 끊고 수술을 받아야 하나요", "MEDICATION_CHANGE_REQUEST,TREATMENT_DECISION_REQUEST"), ("운동을 해도 되나요", ""),
)
#: What turns are made to answer, and the code that each wording must give.
ANSWERED = (
    ("물을 드세요.", None), ("@ 끊으세요.", "MEDICATION_CHANGE_INSTRUCTION"), ("약을 중단하셔도 됩니다.", "MEDICATION_CHANGE_INSTRUCTION"), ("@ 좋습니다. 내일부터 건너뛰세요.", "MEDICATION_CHANGE_INSTRUCTION"),
    ("복용량을 늘려야 합니다.", "MEDICATION_CHANGE_INSTRUCTION"), ("운동을 바꾸세요.", None), ("뇌졸중으로 판단됩니다.", "DIAGNOSTIC_ASSERTION"), ("질환의 가능성이 높습니다", "DIAGNOSTIC_ASSERTION"), ("입원 치료가 필요합니다.", "TREATMENT_DECISION"),
)


def _spoken(wordings, shift: int = 1):
    """One of the wordings for each turn."""
    return F.element_at(F.array(*(F.lit(w) for w, _ in wordings)), ((F.col("conv_id") + F.col("turn") * shift) % len(wordings) + 1).cast("int"))


def _sql_expected(wordings, shift: int = 1) -> str:
    return f"[{', '.join('NULL' if code is None else f"'{code}'" for _, code in wordings)}][(conv_id + turn * {shift}) % {len(wordings)} + 1]"


def risk_of_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain's own pack over all turns, each of which asks something that meets a pattern, or none."""
    risk = rules.assess_risk(F.concat(F.col("text"), F.lit("\n"), _spoken(ASKED)))
    return _turns(spark, sf_dir).select("conv_id", "turn", risk["level"].alias("level"), F.array_join(risk["codes"], ",").alias("codes"))


def output_guard_first_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    code = rules.first_code([(rule.matches(x), rule.code) for rule in NEUTRAL[::-1]] + [(~F.contains(x, F.lit("de")), "NO_NOTICE")])
    return _turns(spark, sf_dir).filter("role = 'assistant'").select("conv_id", "turn", code.alias("code"), F.when(code.isNull(), "SAFE").when(code == "NO_NOTICE", "RESTRICTED").otherwise("BLOCKED").alias("status"))


def output_guard_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The domain's guard over answers that break each rule, with a medication name of each conversation's own as a column pattern; some lack the notice."""
    name = F.concat(F.lit("med"), F.col("conv_id").cast("string"))
    meds = F.array(F.struct(name.alias("name"), F.lit(None).cast("string").alias("dose"), F.lit(None).cast("int").alias("times_per_day"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("int").alias("days")))
    says = F.concat(F.col("text"), F.lit("\n"), F.replace(_spoken(ANSWERED, 2), F.lit("@"), name), F.when(F.col("turn") % 3 != 0, "\n의사 진료를 대체하지 않습니다").otherwise(""))
    found = rules.guard_answer(says, F.lit("GENERAL"), meds)
    return _turns(spark, sf_dir).select("conv_id", "turn", found["status"].alias("status"), found["code"].alias("code"))


def output_guard_collect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all turns of a conversation, by first appearance."""
    turns = _turns(spark, sf_dir).select("conv_id", "turn", rules.reason_codes(F.col("text"), NEUTRAL).alias("codes"))
    lists = turns.groupBy("conv_id").agg(relational.ordered_list(["turn"], F.col("codes")).alias("codes"))
    return lists.select("conv_id", F.array_join(F.array_distinct(F.flatten("codes")), ",").alias("codes"))


def conflict_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers as chunks and all suppliers as instructions of 250 episodes; the cases are made so that each status occurs."""
    customer, supplier = F.col("c_custkey"), F.col("s_suppkey")
    own = F.element_at(F.array(*map(F.lit, ["BUILDING", "MACHINERY", "FURNITURE"])), (supplier % 3 + 1).cast("int"))
    topics = table(spark, sf_dir, "supplier").groupBy((supplier % 250).alias("episode")).agg(F.collect_set(own).alias("topics"))
    episode = customer % 200
    topic = F.when((episode % 4 == 1) & (customer % 3 == 0), " ").when(episode % 4 == 2, F.element_at(F.array(*map(F.lit, ["building ", " machinery", "Furniture"])), (episode % 3 + 1).cast("int"))).otherwise(F.concat(F.lit(" "), F.lower("c_mktsegment")))
    chunks = table(spark, sf_dir, "customer").select(episode.alias("episode"), topic.alias("topic"))
    episodes = topics.select("episode").unionByName(chunks.select("episode")).distinct()
    both = episodes.join(topics, "episode", "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<string>")))
    marked = chunks.join(both, "episode").select("episode", F.col("topic").isNotNull().alias("c"), (F.trim("topic") == "").alias("missing"), rules.is_excluded(F.col("topic"), F.col("topics")).alias("excluded"))
    counts = marked.groupBy("episode").agg(F.count("c").alias("chunks"), F.count_if("missing").alias("missing"), F.count_if("excluded").alias("excluded"))
    found = both.join(counts, "episode", "left").fillna(0, ["chunks", "missing", "excluded"])
    return found.select("episode", "chunks", "excluded", rules.conflict_status(F.col("chunks"), F.size("topics"), F.col("missing"), F.col("excluded")).alias("status"))


def route(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn, role = F.col("turn"), F.col("role")
    named = rules.route(turn % 5 == 4, F.when(role == "user", "PATIENT_AND_RAG").when(role == "assistant", "PATIENT_ONLY"), turn % 7 == 6)
    search = assembly.chat_search(named, F.when(turn % 2 == 0, F.col("role")), F.when(turn % 3 == 0, "MEDICATION").otherwise("GENERAL"), F.lit(" stroke"), F.lit("post"))
    return _turns(spark, sf_dir).select("conv_id", "turn", named.alias("route"), search["query"].alias("query"), search["condition"].alias("condition"), search["topic"].alias("topic"))


def finish_guides(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("turn") % 4 == 0, "PENDING").when(F.col("turn") % 4 == 1, "BLOCKED").otherwise("SAFE")
    conflict = F.when(F.col("role") == "user", "REVIEW_REQUIRED").otherwise("NO_CONFLICT")
    done = rules.finish_guide(status, F.array(F.col("role")), conflict)
    return _turns(spark, sf_dir).select("conv_id", "turn", done["status"].alias("status"), F.array_join(done["codes"], ",").alias("codes"))


def sources_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of each order: its fields, then its lines, numbered from 1."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(relational.ordered_list(["l_linenumber", "l_partkey", "l_suppkey"], F.col("l_partkey").cast("string")).alias("parts"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").join(lines, "o_orderkey", "left")
    cite = lambda kind, ref: F.struct(F.lit(kind).alias("kind"), ref.alias("ref"))
    none = F.array().cast("array<string>")
    fields = F.array_compact(F.array(F.when(F.col("o_orderpriority") != "5-LOW", cite("FIELD", F.col("o_orderpriority")))))
    return assembly.numbered(orders, F.concat(fields, F.transform(F.coalesce("parts", none), lambda p: cite("LINE", p))), "o_orderkey")


def codes_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = collections.union_in_order(F.array("role"), rules.reason_codes(F.col("text"), NEUTRAL), F.array(F.lit("GERMAN")))
    return _turns(spark, sf_dir).select("conv_id", "turn", F.array_join(codes, ",").alias("codes"))


QUERIES = {
    f.__name__: f
    for f in (risk_classify, risk_of_questions, output_guard_first_hit, output_guard_answers, output_guard_collect_all, conflict_resolve, route, finish_guides, sources_ordinal, codes_union)
}
SQL = {
    "risk_classify": f"""SELECT conv_id, turn, CASE WHEN len(c) > 0 THEN 'HIGH' WHEN role = 'system' THEN 'CAUTION' ELSE 'LOW' END AS level, array_to_string(c, ',') AS codes
        FROM (SELECT *, {_SQL_CODES} AS c FROM conversations)""",
    "risk_of_questions": f"SELECT conv_id, turn, CASE WHEN codes = '' THEN 'LOW' ELSE 'HIGH' END AS level, codes FROM (SELECT *, {_sql_expected(ASKED)} AS codes FROM conversations)",
    "output_guard_first_hit": f"""SELECT conv_id, turn, code, CASE WHEN code IS NULL THEN 'SAFE' WHEN code = 'NO_NOTICE' THEN 'RESTRICTED' ELSE 'BLOCKED' END AS status FROM (
        SELECT conv_id, turn, CASE WHEN len(c) > 0 THEN c[-1] WHEN NOT contains(text, 'de') THEN 'NO_NOTICE' END AS code FROM (SELECT *, {_SQL_CODES} AS c FROM conversations WHERE role = 'assistant'))""",
    "output_guard_answers": f"""
        WITH c AS (SELECT *, coalesce({_sql_expected(ANSWERED, 2)}, CASE WHEN turn % 3 = 0 THEN 'MISSING_MEDICAL_DISCLAIMER' END) AS code FROM conversations)
        SELECT conv_id, turn, CASE WHEN code IS NULL THEN 'SAFE' WHEN code = 'MISSING_MEDICAL_DISCLAIMER' THEN 'RESTRICTED' ELSE 'BLOCKED' END AS status, code FROM c""",
    "output_guard_collect_all": f"""
        WITH t AS (SELECT conv_id, turn, unnest({_SQL_CODES}) AS code, generate_subscripts({_SQL_CODES}, 1) AS place FROM conversations),
        f AS (SELECT conv_id, code, min(turn * 10 + place) AS place FROM t GROUP BY conv_id, code)
        SELECT c.conv_id, coalesce(string_agg(code, ',' ORDER BY place), '') AS codes FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN f USING (conv_id) GROUP BY c.conv_id""",
    "conflict_resolve": """
        WITH t AS (SELECT s_suppkey % 250 AS k, list(DISTINCT CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'FURNITURE' END) AS topics FROM supplier GROUP BY 1),
        c AS (
            SELECT c_custkey % 200 AS k, CASE WHEN (c_custkey % 200) % 4 = 1 AND c_custkey % 3 = 0 THEN NULL WHEN (c_custkey % 200) % 4 = 2 THEN ['BUILDING', 'MACHINERY', 'FURNITURE'][(c_custkey % 200) % 3 + 1] ELSE c_mktsegment END AS topic FROM customer
        ), n AS (SELECT k AS episode, coalesce(topics, []) AS topics FROM (SELECT k FROM t UNION SELECT k FROM c) LEFT JOIN t USING (k)),
        a AS (SELECT episode, any_value(len(topics)) AS topics, count(c.k) AS chunks, count(c.k) FILTER (WHERE topic IS NULL) AS missing,
            count(c.k) FILTER (WHERE topic IS NULL OR list_contains(topics, topic)) AS excluded FROM n LEFT JOIN c ON c.k = episode GROUP BY episode)
        SELECT episode, chunks, excluded, CASE WHEN chunks = 0 THEN 'NOT_APPLICABLE' WHEN topics = 0 THEN 'NO_CONFLICT' WHEN missing > 0 THEN 'REVIEW_REQUIRED' WHEN excluded = 0 THEN 'NO_CONFLICT'
            WHEN excluded = chunks THEN 'PUBLIC_SOURCE_EXCLUDED' ELSE 'PATIENT_DATA_PRIORITY' END AS status FROM a""",
    "route": """
        WITH r AS (SELECT *, CASE WHEN turn % 5 = 4 THEN 'CLARIFICATION' WHEN turn % 7 = 6 THEN 'RESTRICTED' WHEN role = 'user' THEN 'PATIENT_AND_RAG' WHEN role = 'assistant' THEN 'PATIENT_ONLY' ELSE 'RESTRICTED' END AS route FROM conversations),
        s AS (SELECT *, route = 'PATIENT_AND_RAG' AND turn % 2 = 0 AS asks FROM r)
        SELECT conv_id, turn, route, CASE WHEN asks THEN role END AS query, CASE WHEN asks THEN 'STROKE' END AS condition, CASE WHEN asks AND turn % 3 = 0 THEN 'MEDICATION' END AS topic FROM s""",
    "finish_guides": """SELECT conv_id, turn, CASE WHEN turn % 4 = 1 THEN 'BLOCKED' WHEN role = 'user' THEN 'RESTRICTED' WHEN turn % 4 = 0 THEN 'VALIDATION_FAILED' ELSE 'SAFE' END AS status,
        role || CASE WHEN turn % 4 = 1 THEN '' WHEN role = 'user' THEN ',GUIDELINE_REVIEW_REQUIRED' WHEN turn % 4 = 0 THEN ',SAFETY_VALIDATION_INCOMPLETE' ELSE '' END AS codes FROM conversations""",
    "sources_ordinal": """
        WITH c AS (SELECT o_orderkey, 0 AS a, 0 AS b, 0 AS p, 'FIELD' AS kind, o_orderpriority AS ref FROM orders WHERE o_orderpriority <> '5-LOW'
            UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'LINE', CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders))
        SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY kind, a, b, p) AS INT) AS citation_order, kind, ref FROM c""",
    "codes_union": f"SELECT conv_id, turn, role || CASE WHEN len(c) > 0 THEN ',' || array_to_string(c, ',') ELSE '' END || CASE WHEN list_contains(c, 'GERMAN') THEN '' ELSE ',GERMAN' END AS codes FROM (SELECT *, {_SQL_CODES} AS c FROM conversations)",
}
