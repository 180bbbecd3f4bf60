"""Registered queries: vector search and the vector table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from ..sources.readers import table

#: The vector that is searched for, the label that filters, and thresholds that fit the tables' similarities.
ASKED, LABEL, LOW, RELAX = 0, 3, 0.05, 0.25


def vec_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings")
    asked = points.filter(F.col("vec_id") == ASKED).first()
    found = search.top_k(search.payload_filter(points, label=LABEL), asked.embedding, 5, LOW, "vec_id", "embedding")
    return found.select("vec_id", F.round("score", 4).alias("score"))


def vec_threshold_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings")
    asked = points.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), ((F.col("label") + 1) % 10).alias("label"))
    found = search.relaxed_top_k(asked, points, "label", 5, RELAX, "query_id", "vec_id", "query_vector", "embedding")
    return found.select("query_id", "vec_id", F.round("score", 4).alias("score"), "rank", "strict")


def vec_dim_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.size_report(table(spark, sf_dir, "embeddings"), 64, "embedding")


def vec_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    old = points.withColumn("version", F.lit(1))
    new = points.filter("vec_id % 7 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(2).alias("version"))
    return search.delete_where(search.upsert(old, new, "vec_id", "version"), F.col("label") == 5)


QUERIES = {f.__name__: f for f in (vec_topk, vec_threshold_fallback, vec_dim_check, vec_upsert_latest)}
SQL = {
    "vec_topk": f"""
        SELECT vec_id, round(score, 4) AS score FROM (
            SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = {ASKED})) AS score
            FROM embeddings WHERE label = {LABEL}
        ) WHERE score >= {LOW} ORDER BY score DESC, vec_id LIMIT 5""",
    "vec_threshold_fallback": f"""
        WITH s AS (
            SELECT q.vec_id AS query_id, p.vec_id, p.label = (q.label + 1) % 10 AS strict,
                list_cosine_similarity(CAST(p.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score
            FROM embeddings q JOIN embeddings p ON q.vec_id % 100 = 0
        ), t AS (SELECT *, max(CAST(strict AS INT)) OVER (PARTITION BY query_id) AS any_strict FROM s WHERE score >= {RELAX}),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM t WHERE strict OR any_strict = 0)
        SELECT query_id, vec_id, round(score, 4) AS score, CAST(rank AS INT) AS rank, any_strict = 1 AS strict FROM r WHERE rank <= 5""",
    "vec_dim_check": "SELECT count(*) AS vectors, count(*) FILTER (WHERE len(embedding) <> 64 OR embedding IS NULL) AS wrong_size FROM embeddings",
    "vec_upsert_latest": """
        SELECT vec_id, label, version FROM (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN label + 100 ELSE label END AS label, CASE WHEN vec_id % 7 = 0 THEN 2 ELSE 1 END AS version FROM embeddings
        ) WHERE label <> 5""",
}
