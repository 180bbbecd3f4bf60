"""The registered queries over the driver's tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(_table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), k=4, percent=85)


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import fair_schedule

    return fair_schedule(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op1_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pivot_topk import pivot_topk

    return pivot_topk(_table(spark, sf_dir, "embeddings"), k=5, every=50)


def op5_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .sstable import encode_to_shards

    return encode_to_shards(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


def op6_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passage_dedup import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe_fold import encode_and_decode

    return encode_and_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import dataset_manifest

    return dataset_manifest(_table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_pivot_topk, op2_toxicity, op3_exact_dedup, op4_jaccard_join, op5_sstable, op6_passage_dedup, op7_bpe, op8_language_id, op9_mixing, op10_token_counts,
        op11_quality_rules, op12_merkle_manifest, op13_whitening,
    )
}
#: Queries that DuckDB's SQL expresses over whole tables in fair time; the others are tested against brute force in tests/llm.
SQL: dict[str, str] = {
    "op1_pivot_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), r AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op3_exact_dedup": """
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS c, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256 FROM documents
        ), g AS (
            SELECT *, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY c DESC, doc_id) AS keep_id FROM t
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
    "op4_jaccard_join": """
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), s AS (
            SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS s FROM w
        ), u AS (SELECT doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS d FROM s),
        e AS (SELECT doc_id, unnest(s) AS g FROM s),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN u x ON x.doc_id = a JOIN u y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
        twoway AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(doc_id, m) AS (SELECT doc_id, doc_id FROM u UNION SELECT twoway.b, r.m FROM r JOIN twoway ON twoway.a = r.doc_id WHERE r.m < twoway.b),
        c AS (SELECT doc_id, min(m) AS component_id FROM r GROUP BY doc_id)
        SELECT doc_id, n AS n_shingles, component_id, CASE WHEN n = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY d) END AS class_id FROM u JOIN c USING (doc_id)""",
    "op11_quality_rules": """
        WITH w AS (
            SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents
        ), words AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w
        ), threes AS (SELECT r, i, x, lead(x) OVER (PARTITION BY r ORDER BY i) AS y, lead(x, 2) OVER (PARTITION BY r ORDER BY i) AS z FROM words
        ), windows AS (SELECT r, i, count(*) OVER (PARTITION BY r, x, y, z) AS f FROM threes WHERE z IS NOT NULL
        ), repeats AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE f > 1) GROUP BY r
        ), m AS (
            SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
                len(list_filter(w, lambda x: regexp_matches(x, '\\pL'))) AS n_alpha_words,
                len(list_filter(w, lambda x: regexp_matches(x, '[A-Z]') AND NOT regexp_matches(x, '\\p{Ll}'))) AS n_upper_words,
                len(list_filter(lines, lambda l: regexp_matches(l, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS n_ellipsis_lines
            FROM w LEFT JOIN repeats USING (r)
        ), f AS (
            SELECT *, (n_words < 50)::INT AS b0, (100 * n_repeat_words > 50 * n_words)::INT AS b1, (10 * n_symbols > n_words)::INT AS b2, (10 * n_dup_lines > 4 * n_lines)::INT AS b3,
                (10 * n_alpha_words < 6 * n_words)::INT AS b4, (2 * n_upper_words > n_words)::INT AS b5, (word_chars < 2 * n_words)::INT AS b6, (word_chars > 20 * n_words)::INT AS b7,
                (10 * n_ellipsis_lines > 3 * n_lines)::INT AS b8 FROM m
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_alpha_words, n_upper_words, n_ellipsis_lines,
            (b0 + 2 * b1 + 4 * b2 + 8 * b3 + 16 * b4 + 32 * b5 + 64 * b6 + 128 * b7 + 256 * b8)::BIGINT AS fail_bits, b0 + b1 > 0 AS base_failed,
            b0 + b1 + b2 + b3 + b4 + b5 = 0 AND b6 + b7 + b8 < 2 AS kept, 'corpus:2' AS policy FROM f""",
    "op12_merkle_manifest": """
        WITH RECURSIVE d AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(':' || lang, '') AS t, text, concat_ws('', coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-'), coalesce(strlen(source::VARCHAR) || ':' || source::VARCHAR, '-'), coalesce(strlen(lang::VARCHAR) || ':' || lang::VARCHAR, '-'), coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-')) AS head,
                xor(list_reduce(list_prepend(4294967295::BIGINT, range(8 * strlen(doc_id::VARCHAR))), lambda c, i: xor(
                    (CASE WHEN i % 8 = 0 THEN xor(c, ascii((doc_id::VARCHAR)[1 + i // 8])) ELSE c END) >> 1,
                    CASE WHEN (CASE WHEN i % 8 = 0 THEN xor(c, ascii((doc_id::VARCHAR)[1 + i // 8])) ELSE c END) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) AS crc FROM documents
        ), e AS (
            SELECT r, doc_id, t, sha256(head || coalesce(strlen(text::VARCHAR) || ':' || text::VARCHAR, '-')) AS leaf,
                sha256(head || CASE WHEN crc % 3 = 0 THEN coalesce(strlen(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')::VARCHAR) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')::VARCHAR, '-') ELSE coalesce(strlen(text::VARCHAR) || ':' || text::VARCHAR, '-') END) AS claimed FROM d
        ), p AS (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS pos FROM e),
        n(t, l, pos, h, c) AS (
            SELECT t, 0, pos, leaf, count(*) OVER (PARTITION BY t) FROM p
            UNION ALL SELECT t, l + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), any_value((c + 7) // 8) FROM n WHERE c > 1 GROUP BY t, l, pos // 8
        ), s AS (SELECT t, l, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM n WHERE c > 1 WINDOW w AS (PARTITION BY t, l, pos // 8 ORDER BY pos)), f(r, t, l, pos, h, proof) AS (
            SELECT r, t, 0, pos, claimed, '' FROM p UNION ALL SELECT r, t, l + 1, pos // 8, sha256(a || h || b), proof || a || b FROM f JOIN s USING (t, l, pos)
        ), low AS (SELECT r, t, arg_max(h, l) AS h, arg_max(proof, l) AS proof FROM f GROUP BY r, t),
        subroots AS (SELECT t, arg_max(h, l) AS subroot, row_number() OVER (ORDER BY t) - 1 AS pos FROM n GROUP BY t),
        top(t, l, pos, h, c) AS (
            SELECT '', 0, pos, subroot, count(*) OVER () FROM subroots
            UNION ALL SELECT t, l + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), any_value((c + 7) // 8) FROM top WHERE c > 1 GROUP BY t, l, pos // 8
        ), ts AS (SELECT l, pos, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM top WHERE c > 1 WINDOW w AS (PARTITION BY t, l, pos // 8 ORDER BY pos)), g(r, l, pos, h, proof) AS (
            SELECT r, 0, pos, h, proof FROM low JOIN subroots USING (t) UNION ALL SELECT r, l + 1, pos // 8, sha256(a || h || b), proof || a || b FROM g JOIN ts USING (l, pos)
        ), high AS (SELECT r, arg_max(h, l) AS folded_root, arg_max(proof, l) AS proof FROM g GROUP BY r),
        root AS (SELECT arg_max(h, l) AS root FROM top)
        SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, folded_root, folded_root = root AS verified FROM p JOIN subroots USING (t) JOIN high USING (r), root""",
}
