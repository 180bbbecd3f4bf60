"""From raw documents to token ids: language, exact copies, near copies, mix, encoding.

Each stage works on all rows that the stage before it kept, and its result is written and read
again before the next. Part of the subpackage ``carelattice.llm`` in all but place.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelattice.llm import bpe_fold, exact_dedup, jaccard_join, langid, mixing
from carelattice.llm.shared import materialize

#: The share of its letters that a document's language must have.
LEAST_SHARE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter (null and empty texts too) and those in which no language has half of the letters.

    A missing lang is filled with the prediction. The model learns from the labelled documents of
    its input, but for the held-out quarter; where there are none, all are rejected. Null identifiers are predicted, not
    learned from; repeated rows count each. An empty table stays empty; extra columns may have any names.
    """
    labelled = docs.filter(langid.fold("doc_id", 4) != 2).select("lang", "text")
    # Plain names while the prediction's columns stand beside them.
    plain = dict(zip(docs.columns, (f"c{i}" for i in range(len(docs.columns))), strict=True))
    found = langid.predict(docs.toDF(*plain.values()), langid.train(labelled), list(plain.values()), plain["text"])
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SHARE))
    return kept.withColumn(plain["lang"], F.coalesce(plain["lang"], "lang_pred")).select(*plain.values()).toDF(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that is equal without white space: the longest, then the smallest doc_id.

    Null and empty texts are one group. Ties, repeated rows, the empty table and names: see ``exact_dedup.keep_first``.
    """
    return exact_dedup.keep_first(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each group linked by five-word shingles with a similarity of 0.8.

    Texts without words, rows with a null doc_id and rows that repeat a kept one all stay. The empty table and names:
    see ``jaccard_join.keep_smallest``.
    """
    return jaccard_join.keep_smallest(docs, k=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes whole documents in the order of the queue up to the budget, twice where a source's target asks for that.

    Texts without words are never taken; a null source is one source. Ties, repeated rows, the empty table and names: see
    ``mixing.mixed_documents``.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them, a row for each row of the mix.

    Null texts are empty; repeated rows are encoded each; an empty table gives no rows; other columns are ignored.
    """
    return bpe_fold.encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [("language_id", language_id), ("exact_copies", exact_copies), ("near_copies", near_copies), ("mix", mix), ("encode", encode)]

#: SQL has neither the language model nor the token merges; tests/llm compares each stage with a plain restatement.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
