"""Re-indexing of documents into a chunk table, all or nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import identity, text
from ..operators import search, splitter

Embed = Callable[[DataFrame], DataFrame]


def chunks_of(pages: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """point_id, document_id, page_number, chunk_index and content of cleaned pages(document_id, page_number, text); blank pages drop out but keep their number."""
    cleaned = pages.withColumn("text", text.clean_text(F.col("text"))).filter(F.col("text") != "")
    chunks = splitter.split_documents(cleaned.select("document_id", "page_number", "text"), size, overlap)
    name = F.to_json(F.struct("document_id", "page_number", F.col("chunk").alias("content")), {"ignoreNullFields": "false"})
    return chunks.select(identity.uuid5(name).alias("point_id"), "document_id", "page_number", "chunk_index", F.col("chunk").alias("content"))


def reindex(table: DataFrame, chunks: DataFrame, embed: Embed) -> dict[str, DataFrame]:
    """The table with the documents of ``chunks`` replaced: ``table``, ``written`` and ``obsolete`` ids.

    Points with one id (the same content on one page) are one. Nothing is written here, so a failure
    of ``embed`` leaves the old table as it is; the caller publishes the new one at once.
    """
    written = embed(chunks.dropDuplicates(["point_id"]))
    documents = chunks.select("document_id").distinct()
    before = table.join(documents, "document_id", "left_semi")
    rest = table.join(documents, "document_id", "left_anti")
    return {"table": rest.unionByName(written.select(*table.columns)), "written": written, "obsolete": search.obsolete_ids(before, written)}


def report(chunks: DataFrame) -> DataFrame:
    """Chunks of each document before equal ones are merged, and after."""
    return chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("point_id").alias("points"))
