"""Index-job messages: contract, attempts, rejection and dead letters, once for each batch."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import collections, text

MOST_ATTEMPTS = 3
DEFAULTS = {"chunk_size": 1000, "chunk_overlap": 200}


def contract(fields: Column) -> Column:
    """The typed request of a message's fields, null if they don't make one."""
    number = lambda name: F.coalesce(fields[name].try_cast("int"), F.when(fields[name].isNull(), DEFAULTS[name]))
    job, path, size, overlap = text.blank_to_null(fields["job_id"]), fields["manifest_path"], number("chunk_size"), number("chunk_overlap")
    ok = job.isNotNull() & (fields["job_type"] == "PUBLIC_GUIDELINE_INDEX") & text.has_suffix(path, ".json") & (size > 0) & (overlap >= 0) & (overlap < size)
    return F.when(ok, F.struct(job.alias("job_id"), path.alias("manifest_path"), size.alias("chunk_size"), overlap.alias("chunk_overlap")))


def split_valid(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Messages with their request, and those that break the contract, which are answered and dropped."""
    typed = messages.withColumn("request", contract(F.col("fields")))
    return typed.filter(F.col("request").isNotNull()), typed.filter(F.col("request").isNull()).drop("request")


def dead_letters(failed: DataFrame) -> DataFrame:
    """Failed messages(message_id, fields, failure_type, failure_message) as dead letters: their fields and what happened."""
    facts = F.create_map(F.lit("original_message_id"), F.col("message_id"), F.lit("failure_type"), F.col("failure_type"), F.lit("failure_message"), F.col("failure_message"))
    return failed.select("message_id", collections.merge_maps(F.col("fields"), facts).alias("fields"))


def process_batch(batch: DataFrame, handle: Callable[[DataFrame], DataFrame], attempts: DataFrame, most: int = MOST_ATTEMPTS) -> dict[str, DataFrame]:
    """What one batch leads to: ``done``, ``rejected``, ``retry`` and ``dead``.

    ``handle`` adds failure_type and failure_message (null for success) to valid messages; ``attempts``
    holds earlier failures(message_id, attempt).
    """
    valid, rejected = split_valid(batch)
    tried = handle(valid).join(attempts.groupBy("message_id").agg(F.max("attempt").alias("attempt")), "message_id", "left")
    tried = tried.withColumn("attempt", F.coalesce("attempt", F.lit(0)) + 1)
    failed = tried.filter(F.col("failure_type").isNotNull())
    return {
        "done": tried.filter(F.col("failure_type").isNull()).select("message_id", "request.*"),
        "rejected": rejected,
        "retry": failed.filter(F.col("attempt") < most).select("message_id", "fields", "attempt"),
        "dead": dead_letters(failed.filter(F.col("attempt") >= most)),
    }


def run(stream: DataFrame, handle: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, most: int = MOST_ATTEMPTS) -> StreamingQuery:
    """Consume ``stream``; each batch's outcome is written once under its number, so a batch that runs again replaces all of it.

    Offsets are Spark's, kept in ``checkpoint``: a message counts as consumed once its batch's outcome is
    written. A failed message is tried again within its batch until it succeeds or is dead. What ``handle`` answers is
    written before it is split, so it runs once for each attempt and each message has one outcome.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        pending = batch.select("message_id", "fields")
        attempts = spark.createDataFrame([], "message_id string, attempt int")
        found: dict[str, list[DataFrame]] = {"done": [], "rejected": [], "dead": []}
        for attempt in range(1, most + 1):
            tried = f"{folder}/tried/batch={number}/attempt={attempt}"
            handle(split_valid(pending)[0]).write.mode("overwrite").parquet(tried)
            answered = spark.read.parquet(tried)
            outcome = process_batch(pending, lambda _, answered=answered: answered, attempts, most)
            for name, frames in found.items():
                frames.append(outcome[name])
            pending, attempts = outcome["retry"].select("message_id", "fields"), outcome["retry"].select("message_id", "attempt")
            if not pending.limit(1).count():
                break
        for name, frames in found.items():
            reduce(DataFrame.unionByName, frames).write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
