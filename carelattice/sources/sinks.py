"""Appends, staged publication, updates and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def _path(spark: SparkSession, path: str):
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), file


def publish(tables: dict[str, DataFrame], folder: str) -> str:
    """Write tables together: into a staging folder first, which one rename then makes the next version.

    Readers see either the whole version or none of it; a failure leaves the staging folder only. Versions stand side by side; where
    readers ask for the current one, use ``commits.publish``.
    """
    spark = next(iter(tables.values())).sparkSession
    version = uuid.uuid4().hex
    staged, final = f"{folder}/.staging-{version}", f"{folder}/version-{version}"
    for name, df in tables.items():
        df.write.parquet(f"{staged}/{name}")
    fs, source = _path(spark, staged)
    if not fs.rename(source, _path(spark, final)[1]):
        raise OSError(f"could not publish {final}")
    return final


def publish_guides(guides: DataFrame, sources: DataFrame, owned: DataFrame, folder: str, key: str = "guide_id") -> str:
    """Guides with their citations, all or nothing.

    ``owned(care_episode_id, kind, ref)`` lists what each episode's patient may cite; ValueError, before
    anything is written, if a citation of the patient's record isn't among it.
    """
    cited = sources.filter("source_type = 'PATIENT_SAVED_FIELD'").join(guides.select(key, "care_episode_id"), key)
    strangers = cited.join(owned, ["care_episode_id", "kind", "ref"], "left_anti")
    if strangers.limit(1).count():
        raise ValueError("a citation is not of its episode")
    return publish({"guides": guides, "sources": sources}, folder)


def partial_update(df: DataFrame, changes: DataFrame, key: str, stamp: Column | None = None) -> DataFrame:
    """Columns of ``changes`` that aren't null replace those of ``df``; ``updated_at`` is set where anything changed."""
    names = [c for c in changes.columns if c != key]
    joined = df.join(changes.select(key, F.struct(*names).alias("_new")), key, "left")
    if stamp is not None:
        given = F.coalesce(*(F.col(f"_new.{n}").cast("string") for n in names)).isNotNull()
        joined = joined.withColumn("updated_at", F.when(given, stamp).otherwise(F.col("updated_at")))
    return joined.withColumns({n: F.coalesce(F.col(f"_new.{n}"), F.col(n)) for n in names}).drop("_new")


def upsert_owned(df: DataFrame, changes: DataFrame, key: str, owner: str) -> tuple[DataFrame, DataFrame]:
    """The table after an upsert by natural key, and the changes refused because another owner has the key.

    An accepted row is active again. Nulls in ``key`` never match. Of several changes with one key one is taken: an accepted one's
    first by its values, so the key stays unique.
    """
    held = df.select(key, F.col(owner).alias("_owner"))
    known = changes.join(held, key, "left")
    taken = F.coalesce(F.col("_owner") != F.col(owner), F.lit(False))
    accepted, refused = known.filter(~taken).drop("_owner"), known.filter(taken).drop("_owner")
    own = [c for c in accepted.columns if c != key]
    accepted = accepted.filter(F.col(key).isNull()).unionByName(accepted.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*own)).alias("_row")).select(key, "_row.*"))
    rest = df.join(accepted.select(key), key, "left_anti")
    return rest.unionByName(accepted.withColumn("is_active", F.lit(True)), allowMissingColumns=True), refused


def csv_lines(df: DataFrame, *columns: str) -> DataFrame:
    """The records of a CSV export as column ``value``."""
    return df.select(text.csv_line(*(F.col(c) for c in columns)).alias("value"))


def write_csv(df: DataFrame, columns: list[str], path: str) -> None:
    """One CSV file with a byte order mark, a header and CRLF line ends; ValueError for an empty table.

    Meant for reports that people download, so it is one file, written by one task.
    """
    if not df.limit(1).count():
        raise ValueError("nothing to export")
    head = df.sparkSession.range(1).select(F.concat(F.lit("﻿"), text.csv_line(*map(F.lit, columns))).alias("value"))
    body = csv_lines(df, *columns)
    ordered = head.withColumn("part", F.lit(0)).unionByName(body.withColumn("part", F.lit(1))).coalesce(1)
    ordered.sortWithinPartitions("part").select("value").write.option("lineSep", "\r\n").text(path)
