"""Tables, patient documents, manifests, pages and message files."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from .. import schemas


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, lower: int, upper: int, parts: int = 10) -> DataFrame:
    """A database table read by ranges of a numeric key, one connection for each part."""
    return spark.read.jdbc(url, name, column=key, lowerBound=lower, upperBound=upper, numPartitions=parts)


def by_key(df: DataFrame, **key) -> DataFrame:
    """The row with this key, or none; where the key isn't unique, the first by the columns that can be ordered."""
    for name, value in key.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df.orderBy(*(f.name for f in df.schema if not isinstance(f.dataType, MapType))).limit(1)


def patient_context(spark: SparkSession, path: str, user_id: int, care_episode_id: int) -> DataFrame:
    """The patient document at ``path``; ValueError unless it is the asked patient's and episode's."""
    found = spark.read.schema(schemas.PATIENT_CONTEXT).json(path, multiLine=True)
    if not found.filter((F.col("user_id") == user_id) & (F.col("care_episode_id") == care_episode_id)).limit(1).count():
        raise ValueError("the document is of another patient or episode")
    return found


def confirmed_only(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records that were confirmed, and those to reject."""
    ok = F.col("confirmed_at").isNotNull() & (F.coalesce("confirmation_hash", F.lit("")) != "")
    return records.filter(ok), records.filter(~ok)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document of a manifest, with ``file_path`` resolved against the manifest's folder.

    ValueError for repeated identifiers, files that aren't PDF, or files that aren't there. A manifest
    is short (one row for each source file), so its paths are checked from the driver.
    """
    rows = spark.read.schema(schemas.MANIFEST).json(path, multiLine=True).select(F.explode("documents").alias("d")).select("d.*")
    folder = path.rsplit("/", 1)[0] if "/" in path else "."
    rows = rows.withColumn("file_path", F.when(F.col("file_path").rlike("^(?:/|[a-z0-9]+:)"), F.col("file_path")).otherwise(F.concat(F.lit(folder + "/"), "file_path")))
    listed = rows.select("document_id", "file_path").collect()
    counts = Counter(r.document_id for r in listed)
    if repeated := sorted(i for i, n in counts.items() if n > 1):
        raise ValueError(f"repeated document ids: {repeated}")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for r in listed:
        if not r.file_path.lower().endswith(".pdf"):
            raise ValueError(f"not a PDF: {r.file_path}")
        file = jvm.org.apache.hadoop.fs.Path(r.file_path)
        if not file.getFileSystem(conf).exists(file):
            raise ValueError(f"no such file: {r.file_path}")
    return rows


def pages(files: DataFrame, decode: Callable[[bytes], list[str]]) -> DataFrame:
    """path, page_number (from 1) and text of the pages of binary files(path, content) that aren't blank.

    ``decode`` turns a file's bytes into its pages' texts. A file without any text raises in its task.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                found = [(path, n, t) for n, t in enumerate(decode(bytes(content)), 1) if t and t.strip()]
                if not found:
                    raise ValueError(f"no text in {path}")
                yield pd.DataFrame(found, columns=["path", "page_number", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, page_number int, text string")


def messages(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of index-job messages from JSON files; each trigger takes a bounded number of files."""
    return spark.readStream.schema(schemas.INDEX_MESSAGE).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def visit_time(day: Column, clock: Column) -> Column:
    from ..functions import dates

    return dates.join_day_and_time(day, clock)


def diagnosis_list(x: Column) -> Column:
    """A one-element list, or an empty one for a blank or null diagnosis."""
    from ..functions import text

    own = text.blank_to_null(x)
    return F.when(own.isNotNull(), F.array(own)).otherwise(F.array().cast("array<string>"))
