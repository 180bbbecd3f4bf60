"""Versions of a set of tables: data that is written first, and a log of commits that says which data is current.

A commit is one small file whose name is its version. It is put in place by a rename that doesn't overwrite, so of
two publishers with one version in view only one succeeds. Readers follow the last commit; what a failed or
lost publisher leaves behind is named by none.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


class Conflict(Exception):
    """Somebody else has published since the tables were read."""


@dataclass(frozen=True)
class Commit:
    version: int
    tables: dict[str, str]
    properties: dict = field(default_factory=dict)
    batch: str | None = None


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _path(spark: SparkSession, *parts: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join(parts))


def _read(spark: SparkSession, path) -> Commit:
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        return Commit(**json.loads(bytes(stream.readAllBytes()).decode()))
    finally:
        stream.close()


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The versions that can be read, in order."""
    fs, log = _files(spark, folder), _path(spark, folder, "_commits")
    names = [f.getPath().getName() for f in fs.listStatus(log)] if fs.exists(log) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def commit(spark: SparkSession, folder: str, version: int | None = None) -> Commit | None:
    """The commit of a version, or the last one; None if nothing was published."""
    found = versions(spark, folder)
    if version is None and not found:
        return None
    return _read(spark, _path(spark, folder, "_commits", f"{found[-1] if version is None else version:020d}.json"))


def current(spark: SparkSession, folder: str, name: str, version: int | None = None) -> DataFrame:
    """A table as of the last commit, or of a version; ValueError if it isn't there."""
    last = commit(spark, folder, version)
    if last is None or name not in last.tables:
        raise ValueError(f"{folder} has no table {name}")
    return spark.read.parquet(f"{folder}/{last.tables[name]}")


def publish(tables: dict[str, DataFrame], folder: str, expected: int | None = None, batch: str | None = None, properties: dict | None = None) -> int:
    """Write tables and make them current together; those that aren't given stay as they were. Returns the version.

    ``expected`` is the version that they were made from (0: none); Conflict if another one is current by now. A ``batch`` that was
    published before isn't published again. Properties, where given, are added to those of the version before.
    """
    spark = next(iter(tables.values())).sparkSession
    last = commit(spark, folder) or Commit(0, {})
    if batch is not None:
        for version in reversed(versions(spark, folder)):
            if commit(spark, folder, version).batch == batch:
                return version
    if expected is not None and last.version != expected:
        raise Conflict(f"{folder} is at version {last.version}, not {expected}")
    data = f"data-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{data}/{name}")
    new = Commit(last.version + 1, last.tables | {n: f"{data}/{n}" for n in tables}, last.properties | (properties or {}), batch)
    fs, context = _files(spark, folder), spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext
    staged, final = (_path(spark, folder, "_commits", n) for n in (f".{data}", f"{new.version:020d}.json"))
    out = fs.create(staged, False)
    out.write(bytearray(json.dumps(new.__dict__).encode()))
    out.close()
    none = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.getFileContext(staged.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(staged), fs.makeQualified(final), none)
    except Exception as error:
        fs.delete(staged, False)
        if fs.exists(final):
            raise Conflict(f"version {new.version} of {folder} was published by somebody else") from error
        raise
    return new.version


def drop_old(spark: SparkSession, folder: str, keep: int = 2) -> list[int]:
    """Delete all but the last ``keep`` versions and the data that none of these names; returns what was dropped.

    Data that a publisher is still writing is named by none, so run this when none is at work.
    """
    fs, found = _files(spark, folder), versions(spark, folder)
    gone, kept = found[: max(0, len(found) - max(1, keep))], found[-max(1, keep) :]
    named = {path.split("/")[0] for v in kept for path in commit(spark, folder, v).tables.values()}
    used = {(path.split("/")[0], path.split("/")[1]) for v in kept for path in commit(spark, folder, v).tables.values()}
    for v in gone:
        fs.delete(_path(spark, folder, "_commits", f"{v:020d}.json"), False)
    for status in fs.listStatus(_path(spark, folder)):
        own = status.getPath().getName()
        if not own.startswith("data-"):
            continue
        if own not in named:
            fs.delete(status.getPath(), True)
            continue
        for part in fs.listStatus(status.getPath()):
            if (own, part.getPath().getName()) not in used:
                fs.delete(part.getPath(), True)
    return gone
