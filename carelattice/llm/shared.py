"""Tables that cut lineage, kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

#: With it Spark removes an action's shuffle files when the action ends, else when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset a local one is set in local mode; on a
    cluster, whose executors could not read it, ValueError is raised."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="carelattice-")
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/carelattice/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    The files outlive lost executors and stay until ``drop_shared`` or the folder's owner
    removes them, since lazily evaluated results may still read them.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Frames made within leave no shuffle files behind their actions, for rounds that would otherwise pile them up.

    A frame that runs again shuffles again.
    """
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


@contextmanager
def brief_broadcast(spark: SparkSession, value: object) -> Iterator[Broadcast]:
    """A broadcast for the actions within; its copies at the driver and the executors go with the block."""
    shared = spark.sparkContext.broadcast(value)
    try:
        yield shared
    finally:
        shared.destroy()


def drop_shared(spark: SparkSession) -> None:
    """Delete every table written by ``materialize`` under the session's shared folder."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/carelattice")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
