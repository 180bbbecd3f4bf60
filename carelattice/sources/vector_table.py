"""The vector table: what it holds, said once and checked whenever it is opened, and points made of ids, chunks and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators import search
from . import commits

METRIC = "COSINE"
TABLE = "points"
#: Why a batch isn't taken, in the order in which it is found out.
PAIR_ERRORS = ("NULL_LIST", "UNEQUAL_LENGTHS", "WRONG_SIZE")


def create(spark: SparkSession, folder: str, size: int, metric: str = METRIC, vectors: int = 1) -> None:
    """An empty table for vectors of ``size`` components; one that is there already stays, if it is alike."""
    if commits.commit(spark, folder) is None:
        empty = spark.createDataFrame([], schemas.POINT)
        commits.publish({TABLE: empty}, folder, 0, properties={"size": size, "metric": metric, "vectors": vectors})
    else:
        check(spark, folder, size, metric)


def check(spark: SparkSession, folder: str, size: int, metric: str = METRIC) -> commits.Commit:
    """The table's last commit; ValueError unless it holds one vector a point, of that size and metric."""
    found = commits.commit(spark, folder)
    if found is None:
        raise ValueError(f"no vector table in {folder}")
    if found.properties.get("vectors") != 1:
        raise ValueError("only tables of one vector a point can be used")
    if found.properties.get("size") != size:
        raise ValueError(f"the table's vectors have {found.properties.get('size')} components, not {size}")
    if found.properties.get("metric") != metric:
        raise ValueError(f"the table is for {found.properties.get('metric')}, not {metric}")
    return found


def pair(batches: DataFrame, size: int, *keep: str) -> tuple[DataFrame, DataFrame]:
    """Points of batches (ids, chunks, vectors: lists), and the batches that aren't taken, with ``error``.

    The lists belong together place by place, so they must be equally long; and all of a batch's vectors must have ``size`` components. A
    batch is taken whole or not at all; one of empty lists gives no point.
    """
    lists = [F.col(n) for n in ("ids", "chunks", "vectors")]
    unequal = (F.size("ids") != F.size("chunks")) | (F.size("ids") != F.size("vectors"))
    wrong = F.exists("vectors", lambda v: F.coalesce(F.size(v) != size, F.lit(True)))
    null = lists[0].isNull() | lists[1].isNull() | lists[2].isNull()
    checked = batches.withColumn("error", F.when(null, PAIR_ERRORS[0]).when(unequal, PAIR_ERRORS[1]).when(wrong, PAIR_ERRORS[2]))
    zipped = F.explode(F.arrays_zip(*lists)).alias("p")
    points = checked.filter("error IS NULL").select(*keep, zipped).select(*keep, F.col("p.ids").alias("point_id"), F.col("p.chunks").alias("chunk"), F.col("p.vectors").alias("vector"))
    return points, checked.filter("error IS NOT NULL").drop("ids", "chunks", "vectors")


def upsert(points: DataFrame, folder: str, size: int, metric: str = METRIC, batch: str | None = None) -> int:
    """Points (of schemas.POINT) in place of those with their identifiers; ValueError for a vector of another size. Returns the version."""
    spark = points.sparkSession
    last = check(spark, folder, size, metric)
    if search.size_report(points, size).first().wrong_size:
        raise ValueError(f"vectors must have {size} components")
    old = commits.current(spark, folder, TABLE).join(points.select("point_id"), "point_id", "left_anti")
    return commits.publish({TABLE: old.unionByName(points.select(*old.columns))}, folder, last.version, batch)


def delete_document(spark: SparkSession, folder: str, document_id: str) -> int | None:
    """Without the points of a document; ValueError for a blank identifier, None if there is no table."""
    if not (own := document_id.strip()):
        raise ValueError("the document's identifier is blank")
    if (last := commits.commit(spark, folder)) is None:
        return None
    left = search.delete_where(commits.current(spark, folder, TABLE), F.col("metadata.document_id") == own)
    return commits.publish({TABLE: left}, folder, last.version)
