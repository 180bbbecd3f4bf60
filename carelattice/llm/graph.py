"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def _contract(edges: DataFrame, larger: bool) -> DataFrame:
    """One star step. Smallest neighbours come from a partial aggregate and a join, so that a
    node with very many neighbours is never gathered in one task."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    if larger:
        both = both.unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    least = both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("root"))
    moved = both.join(least, "node")
    if larger:
        moved = moved.filter(F.col("other") > F.col("node")).select(F.col("other").alias("a"), F.col("root").alias("b"))
    else:
        moved = moved.select(F.col("other").alias("a"), F.col("root").alias("b")).unionByName(
            least.select(F.col("node").alias("a"), F.col("root").alias("b"))
        )
    return moved.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """Components of ``links(a, b)``: rows (node, component), component being the smallest node reachable.

    Only nodes with a link to another node are returned. Large-star and small-star steps
    alternate until neither changes the table; each round's links are written to the shared
    folder. Null ends and self-links are ignored; no links give no rows.
    """
    a, b = F.col("a"), F.col("b")
    edges = links.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    edges = materialize(edges, "links")
    before = None
    while True:
        count, mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (count, mark) == before or not count:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = (count, mark)
        edges = materialize(_contract(_contract(edges, True), False), "links")
