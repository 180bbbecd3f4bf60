"""A Merkle manifest of a dataset: cogrouped subtree exchange.

Leaves stand in order within their tree (one tree a language) and are cut into superblocks of
``BLOCK`` consecutive ones. A first pass reduces each superblock to its node; these nodes are
the leaves of the outer tree, which is treated likewise, until every tree is one node. Then leaves
and the outer nodes that their proofs need are cogrouped by superblock: one ``applyInPandas`` finishes the
local reduction, joins the local and the outer part of each proof, and folds the proof. No tree, and no
level of one, is ever in one task: a task holds one superblock and the few siblings above it.

A path is text: the levels from the leaf to the root, parted by ``|``; each is the digests of its run, parted by
commas, with ``*`` for the node itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Children of a node, and the levels that a superblock covers.
WIDTH, LEVELS = 8, 3
BLOCK = WIDTH**LEVELS


def digest(text: str) -> str:
    """H: lowercase hex SHA-256."""
    return hashlib.sha256(text.encode()).hexdigest()


def field(x: Column) -> Column:
    """A value as it enters a leaf: its number of UTF-8 bytes, a colon, the value; ``-`` where it is null."""
    value = x.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def lower_ascii(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(node: str, path: str) -> str:
    """The root that a node and the siblings on its path lead to."""
    for level in path.split("|") if path else ():
        node = digest(level.replace("*", node).replace(",", ""))
    return node


def siblings(path: str) -> str:
    """The digests of a path's siblings, level by level, one after another."""
    return path.replace("*", "").replace(",", "").replace("|", "")


def climb(nodes: list[str], size: int, block: int) -> tuple[str, list[str]]:
    """A superblock's node, and each leaf's path to it. In a tree of ``size`` leaves that is one superblock, levels end with its root;
    in a larger one every superblock climbs as many, be it of one leaf."""
    paths: list[list[str]] = [[] for _ in nodes]
    level, spread = list(nodes), 1
    while len(level) > 1 or (size > block and spread < block):
        runs = [level[i : i + WIDTH] for i in range(0, len(level), WIDTH)]
        marked = [",".join([*run[:i], "*", *run[i + 1 :]]) for run in runs for i in range(len(run))]
        for i, path in enumerate(paths):
            path.append(marked[i // spread])
        level, spread = [digest("".join(run)) for run in runs], spread * WIDTH
    return level[0], ["|".join(p) for p in paths]


def _numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their partition, and their number among the rows of their tree in it."""
    part, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        tree = batch.column(batch.schema.get_field_index("tree")).dictionary_encode()
        code, at = tree.indices.to_numpy(), np.arange(batch.num_rows)
        new = np.ones(len(code), bool)
        new[1:] = code[1:] != code[:-1]
        number = at - np.maximum.accumulate(np.where(new, at, 0))
        run = np.cumsum(new)
        if tree.dictionary[int(code[0])].as_py() == last:
            number[run == 1] += count
        last, count = tree.dictionary[int(code[-1])].as_py(), int(number[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(code), part), pa.int32()), pa.array(number, pa.int64())], names=[*batch.schema.names, "part", "number"])


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows(tree, ...)`` with each row's ``position`` among its tree's rows in this order, and the tree's ``size``.

    One range sort of all trees together, so a large tree is many partitions; numbers within these are then moved on by
    what the tree's earlier partitions hold. ``order`` must tell rows apart.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    ordered = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    ordered = materialize(ordered.mapInArrow(_numbers, f"{kinds}, part int, number long"), "ordered")
    counts = ordered.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("tree")
    offsets = counts.select("tree", "part", (F.sum("n").over(tree.orderBy("part")) - F.col("n")).alias("offset"), F.sum("n").over(tree).alias("size"))
    return ordered.join(offsets, ["tree", "part"]).withColumn("position", F.col("offset") + F.col("number")).drop("part", "number", "offset")


def _blocked(nodes: DataFrame, block: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("position") / block).cast("long"))


def reduced(nodes: DataFrame, block: int) -> DataFrame:
    """The nodes of the superblocks of ``nodes(tree, position, node, size)``, as the leaves of the outer trees."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("position")
        size = int(rows["size"].iloc[0])
        node, _ = climb(list(rows["node"]), size, block)
        return pd.DataFrame({"tree": [key[0]], "position": [key[1]], "node": [node], "size": [-(-size // block)]})

    out = "tree string, position long, node string, size long"
    return materialize(_blocked(nodes, block).groupBy("tree", "block").applyInPandas(run, out), "superblocks")


def _joined(rows: pd.DataFrame, above: pd.DataFrame, block: int) -> tuple[pd.DataFrame, list[str]]:
    """Rows of a superblock in order, and their whole paths."""
    rows = rows.sort_values("position")
    _, paths = climb(list(rows["node"]), int(rows["size"].iloc[0]), block)
    outer = above["path"].iloc[0]
    return rows, ["|".join(filter(None, (p, outer))) for p in paths]


def paths_of(nodes: DataFrame, block: int) -> DataFrame:
    """tree, position, path to the tree's root, and that root, of ``nodes(tree, position, node, size)``.

    Each call has a superblock's share of the nodes of the last one, until no tree has more than one.
    """
    if not nodes.filter("size > 1").limit(1).count():
        return nodes.select("tree", "position", F.lit("").alias("path"), F.col("node").alias("root"))
    above = paths_of(reduced(nodes, block), block).withColumnRenamed("position", "block")
    both = _blocked(nodes, block).groupBy("tree", "block").cogroup(above.groupBy("tree", "block"))

    def run(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows, paths = _joined(rows, above, block)
        return pd.DataFrame({"tree": rows["tree"], "position": rows["position"], "path": paths, "root": above["root"].iloc[0]})

    return materialize(both.applyInPandas(run, "tree string, position long, path string, root string"), "outer-paths")


def _proven(with_paths: bool, block: int):
    def run(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows, paths = _joined(rows, above, block)
        root = above["root"].iloc[0]
        folded = [fold(c if isinstance(c, str) else n, p) for n, c, p in zip(rows["node"], rows["claimed"], paths, strict=True)]
        out = pd.DataFrame({"id": rows["id"], "leaf": rows["node"], "subroot": above["subroot"].iloc[0], "root": root, "proof_sha256": [digest(siblings(p)) for p in paths], "folded_root": folded})
        out["verified"] = out["folded_root"] == root
        if with_paths:
            out["path"] = paths
        return out

    return run


def manifest(leaves: DataFrame, with_paths: bool = False, block: int = BLOCK) -> DataFrame:
    """Roots and proofs of ``leaves(tree, id, leaf, claimed)``: id, leaf, subroot, root, proof_sha256, folded_root, verified,
    and the whole ``path`` if asked for.

    Leaves of a tree (a string; null is one of its own and comes first) stand in the order of id, null first, and of leaf where ids
    repeat. ``claimed`` is the leaf that somebody else's copy gives; its proof is folded in place of leaf's unless it is null.
    A tree of one leaf has that leaf as subroot. No leaves give no rows. ``block``, a power of WIDTH, changes no result.
    """
    # The tree's name sorts as its UTF-8 bytes, behind that of null.
    named = leaves.select(F.coalesce(F.concat(F.lit(":"), F.col("tree")), F.lit("")).alias("tree"), F.col("id").cast("long").alias("id"), F.col("leaf").alias("node"), "claimed")
    named = materialize(named.withColumn("row", F.monotonically_increasing_id()), "leaves")  # so equal rows are told apart, and texts read once
    nodes = materialize(placed(named, ["id", "node", "row"]).drop("row"), "positions")
    blocks = reduced(nodes.select("tree", "position", "node", "size"), block)
    outer = materialize(paths_of(blocks, block), "outer")
    subroots = materialize(outer.groupBy("tree").agg(F.first("root").alias("subroot")), "subroots")
    top = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("node")), ["name"])
    top = materialize(top, "top")
    above = paths_of(reduced(top.select("tree", "position", "node", "size"), block), block).withColumnRenamed("position", "block")
    final = _blocked(top, block).groupBy("tree", "block").cogroup(above.groupBy("tree", "block"))

    def top_paths(rows: pd.DataFrame, over: pd.DataFrame) -> pd.DataFrame:
        rows, paths = _joined(rows, over, block)
        return pd.DataFrame({"tree": rows["name"], "subroot": rows["node"], "top_path": paths, "root": over["root"].iloc[0]})

    tops = materialize(final.applyInPandas(top_paths, "tree string, subroot string, top_path string, root string"), "top-paths")
    needed = outer.select("tree", F.col("position").alias("block"), "path").join(tops, "tree")
    needed = needed.select("tree", "block", F.concat_ws("|", F.nullif("path", F.lit("")), F.nullif("top_path", F.lit(""))).alias("path"), "subroot", "root")
    rows = _blocked(nodes.withColumn("id", F.col("id").cast("string")), block)
    both = rows.groupBy("tree", "block").cogroup(needed.groupBy("tree", "block"))
    out = "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", path string" if with_paths else "")
    return both.applyInPandas(_proven(with_paths, block), out).withColumn("id", F.col("id").cast("long"))


def dataset_manifest(docs: DataFrame, with_paths: bool = False, block: int = BLOCK) -> DataFrame:
    """The manifest of ``docs``, a leaf for each row (doc_id, source, lang, n_chars, text), a tree for each lang, with a copy tampered
    in its text's A-Z where 3 divides crc32(doc_id).

    Nulls in any column are part of the leaf; a null doc_id stands first and isn't tampered; rows that repeat are leaves of their own.
    Empty and long texts are hashed whole; a text without A-Z is the same when tampered. An empty table gives no rows; other
    columns are ignored.
    """
    facts = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    leaves = docs.select(F.col("lang").alias("tree"), F.col("doc_id").alias("id"), leaf(*facts, F.col("text")).alias("leaf"), F.when(tampered, leaf(*facts, lower_ascii(F.col("text")))).alias("claimed"))
    return manifest(leaves, with_paths, block).withColumnRenamed("id", "doc_id")
