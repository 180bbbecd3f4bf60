"""Exact dedup by content sort.

Sampled splitters range-partition the normalised text, an external sort places equal texts
side by side, and neighbours are compared in full. The range key is bounded in size (the
first ``PREFIX`` characters, a 64-bit hash, and the identifier), so the driver's sample of
splitters stays small for very long texts and a group of any size spreads over partitions.
A group cut by a partition border is put together from one summary row for each side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Rows up to which a checked table of dropped rows is broadcast; beyond, Spark shuffles.
BROADCAST_ROWS = 500_000
PREFIX = 32
BLANKS = " \t\n\x0b\x0c\r"
_RUN = "doc_id long, n_chars long, part long, run long, keep_id long, keep_chars long, size long, sha string, border string"


def _better(a: tuple, b: tuple) -> tuple:
    """Most code points first, then the smallest identifier; a missing identifier comes last."""
    return min(a, b, key=lambda x: (-x[0], x[1] is None, x[1] or 0))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Group equal neighbours. A run's rows (two numbers each) are held until it ends; the first
    and last keys of the partition carry their text, to be matched with other partitions."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = [x.split()[0] for x in _RUN.split(", ")]
    schema = pa.schema([(n, pa.string() if n in ("sha", "border") else pa.int64()) for n in names])
    out: list[list] = [[] for _ in names]
    held: list[tuple] = []
    key, text, members, best, run, first_key = None, None, [], None, 0, None

    def close(border: bool) -> None:
        sha = hashlib.sha256(text.encode()).hexdigest()
        for i, (doc, chars) in enumerate(members):
            row = (doc, chars, part, run, best[1], best[0], len(members), sha, text if border and i == 0 else ("" if border else None))
            for column, value in zip(out, row, strict=True):
                column.append(value)

    def flush() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, schema.types, strict=True)], schema=schema)
        for column in out:
            column.clear()
        return done

    for batch in batches:
        for doc, chars, h, prefix, norm in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if norm != text:
                if text is not None:
                    held.append((key, run, text, members, best))
                    run += 1
                if (prefix, h) != key:
                    for k, run_no, t, m, b in held:
                        run_now, text_now, members_now, best_now = run, text, members, best
                        run, text, members, best = run_no, t, m, b
                        close(k == first_key)
                        run, text, members, best = run_now, text_now, members_now, best_now
                    held.clear()
                    key = (prefix, h)
                    first_key = first_key or key
                text, members, best = norm, [], (chars, doc)
            members.append((doc, chars))
            best = _better(best, (chars, doc))
        if len(out[0]) >= 4096:
            yield flush()
    if text is not None:
        held.append((key, run, text, members, best))
        for _, run, text, members, best in held:
            close(True)
    yield flush()


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without space, tab, LF, VT, FF and CR; null is empty, and all
    empty texts are one group. The row with the most code points in its original text stays,
    then the smallest identifier (null identifiers last). Rows repeated with the same identifier
    and text count in group_size; all of them carry kept = true if theirs is the row that stays
    (``keep_first`` keeps one). An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    norm = F.translate(text, BLANKS, "")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.char_length(text).cast("long").alias("n_chars"), norm.alias("norm"))
    rows = rows.select("doc_id", "n_chars", F.xxhash64("norm").alias("h"), F.substring("norm", 1, PREFIX).alias("prefix"), "norm")
    ordered = rows.repartitionByRange("prefix", "h", "doc_id").sortWithinPartitions("prefix", "h", "norm", "doc_id")
    runs = materialize(ordered.mapInArrow(_runs, _RUN), "sorted-runs")
    ends = runs.filter(F.col("border").isNotNull()).groupBy("part", "run").agg(
        F.max("border").alias("norm"), *(F.first(c).alias(c) for c in ("keep_id", "keep_chars", "size"))
    )
    rank = F.struct((-F.col("keep_chars")).alias("c"), F.col("keep_id").isNull().alias("n"), F.col("keep_id").alias("i"))
    whole = ends.groupBy("norm").agg(F.min(rank).alias("best"), F.sum("size").alias("all_size"))
    ends = ends.join(whole, "norm").select("part", "run", F.col("best.i").alias("all_keep"), F.negate("best.c").alias("all_chars"), "all_size")
    # At most the runs of the first and last key of each partition: a few rows for each task of the sort.
    found = runs.join(ends, ["part", "run"], "left")
    keep, chars = (F.when(F.col("all_size").isNotNull(), F.col(a)).otherwise(F.col(b)) for a, b in (("all_keep", "keep_id"), ("all_chars", "keep_chars")))
    return found.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("all_size", "size").alias("group_size"),
        (F.col("doc_id").eqNullSafe(keep) & (F.col("n_chars") == chars)).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``exact_dedup`` drops, one row of each group of equal texts.

    Where the identifier that stays has several rows with that text, the row with the most code points stays, then the
    smallest text, then the smallest row as JSON. Null and empty texts are one group; null identifiers come last.
    An empty table stays empty; columns may have any names.
    """
    found = materialize(exact_dedup(docs, id_col, text_col), "dedup")
    text = F.coalesce(F.col(text_col), F.lit(""))
    mark = lambda sha: F.substring(sha, 1, 32)
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), mark(F.sha2(F.translate(text, BLANKS, ""), 256)).alias("mark"), text.alias("text"))
    same = lambda side: F.col("id").eqNullSafe(side["of_id"]) & (F.col("mark") == side["of_mark"])
    side = lambda which: found.filter(which).select(F.col("doc_id").alias("of_id"), mark("text_sha256").alias("of_mark")).distinct()
    if found.groupBy("doc_id", "text_sha256").count().filter("count > 1").limit(1).count():
        stays = side("kept")
        best = F.min_by("row", F.struct(-F.char_length("text"), "text", F.to_json("row")))
        return rows.join(stays, same(stays), "left_semi").groupBy("id", "mark").agg(best.alias("row")).select("row.*")
    gone = side("NOT kept")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return rows.join(gone, same(gone), "left_anti").select("row.*")
