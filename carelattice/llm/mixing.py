"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
#: Words of the mix as a share of all words, and how often a document may be taken.
BUDGET, REPEATS = 1.5, 2
#: Rows of a source that one bucket of the shuffled order holds at most on average, and the fewest buckets.
BUCKET_ROWS, LEAST_BUCKETS = 50_000, 256


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """One row per source: source, source_size, docs, target.

    A source's target is min(repeats * size, level * weight); the level is the one at which the
    targets add up to the budget. That is where resharing the excess by weight ends. The level is
    found with running sums over the sources in the order in which they reach their limits.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")))
    sources = sources.withColumn("most", (F.col("source_size") * repeats).cast("double")).withColumn("fills", F.col("most") / F.col("weight"))
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy("fills", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sources = (
        sources.withColumn("all_words", F.sum("source_size").over(everything) * F.lit(float(budget)))
        .withColumn("filled", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    )
    # The level if all sources before this one are full and the rest are not: right for the first one that isn't full.
    level = (F.col("all_words") - F.col("filled")) / F.col("open")
    sources = sources.withColumn("level", F.min(F.when(level <= F.col("fills"), F.struct("fills", F.col("source").isNull(), "source", level.alias("level")))).over(everything)["level"])
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("weight")))
    return sources.select("source", "source_size", "docs", target.alias("target"))


def _queues(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Each row's place in its source's shuffled queue: begins, the words before it; with its source's size and target."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"),
        F.xxhash64(F.lit(seed), id_col, text_col).alias("text_hash"),
    )
    sized = materialize(sized, "sizes")
    targets = materialize(source_targets(sized), "targets")
    largest = targets.agg(F.max("docs")).first()[0] or 0
    bits = max(int(math.log2(LEAST_BUCKETS)), math.ceil(math.log2(max(1, largest / BUCKET_ROWS))))
    # Buckets are the leading bits of the shuffled order, so running totals need no source in one task.
    sized = sized.withColumn("bucket", F.shiftrightunsigned("text_hash", 64 - bits))
    totals = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "offset")
    within = Window.partitionBy("source", "bucket").orderBy("text_hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    queued = sized.withColumn("ahead", F.coalesce(F.sum("size").over(within), F.lit(0)))
    queued = queued.join(totals, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    # One row for each source: broadcast by Spark where its measured size allows it.
    targets = targets.select(F.col("source").alias("t"), "source_size", "target")
    queued = queued.join(targets, F.col("source").eqNullSafe(F.col("t"))).withColumn("begins", F.col("offset") + F.col("ahead"))
    return queued.select("doc_id", "source", "text_hash", "size", "source_size", "target", "begins")


def _cut(queued: DataFrame) -> float:
    """The virtual time at which all sources together have been served the budget.

    In virtual time every source is served at the rate of its target, and none is used up before its target is reached. So the
    running total over the global order is the time passed times the sum of the rates, and needs no walk.
    """
    rates = queued.groupBy("source").agg(F.max("target").alias("target"), F.max("source_size").alias("size"))
    total, words = rates.agg(F.sum("target"), F.sum("size")).first()
    return min(BUDGET, REPEATS) * words / total if total else 0.0


def fair_schedule(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """Each row of ``docs`` with its place in the mix, range-sorted by virtual finish time.

    Columns: doc_id, source, text_hash, size (words of ``[^\\x20\\x09-\\x0D]+``, null text 0), source_size,
    target (words), begins (words of its source before it in the shuffled order), finish (virtual
    finish time: words of its source up to its end, divided by the target), finish_2 (of its
    second turn), taken (words).

    A source's documents are queued in an order shuffled by a hash of identifier and text, and
    queued again after that, up to ``REPEATS`` times. All turns of all sources stand in one order, that of their finish times, and
    the order is truncated at the virtual time at which the total budget is reached: turns that have finished by then are whole, each
    source's turn in service has the words that it was served by then, and what comes later is not taken. So a source
    misses its target by less than a word at any size, and no
    document exceeds ``REPEATS`` times its size. Empty texts take 0; a source without words has
    target 0. A null source is one source; rows repeated with one identifier are queued each; an empty table gives no rows.
    Reruns agree, up to which of two rows alike in identifier and text is which.
    """
    queued = materialize(_queues(docs, id_col, text_col, source_col, seed), "queue")
    time = _cut(queued)
    starts = [F.col("begins") + i * F.col("source_size") for i in range(REPEATS)]
    served = F.round(F.col("target") * F.lit(time)).cast("long")
    turn = lambda start: F.least(F.greatest(served - start, F.lit(0).cast("long")), F.col("size"))
    plan = queued.withColumn("taken", sum((turn(s) for s in starts[1:]), turn(starts[0])))
    finishes = ["finish" if i == 0 else f"finish_{i + 1}" for i in range(REPEATS)]
    for name, start in zip(finishes, starts, strict=True):
        plan = plan.withColumn(name, F.when(F.col("target") > 0, (start + F.col("size")) / F.col("target")))
    plan = plan.select("doc_id", "source", "text_hash", "size", "source_size", "target", "begins", *finishes, "taken")
    return plan.repartitionByRange("finish", "text_hash").sortWithinPartitions("finish", "text_hash")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """The mix itself: rows of ``docs`` with its columns, in the order of their virtual finish times.

    Documents are taken whole. The turns that the cut falls into, one a source at most, are taken or left in the order of their finish times
    so that the total stays nearest to the budget. A document
    taken twice is two rows; a document that isn't taken, or has no words (null and blank texts), is no row. A null
    source is one source. Rows alike in identifier and text are queued each. An empty table stays empty; columns may have any names.
    """
    plan = materialize(fair_schedule(docs, id_col, text_col, source_col, seed), "schedule")
    first = F.least("size", "taken")
    served = F.array(F.struct(first.alias("words"), "finish"), F.struct((F.col("taken") - first).alias("words"), F.col("finish_2").alias("finish")))
    turns = plan.filter("size > 0").select("doc_id", "text_hash", "size", F.explode(served).alias("turn")).select("doc_id", "text_hash", "size", "turn.*").filter("words > 0")
    kept, off = [], 0
    for t in turns.filter("words < size").orderBy("finish", "text_hash").collect():  # one turn a source at most
        whole = abs(off + t["size"] - t["words"]) <= abs(off - t["words"])
        off += t["size"] - t["words"] if whole else -t["words"]
        kept += [(t["doc_id"], t["text_hash"], t["finish"])] if whole else []
    turns = turns.filter("words = size").select("doc_id", "text_hash", "finish")
    turns = turns.unionByName(docs.sparkSession.createDataFrame(kept, turns.schema))
    # The documents' own columns are inside ``row``, so no name of theirs can clash.
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("d"), F.xxhash64(F.lit(seed), id_col, text_col).alias("h"))
    if plan.groupBy("doc_id", "text_hash").count().filter("count > 1").limit(1).count():  # the turns of rows alike are rows of their own
        rows = rows.groupBy("d", "h").agg(F.first("row").alias("row"))
    out = rows.join(turns, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("text_hash")))
    return out.repartitionByRange("finish", "h").sortWithinPartitions("finish", "h").select("row.*")
