"""Exact top-k by inner product with a table of distances to pivots.

Vectors of one length L are lifted to one norm, x' = (x, sqrt(M - |x|^2)) and q' = (q, 0), where M is the largest
squared norm. Then |q' - x'|^2 = |q|^2 + M - 2 q.x, so the nearest lifted vectors have the highest
scores. The distances of every vector to many pivots are stored; by the triangle inequality the
largest |d(q', p) - d(x', p)| bounds d(q', x') from below and so the score from above. A block's
candidates are evaluated in the order of that bound until it can't reach the k-th best score.

Queries and candidates are packed into blocks; every block of queries meets every block of
candidates by an equi-join on a group number, of which there are as many as the candidates fill blocks. A task keeps its queries' best
from meeting to meeting and returns k rows a query at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize

PIVOTS = 24
#: Vectors in a block of candidates and in a block of queries, candidates evaluated at a step, and query blocks whose best a task holds.
CANDIDATES, QUERIES, STEP, HELD_BLOCKS = 4096, 512, 256, 64
#: What rounding may add to a squared distance, as a share of the squared norms.
SLACK = 1e-9


def _lift(x: np.ndarray, most: float) -> np.ndarray:
    squares = (x * x).sum(axis=1)
    return np.concatenate([x, np.sqrt(np.maximum(most - squares, 0))[:, None]], axis=1)


def _distances(lifted: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (lifted * lifted).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None] - 2 * lifted @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _pack(pivots: np.ndarray, most: float, rows: int, query: bool):
    """Blocks of (ids, vectors, distances to the pivots)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                piece = batch.slice(at, rows)
                ids = piece.column(0).to_numpy()
                x = np.asarray(piece.column(1).flatten()).reshape(len(ids), -1).astype(np.int64)
                flat = x.astype(np.float64)
                lifted = np.concatenate([flat, np.zeros((len(ids), 1))], axis=1) if query else _lift(flat, most)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part * 1_000_003 + made], pa.int64()), *(pa.array([a.tobytes()], pa.binary()) for a in (ids, x, _distances(lifted, pivots)))], names=["block", "ids", "vectors", "table"]
                )
                made += 1

    return run


def _search(k: int, most: float, pivots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Each query's best so far, by its block: what a task has found bounds what later candidates must reach.
        held: dict[int, tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]] = {}

        def told(first: int) -> pa.RecordBatch:
            q_ids, ids, scores = held.pop(first)
            columns = np.repeat(q_ids, [len(x) for x in ids]), np.concatenate(ids), np.concatenate(scores)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                q_ids, q, q_table, c_ids, c, c_table = (np.frombuffer(batch.column(j)[i].as_py(), t) for j, t in enumerate((np.int64, np.int64, np.float64) * 2))
                q, c = q.reshape(len(q_ids), -1), c.reshape(len(c_ids), -1)
                q_table, c_table = q_table.reshape(len(q_ids), pivots), c_table.reshape(len(c_ids), pivots)
                none = np.zeros(0, np.int64)
                _, best_ids, best_scores = held.setdefault(int(q_ids[0]), (q_ids, [none] * len(q_ids), [none] * len(q_ids)))
                for n in range(len(q_ids)):
                    norm = float((q[n].astype(np.float64) ** 2).sum())
                    far = np.abs(c_table - q_table[n]).max(axis=1)
                    bound = (norm + most - far * far) / 2 + SLACK * (norm + most) + 1e-6
                    ids, scores = best_ids[n], best_scores[n]
                    worst = scores[-1] if len(scores) == k else -np.inf
                    order = np.flatnonzero((bound >= worst) & (c_ids != q_ids[n]))
                    order = order[np.argsort(-bound[order], kind="stable")]
                    for at in range(0, len(order), STEP):
                        step = order[at : at + STEP]
                        if bound[step[0]] < worst:
                            break
                        ids, scores = np.concatenate([ids, c_ids[step]]), np.concatenate([scores, c[step] @ q[n]])
                        best = np.lexsort((ids, -scores))[:k]
                        ids, scores = ids[best], scores[best]
                        worst = scores[-1] if len(scores) == k else -np.inf
                    best_ids[n], best_scores[n] = ids, scores
                if len(held) > HELD_BLOCKS:
                    yield told(next(iter(held)))
        while held:
            yield told(next(iter(held)))

    return run


def pivot_topk(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """The k best candidates of each query: query_id, rank (from 1), vec_id, score.

    Components become floor(scale * x); queries are the vectors whose identifier is divisible by
    ``every``, candidates all others than the query itself, the score is the integer inner product and
    ties go to the smaller identifier. Vectors that are null or empty, hold a null or non-finite component,
    or have a null identifier take no part. Rows repeated with one identifier count once, by their
    smallest vector. A query meets candidates of its own length only; with fewer than k all are
    returned. An empty table, or one without queries, gives no rows; other columns are ignored.

    Integers are exact in 64 bits. What reaches the driver is one length, one norm and PIVOTS vectors for each length.
    """
    x = F.col(vector_col)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & (F.size(x) > 0) & ~bad)
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), whole.alias("x")).groupBy("vec_id").agg(F.min("x").alias("x"))
    rows = materialize(rows, "vectors")
    norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    lengths = rows.groupBy(F.size("x").alias("length")).agg(F.max(norm).alias("most"), F.count(F.lit(1)).alias("n")).toPandas()
    parts = []
    for length, most, n in lengths.itertuples(index=False):
        groups = int(n) // CANDIDATES + 1  # about a block of candidates each
        own = rows.filter(F.size("x") == int(length))
        chosen = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).select("x").toPandas()["x"]
        pivots = _lift(np.array(chosen.tolist(), np.float64), most)
        blocks = "block long, ids binary, vectors binary, table binary"
        table = own.select("vec_id", "x").mapInArrow(_pack(pivots, most, CANDIDATES, False), blocks)
        asked = own.filter(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "x").mapInArrow(_pack(pivots, most, QUERIES, True), blocks)
        table = table.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int")).drop("block")
        asked = asked.drop("block").toDF("q_ids", "q_vectors", "q_table").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        both = asked.join(table, "g").select("q_ids", "q_vectors", "q_table", "ids", "vectors", "table")
        parts.append(both.mapInArrow(_search(k, float(most), len(pivots)), "query_id long, vec_id long, score long"))
    if not parts:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).filter("false")
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    # k rows of each task meet here, so a query's rows number k for each block of candidates at most.
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
