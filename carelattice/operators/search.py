"""Filtered vector search with threshold and relaxation, and the vector table's upkeep."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors

THRESHOLD, TOP_K, LARGEST_K = 0.65, 5, 20
#: Points and queries that meet in a group, queries multiplied at once, and pairs scored at once.
GROUP_POINTS, GROUP_QUERIES, STEP, PAIRS = 4096, 2048, 256, 1 << 16
#: Norms whose squares and products stay far from the ends of double precision.
LEAST_NORM, MOST_NORM = 1e-140, 1e140


def payload_filter(points: DataFrame, **equal: str | None) -> DataFrame:
    """All given metadata fields must match; a null field never does. None isn't a filter."""
    for name, value in equal.items():
        if value is not None:
            points = points.filter(F.col(name) == value)
    return points


def well_formed(points: DataFrame) -> DataFrame:
    """Without rows that lack content or metadata."""
    return points.filter(F.col("content").isNotNull() & F.col("metadata").isNotNull())


def top_k(points: DataFrame, query: list[float], k: int = TOP_K, threshold: float = THRESHOLD, id_col: str = "point_id", vector_col: str = "vector") -> DataFrame:
    """The k most similar points to one vector, at or above the threshold.

    The threshold grows with the sort key, so it filters before the limit with the same result; the
    plan is one scan with a top-k in each task. Unlike sizes score null and never pass.
    """
    if not 1 <= k <= LARGEST_K:
        raise ValueError(f"k must be 1 to {LARGEST_K}")
    vector = F.array(*(F.lit(float(x)) for x in query))
    scored = points.withColumn("score", vectors.cosine(F.col(vector_col), vector)).filter(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), id_col).limit(k)


def _by_size(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors for each number of components; vectors that are null or empty or hold a null score null and are left out."""
    column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    sizes = column.value_lengths().fill_null(0).to_numpy()
    flat, starts = column.flatten(), np.cumsum(sizes) - sizes
    if flat.null_count:
        owner = np.repeat(np.arange(len(sizes)), sizes)
        sizes = np.where(np.isin(np.arange(len(sizes)), owner[flat.is_null().to_numpy(zero_copy_only=False)]), 0, sizes)
    values = flat.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False)
    found = {}
    for size in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == size)
        found[int(size)] = rows, values[starts[rows][:, None] + np.arange(size)]
    return found


def _products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The inner product of each row of both, added in the order of the components as ``vectors.dot`` does, so with the same bits."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j] * y[:, j]
    return total


def _near(p: np.ndarray, q: np.ndarray, same: Callable[[np.ndarray], np.ndarray], k: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (p, q) of unit vectors among which are the k best of each q in its topic and, unless one of those passes for sure, outside.

    The products are in single precision, and whatever their error leaves open is among the pairs.
    """
    slack = (p.shape[1] + 8) * 2.0**-23
    p, q = p.astype(np.float32), q.astype(np.float32)
    for at in range(0, len(q), STEP):
        scores, strict, rows = q[at : at + STEP] @ p.T, same(np.arange(at, min(at + STEP, len(q)))), np.arange(at, min(at + STEP, len(q)))
        sure = (strict & (scores >= threshold + slack)).any(axis=1)
        for s, of, n in ((scores, strict, rows), (scores[~sure], ~strict[~sure], rows[~sure])):
            low = np.full(len(s), threshold - slack)
            if s.shape[1] > k:
                low = np.maximum(low, np.partition(np.where(of, s, -np.inf), -k, axis=1)[:, -k] - 2 * slack)
            found, point = np.nonzero(of & (s >= low[:, None]))
            yield point, n[found]


def _odd(p: np.ndarray, q: np.ndarray, p_odd: np.ndarray, q_odd: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (p, q) that score something and hold a vector whose norm is not a common number, given the norms."""
    for at in np.flatnonzero(q_odd | p_odd.any()):
        point = np.flatnonzero((p_odd | q_odd[at]) & ~(p * q[at] <= 0))
        yield point, np.full(len(point), at)


def _group_best(k: int, threshold: float, names: list[str]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best points of each query in a group, of its topic and of others. Scores and their order are those of ``vectors.cosine`` and of SQL: NaN comes first, ties go by place."""

    def run(points: pa.Table, queries: pa.Table) -> pa.Table:
        codes = pa.chunked_array([*points["topic"].chunks, *queries["topic"].chunks], pa.string()).combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()
        topics, asked, place = codes[: len(points)], codes[len(points) :], points["place"].to_numpy()
        by_size, parts = _by_size(points["vector"]), []
        for size, (q_rows, q) in _by_size(queries["vector"]).items():
            if size not in by_size:
                continue
            p_rows, p = by_size[size]
            with np.errstate(all="ignore"):
                p_norm, q_norm = np.sqrt(_products(p, p)), np.sqrt(_products(q, q))
                p_good, q_good = (np.flatnonzero((n > LEAST_NORM) & (n < MOST_NORM)) for n in (p_norm, q_norm))
                p_odd, q_odd = ~np.isin(np.arange(len(p)), p_good), ~np.isin(np.arange(len(q)), q_good)
                same = lambda n: (asked[q_rows[q_good[n]]][:, None] == topics[p_rows[p_good]]) & (topics[p_rows[p_good]] >= 0)  # noqa: B023, E731
                near = _near(p[p_good] / p_norm[p_good][:, None], q[q_good] / q_norm[q_good][:, None], same, k, threshold)
                pairs = [(p_good[i], q_good[n]) for i, n in near] + list(_odd(p_norm, q_norm, p_odd, q_odd))
                point, query = (np.concatenate([x[i] for x in pairs]) if pairs else np.zeros(0, int) for i in range(2))
                dots = [_products(p[point[at : at + PAIRS]], q[query[at : at + PAIRS]]) for at in range(0, len(point), PAIRS)]
                score = np.concatenate([np.zeros(0), *dots]) / (p_norm[point] * q_norm[query])
            passed = ~(score < threshold)
            parts.append((p_rows[point[passed]], q_rows[query[passed]], score[passed]))
        point, query, score = (np.concatenate([np.zeros(0, int if i < 2 else float), *(x[i] for x in parts)]) for i in range(3))
        strict = (asked[query] == topics[point]) & (topics[point] >= 0)
        order = np.lexsort((place[point], -np.where(np.isnan(score), np.inf, score), strict, query))
        run = query[order] * 2 + strict[order]
        first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, int)
        order = order[np.arange(len(run)) - np.repeat(first, np.diff([*first, len(run)])) < k]
        return pa.table([queries["id"].take(pa.array(query[order])), points["id"].take(pa.array(point[order])), pa.array(score[order]), pa.array(strict[order])], names=names)

    return run


def relaxed_top_k(
    queries: DataFrame, points: DataFrame, topic: str, k: int = TOP_K, threshold: float = THRESHOLD,
    query_id: str = "query_id", point_id: str = "point_id", query_vector: str = "query_vector", vector_col: str = "vector",
) -> DataFrame:
    """For each query the k best points of its topic, or, if none passes the threshold, of any topic.

    Columns: query, point, score, rank, strict. Every group of queries meets every group of points (as many as they
    need), a group of both at a time, whose products are one matrix in single precision; the pairs that these leave open are scored by ``vectors.cosine``'s
    steps in double precision. At most 2 k rows a query leave a group, since the ranking is limited before
    it is shuffled. All pairs are compared, so the work grows with queries times points.
    """
    kind = queries.select(F.col(topic)).union(points.select(F.col(topic))).schema[0].dataType
    about = lambda own, vector: [F.col(own).alias("id"), F.col(topic).cast(kind).cast("string").alias("topic"), F.col(vector).alias("vector")]
    groups, batches = points.count() // GROUP_POINTS + 1, queries.count() // GROUP_QUERIES + 1
    dealt = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = F.row_number().over(Window.partitionBy("g").orderBy("id"))
    placed = points.select(*about(point_id, vector_col)).withColumn("g", dealt(groups)).withColumn("place", place).withColumn("h", every(batches))
    ask = queries.select(*about(query_id, query_vector)).withColumn("h", dealt(batches)).withColumn("g", every(groups))
    kinds = [queries.schema[query_id].dataType, points.schema[point_id].dataType, T.DoubleType(), T.BooleanType()]
    names = [query_id, point_id, "score", "strict"]
    out = T.StructType([T.StructField(n, t) for n, t in zip(names, kinds, strict=True)])
    scored = placed.groupBy("g", "h").cogroup(ask.groupBy("g", "h")).applyInArrow(_group_best(k, threshold, names), out)
    best = Window.partitionBy(query_id, "strict").orderBy(F.desc("score"), point_id)
    kept = scored.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k)
    # What is left is 2 k rows a query at most.
    per_query = Window.partitionBy(query_id)
    kept = kept.withColumn("has_strict", F.max("strict").over(per_query)).filter(F.col("strict") | ~F.col("has_strict"))
    ranked = kept.withColumn("rank", F.row_number().over(per_query.orderBy(F.desc("score"), point_id)))
    return ranked.filter(F.col("rank") <= k).select(query_id, point_id, "score", "rank", F.col("has_strict").alias("strict"))


def upsert(table: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Old and new rows together, the highest version of each key only; of equal versions a new row, and a version before none."""
    both = table.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    rank = F.struct(F.col(version).isNotNull(), F.col(version), "_new")
    newest = both.groupBy(key).agg(F.max_by(F.struct(*table.columns), rank).alias("_row"))
    return newest.select("_row.*")


def delete_where(table: DataFrame, gone: Column) -> DataFrame:
    """Rows that don't meet ``gone``; a null answer keeps the row."""
    return table.filter(~F.coalesce(gone, F.lit(False)))


def delete_ids(table: DataFrame, ids: list[str], key: str = "point_id") -> DataFrame:
    """Without the rows of the given identifiers, which are stripped; blank and repeated ones don't matter."""
    from .relational import in_values

    return in_values(table, key, list(dict.fromkeys(i.strip() for i in ids if i.strip())), keep=False)


def obsolete_ids(before: DataFrame, after: DataFrame, key: str = "point_id") -> DataFrame:
    """Identifiers that the new snapshot no longer has."""
    return before.select(key).distinct().join(after.select(key), key, "left_anti")


def size_report(points: DataFrame, size: int, vector_col: str = "vector") -> DataFrame:
    """One row: how many vectors there are, and how many don't have ``size`` components."""
    ok = vectors.has_size(F.col(vector_col), size)
    return points.agg(F.count(F.lit(1)).alias("vectors"), F.count_if(~ok).alias("wrong_size"))
