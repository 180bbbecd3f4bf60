"""Whitening of embeddings with eigenvectors refined in mixed precision.

The covariance of the distinct vectors is summed in blocks by the tasks. Its eigenvectors are first
taken in float32; Ogita-Aishima iterations then correct them with a few matrix products in a higher
precision each, which converges quadratically while eigenvalues lie apart. Where they lie closer than the
error of the vectors, the matrix restricted to the cluster's vectors and shifted by the cluster's mean is
solved anew, so that the small differences have all digits of the solver, and its vectors turn the cluster's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize

#: Largest number of dimensions: the covariance, its square in doubles, is on the driver and in each task.
MOST_DIMENSIONS = 4096
#: Matrices of sums that one group adds up, and rows of a covariance that stand together in one.
FAN_IN, SUM_ROWS = 64, 64
#: An eigenvalue below this share of the trace is no variance.
LEAST_SHARE = 1e-13
EXACT = np.longdouble


def _products(a: np.ndarray, x: np.ndarray, own: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """R and S of the vectors ``own``, the columns ``wanted`` of x: their lack of orthonormality and the matrix in the vectors' basis."""
    eye = np.zeros((len(a), len(wanted)), a.dtype)
    eye[wanted, np.arange(len(wanted))] = 1
    s = x.T @ (a @ own)
    # Rounding makes S uneven; over a small gap that would cost orthonormality.
    s[wanted] = (s[wanted] + s[wanted].T) / 2
    return eye - x.T @ own, s


def _correction(r: np.ndarray, s: np.ndarray, d: np.ndarray, wanted: np.ndarray, near: float) -> np.ndarray:
    """Ogita and Aishima's E for the columns ``wanted``: (s_ij + d_j r_ij) / (d_j - d_i), or r_ij / 2 within a cluster and on the diagonal."""
    gap = d[wanted][None, :] - d[:, None]
    apart = np.abs(gap) > near
    return np.where(apart, (s + d[wanted][None, :] * r) / np.where(apart, gap, 1), r / 2)


def _orthonormal(x: np.ndarray) -> np.ndarray:
    """Nearly orthonormal columns, after one Newton step towards orthonormal ones."""
    return x @ (1.5 * np.eye(x.shape[1], dtype=x.dtype) - 0.5 * (x.T @ x))


def refine(matrix: np.ndarray, vectors: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling), unit eigenvectors, and the distance below which eigenvalues are a cluster, of a symmetric matrix in
    double precision, from approximate ``vectors``.

    A round computes R = I - X'X, S = X'AX and d_i = s_ii / (1 - r_ii), and X becomes X + XE. Clusters are turned by a solve of
    their own (``_split``) before the next round. Rounds end when the correction is rounding noise or no longer shrinks.
    """
    x, every = vectors.astype(np.float64), np.arange(len(matrix))
    last = np.inf
    tiny = near = 4 * len(matrix) * float(np.finfo(np.float64).eps)
    for _ in range(rounds):
        r, s = _products(matrix, x, x, every)
        d = np.diag(s) / (1 - np.diag(r))
        near = max(tiny * np.abs(d).max(), 2 * (np.linalg.norm(s - np.diag(d), 2) + np.abs(d).max() * np.linalg.norm(r, 2)))
        e = _correction(r, s, d, every, near)
        x = _split(matrix, x + x @ e, d, near)
        step = np.abs(e).max()
        if step <= tiny or step >= last:
            break
        last = step
    x = _orthonormal(x)
    d = (x * (matrix @ x)).sum(0)
    order = np.argsort(-d, kind="stable")
    return d[order], x[:, order], near


def polish(matrix: np.ndarray, values: np.ndarray, vectors: np.ndarray, wanted: int, near: float) -> tuple[np.ndarray, np.ndarray]:
    """The first ``wanted`` eigenvalues and vectors after two more corrections in extended precision, of these columns only."""
    a, x, columns, d = matrix.astype(EXACT), vectors.astype(EXACT), np.arange(wanted), values.astype(EXACT)
    for _ in range(2):
        r, s = _products(a, x, x[:, columns], columns)
        d[columns] = s[columns, columns] / (1 - r[columns, columns])
        x[:, columns] += x @ _correction(r, s, d, columns, near)
    own = _orthonormal(x[:, columns])
    return (own * (a @ own)).sum(0), own


def _split(a: np.ndarray, x: np.ndarray, d: np.ndarray, near: float) -> np.ndarray:
    """``x`` with the vectors of each cluster of eigenvalues turned to those of the cluster's own, shifted matrix."""
    order = np.argsort(d, kind="stable")
    breaks = np.flatnonzero(np.diff(d[order]) > near) + 1
    out = x.copy()
    for cluster in np.split(order, breaks):
        if len(cluster) < 2:
            continue
        own = x[:, cluster]
        own = _orthonormal(own)
        middle = d[cluster].mean()
        small = own.T @ (a @ own - middle * own)
        size = np.abs(small).max()
        if size > 0:
            # What is left after the shift has its own scale, so doubles resolve differences far below the matrix's.
            own = own @ np.linalg.eigh(((small + small.T) / (2 * size)).astype(np.float64))[1].astype(a.dtype)
        out[:, cluster] = own
    return out


def eigen(covariance: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors, to double precision: float32 vectors, rounds in double,
    and a last correction in extended precision where the machine has it. What rounding makes negative is 0."""
    scale = np.abs(covariance).max() if covariance.size else 0
    if not scale:
        return np.zeros(wanted), np.eye(len(covariance))[:, :wanted]
    matrix = covariance / scale
    start = np.linalg.eigh(matrix.astype(np.float32))[1]
    values, vectors, near = refine(matrix, start)
    values, vectors = polish(matrix, values, vectors, wanted, near)
    return np.maximum(values, 0).astype(np.float64) * scale, vectors.astype(np.float64)


def _whole(vector: Column) -> Column:
    """floor(256 x) of each component, null unless the vector has components and all are finite."""
    ok = (F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    return F.when(ok, F.transform(vector, lambda c: F.floor(c.cast("double") * 256).cast("long")))


def _flat(column: pa.Array, size: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, size)


def _outer_sums(mean: np.ndarray, turn: np.ndarray | None = None) -> Callable:
    """Sums of the products of a partition's centred (and turned) vectors, a row for each ``SUM_ROWS`` rows of the matrix."""
    size = len(mean) if turn is None else turn.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                x = _flat(batch.column(0).slice(at, 2048), len(mean)) - mean
                x = x if turn is None else x @ turn
                total += x.T @ x
        rows = [total[i : i + SUM_ROWS].reshape(-1) for i in range(0, size, SUM_ROWS)]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([part] * len(rows), pa.int32()), pa.array(rows, pa.list_(pa.float64()))], names=["at", "part", "sums"])

    return run


_SUMS = "at int, part int, sums array<double>"


def _added(key: tuple, table: pa.Table) -> pa.Table:
    """Sums in the order of their parts, so that reruns add alike."""
    table = table.sort_by("part")
    whole = np.asarray(table["sums"].combine_chunks().flatten()).reshape(table.num_rows, -1)
    total = np.zeros(whole.shape[1])
    for row in whole:
        total += row
    return pa.table({"at": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int32()), "sums": pa.array([total], pa.list_(pa.float64()))})


def _matrix(vectors: DataFrame, mean: np.ndarray, turn: np.ndarray | None = None) -> np.ndarray:
    """The sum over ``vectors(x)`` of the products of centred vectors. At most ``FAN_IN`` partial sums meet in one group."""
    sums = materialize(vectors.select("x").mapInArrow(_outer_sums(mean, turn), _SUMS), "products")
    parts = sums.agg(F.max("part")).first()[0] + 1
    while parts > 1:
        sums = materialize(sums.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("at", "part").applyInArrow(_added, _SUMS), "products")
        parts = -(-parts // FAN_IN)
    return np.concatenate([np.array(r.sums) for r in sums.orderBy("at").collect()]).reshape(len(mean) if turn is None else turn.shape[1], -1)


def _projected(n: int, sums: list[int], mean: np.ndarray, axes: np.ndarray, roots: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                piece = batch.slice(at, 2048)
                x = _flat(piece.column(1), len(sums))
                most = max(map(abs, (int(x.min()), int(x.max())))) * n + max(map(abs, sums))
                # In machine numbers where no sum can overflow, else in Python's.
                kind = np.int64 if most * most * len(sums) < 2**63 else object
                deviation = ((n * x.astype(kind) - np.array(sums, kind)) ** 2).sum(1)
                whitened = ((x - mean) @ axes / np.where(roots > 0, roots, np.nan)).tolist()
                found = [[None if v != v else v for v in row] for row in whitened]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(map(str, deviation.tolist()), pa.string()), pa.array(found, pa.list_(pa.float64()))], names=["vec_id", "deviation", "whitened"])

    return run


def whiten(vectors: DataFrame, most: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each vector and its first ``most`` components.

    Vectors enter as x = floor(256 c). The fit list is each distinct x once: ``n`` of them, with sums S by dimension; all
    covariances are over it. ``deviation`` is the sum of (n x - S)^2, exact (decimal; null beyond 38 digits), ``whitened`` the
    centred x on the component's unit vector over the root of its eigenvalue, ``explained`` that eigenvalue's share of the
    trace, and ``identity_error`` the largest deviation of whitened's covariance from the identity.

    Null and empty vectors, vectors with null or non-finite components, and vectors of another size than the commonest one
    (of equally common ones the largest) take no part. A component without variance has whitened null and explained 0 and
    doesn't count in identity_error; vectors of fewer dimensions have fewer components. Equal vectors and repeated rows have a
    row each; a null vec_id stays null. No vectors, no rows; other columns are ignored. ValueError beyond ``MOST_DIMENSIONS``.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), _whole(F.col(vector_col)).alias("x")).filter(F.col("x").isNotNull())
    out = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    size = rows.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).limit(1).collect()
    if not size:
        return spark.createDataFrame([], out)
    if (size := size[0]["size"]) > MOST_DIMENSIONS:
        raise ValueError(f"vectors have {size} dimensions; {MOST_DIMENSIONS} at most")
    rows = rows.filter(F.size("x") == size)
    fit = materialize(rows.select("x").distinct(), "distinct-vectors")
    sums = fit.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(F.sum(F.col("c").cast("decimal(19,0)")).alias("s"), F.count(F.lit(1)).alias("n")).orderBy("at").collect()
    n, total = sums[0]["n"], [int(r["s"]) for r in sums]
    mean = np.array([s / n for s in total])
    covariance = _matrix(fit, mean) / n
    values, axes = eigen(covariance, min(most, size))
    trace = float(np.trace(covariance))
    values = np.where(values > LEAST_SHARE * trace, values, 0.0)
    roots = np.sqrt(values)
    real = np.flatnonzero(roots)
    error = float(np.abs(_matrix(fit, mean, axes[:, real] / roots[real]) / n - np.eye(len(real))).max()) if len(real) else 0.0
    explained = F.array(*(F.lit(float(v / trace) if trace else 0.0) for v in values))
    found = rows.select("vec_id", "x").mapInArrow(_projected(n, total, mean, axes, roots), "vec_id long, deviation string, whitened array<double>")
    found = found.select("vec_id", F.col("deviation").try_cast("decimal(38,0)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return found.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(explained, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )
