"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words, their stems (first four and five letters, since inflection would scatter a
word), pairs of neighbours and pairs with one word between (each once a text), as 64-bit hashes. Training reads a bounded sample of labelled rows; per-coordinate rates and L1 leave
few weights, which are broadcast to score every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import letters, textcodes
from .langid import fold
from .shared import brief_broadcast, brief_shuffles, materialize

#: The bound of the training sample in rows (documented limit of the fit; scoring has none), the shards that
#: learn side by side, their rounds, and the sampled texts that a feature must be in at any size: L1 does the rest.
SAMPLE_ROWS, SHARDS, ROUNDS, LEAST_TEXTS = 12_000, 4, 10, 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 1.0, 0.05
#: Toxic texts are the rarer class; each counts as so many.
TOXIC_WEIGHT = 2.0
U = np.uint64
_PAIR, _SKIP, _STEM = U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25), U(0xC2B2AE3D27D4EB4F)
STEMS = (4, 5)


@dataclass(frozen=True)
class Weights:
    """Sorted feature hashes with their weights, the bias, and a bit table that most other hashes miss."""

    features: np.ndarray
    values: np.ndarray
    bias: float

    def hint(self) -> np.ndarray:
        table = np.zeros(1 << 18, bool)
        table[(self.features & U((1 << 18) - 1)).astype(np.int64)] = True
        return table


def _among(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values if len(known) else np.zeros(len(values), bool)


def features(codes: np.ndarray, offsets: np.ndarray, known: np.ndarray | None = None, pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of all texts of a slice and the text that each is from (repeats included).

    With ``known`` (sorted word hashes) only pairs of two known words are made.
    """
    letter, lower, _ = letters.tables()
    starts, ends, first = textcodes.runs(letter[codes] | ((codes >= 48) & (codes <= 57)), offsets)
    h = textcodes.span_hashes(lower[codes], starts, ends)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    near, far = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    if known is not None:
        use = _among(known, h)
        near, far = near & use[1:] & use[:-1], far & use[2:] & use[:-2]
    stems, owners = [], []
    for length in STEMS:
        some = ends - starts > length
        stems.append(textcodes.mix(textcodes.span_hashes(lower[codes], starts[some], starts[some] + length) ^ _STEM))
        owners.append(doc[some])
    if not pairs:
        return np.concatenate((h, *stems)), np.concatenate((doc, *owners))
    pair = textcodes.mix(h[:-1] * _PAIR + h[1:])[near]
    skip = textcodes.mix((h[:-2] ^ _SKIP) * _SKIP + h[2:])[far]
    return np.concatenate((h, pair, skip, *stems)), np.concatenate((doc, doc[:-1][near], doc[:-2][far], *owners))


def _sets(texts: list[str | None], known: np.ndarray | None = None, pairs: bool = True) -> Iterator[np.ndarray]:
    for _, codes, offsets in textcodes.slices(texts):
        f, doc = features(codes, offsets, known, pairs)
        order = np.argsort(doc, kind="stable")
        f, bounds = f[order], np.searchsorted(doc[order], np.arange(len(offsets)))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield np.unique(f[a:b])


def _frequencies(words):
    """In how many texts each feature is; without ``words`` of single words and stems, with it of all features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words.value if words is not None else None
        for batch in textcodes.pieces(batches):
            found = list(_sets(batch.column("text").to_pylist(), known, known is not None))
            f, n = np.unique(np.concatenate(found) if found else np.zeros(0, U), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(f.view(np.int64)), pa.array(n.astype(np.int64))], names=["feature", "n"])

    return run


def _encode(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: np.ndarray = vocabulary.value
        for batch in textcodes.pieces(batches):
            places = []
            for f in _sets(batch.column("text").to_pylist()):
                at = np.searchsorted(known, f)
                at[at == len(known)] = 0
                places.append(at[known[at] == f] if len(known) else at[:0])
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("toxic"), pa.array(places, pa.list_(pa.int32()))], names=["shard", "toxic", "places"])

    return run


def _descend(state):
    """One pass of FTRL-proximal over each shard from the shared state; returns what each has changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z0, n0 = state.value
        shards: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            lists = batch.column("places")
            flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            for i, (shard, toxic) in enumerate(zip(batch.column("shard").to_pylist(), batch.column("toxic").to_pylist(), strict=True)):
                z, n = shards.setdefault(shard, (z0.copy(), n0.copy()))
                at = np.append(flat[ends[i] : ends[i + 1]], len(z) - 1).astype(np.int64)
                w = weights_of(z[at], n[at])
                g = (1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - toxic) * (TOXIC_WEIGHT if toxic else 1.0)
                sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
                z[at] += g - sigma * w
                n[at] += g * g
        for z, n in shards.values():
            some = np.flatnonzero(n != n0)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(z[some] - z0[some]), pa.array(n[some] - n0[some])], names=["place", "dz", "dn"])

    return run


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FTRL's closed form; the last coordinate of a text, the bias, is treated as the others."""
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Weights:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    The sample is the ``sample_rows`` labelled identifiers with the smallest hashes. Shards of it
    learn side by side from one state; what they change at a coordinate is averaged over the shards
    that met it. Driver and tasks hold the features of LEAST_TEXTS sampled texts only.
    """
    spark = docs.sparkSession
    with brief_shuffles(spark):
        chosen = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
        turn = F.xxhash64(F.lit(11), "doc_id")
        chosen = chosen.withColumn("turn", turn).orderBy("turn", "doc_id").limit(sample_rows).withColumn("shard", F.pmod("turn", F.lit(SHARDS)).cast("int"))
        # At most ``sample_rows`` rows of four numbers.
        sample = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").repartition(SHARDS, "shard", "turn"), "toxicity-sample")

        def often(words) -> np.ndarray:
            counts = sample.select("text").mapInArrow(_frequencies(words), "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
            return np.sort(counts.filter(F.col("n") >= LEAST_TEXTS).select("feature").toArrow().column(0).to_numpy().view(U))

        # A pair can only be in that many texts if both its words are.
        with brief_broadcast(spark, often(None)) as words:
            vocabulary = often(words)
        with brief_broadcast(spark, vocabulary) as known:
            encoded = materialize(sample.mapInArrow(_encode(known), "shard int, toxic int, places array<int>"), "toxicity-encoded")
        z, n = np.zeros(len(vocabulary) + 1), np.zeros(len(vocabulary) + 1)
        for _ in range(ROUNDS):
            with brief_broadcast(spark, (z, n)) as state:
                changed = encoded.mapInArrow(_descend(state), "place long, dz double, dn double")
                mean = changed.groupBy("place").agg(F.avg("dz").alias("dz"), F.avg("dn").alias("dn")).toArrow()
            at = mean.column("place").to_numpy()
            z[at] += mean.column("dz").to_numpy()
            n[at] += mean.column("dn").to_numpy()
    w = weights_of(z, n)
    some = np.flatnonzero(w[:-1])
    return Weights(vocabulary[some], w[some], float(w[-1]))


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Weights = shared.value
        hint = model.hint()
        for batch in textcodes.pieces(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            scores = np.zeros(len(texts))
            for start, codes, offsets in textcodes.slices(texts):
                f, doc = features(codes, offsets)
                near = np.flatnonzero(hint[(f & U((1 << 18) - 1)).astype(np.int64)])
                f, doc = f[near], doc[near]
                at = np.searchsorted(model.features, f)
                at[at == len(model.features)] = 0
                hit = model.features[at] == f if len(model.features) else np.zeros(len(f), bool)
                met = np.unique(doc[hit] * len(model.features) + at[hit])
                total = np.bincount(met // max(1, len(model.features)), model.values[met % max(1, len(model.features))], len(offsets) - 1)
                scores[start : start + len(offsets) - 1] = 1 / (1 + np.exp(-np.clip(total + model.bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], names=[*batch.schema.names[:-1], "score", "predicted"])

    return run


def score(docs: DataFrame, model: Weights, keep: list[str], text_col: str = "text") -> DataFrame:
    """``docs`` with columns ``keep``, score (0 to 1) and predicted (1 from 0.5 on); null and empty texts get the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "score double", "predicted int"])
    return rows.mapInArrow(_score(shared), schema)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: int = 0, parts: int = 5) -> DataFrame:
    """Score every row: doc_id, held_out, score, predicted.

    Learns only from labels whose identifier's fold isn't ``held_out``. Null identifiers and labels
    that are neither 0 nor 1 are not learned from; of several labels of one identifier the largest
    counts. Without labels nothing is learned and all scores are 0.5. An empty table
    gives no rows; other columns are ignored.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    marked = labels.select(F.col(id_col).alias("doc_id"), "toxic").filter(fold("doc_id", parts) != held_out)
    model = train(named, marked)
    rows = named.select("doc_id", F.coalesce(fold("doc_id", parts) == held_out, F.lit(False)).alias("held_out"), "text")
    return score(rows, model, ["doc_id", "held_out"])
