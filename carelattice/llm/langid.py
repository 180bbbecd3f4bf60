"""Language identification with spans: scripts narrow the languages, Viterbi labels the words.

Each word gets a score for each language from hashed letter pairs and triples (naive Bayes, counted
over all labelled documents). A word's script leaves only the languages that are written in it.
Viterbi then finds the best labelling of a text's words under a penalty for each switch; a
document's language is the one with the most letters in its spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import letters, textcodes

#: Buckets of letter triples; pairs have as many after them, and counts of scripts follow.
BUCKETS = 1 << 16
#: Log-odds that a switch of language costs, and the share of a language's letters from which a script is its own.
PENALTY, SCRIPT_SHARE = 12.0, 0.001
BLOCK = 256
U = np.uint64


@dataclass(frozen=True)
class Model:
    """Log-probabilities of each bucket in each language, and the languages each script leaves."""

    languages: list[str]
    weights: np.ndarray
    allowed: np.ndarray


def _grams(codes: np.ndarray, offsets: np.ndarray):
    """Letter positions, their triple and pair buckets, and the words' starts and ends among all positions."""
    letter, lower, _ = letters.tables()
    inside = letter[codes]
    starts, ends, first = textcodes.runs(inside, offsets)
    c = np.zeros(len(codes) + 2, U)
    c[1:-1] = np.where(inside, lower[codes], 0)
    at = np.flatnonzero(inside)
    before, here, after = c[at], c[at + 1], c[at + 2]
    cut = np.zeros(len(codes) + 1, bool)
    cut[offsets] = True
    before[cut[at]] = 0
    after[cut[at + 1]] = 0
    pair = (before << U(21)) | here
    triple = textcodes.mix((pair << U(21)) ^ (after * U(0x9E3779B97F4A7C15)))
    return at, (triple & U(BUCKETS - 1)).astype(np.int64), (textcodes.mix(pair) & U(BUCKETS - 1)).astype(np.int64) + BUCKETS, starts, ends, first


_COUNTS = "lang string, bucket int, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    script = letters.tables()[2]
    sums: dict[str, np.ndarray] = {}
    for batch in textcodes.pieces(batches):
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for at, codes, offsets in textcodes.slices(texts):
            where, triples, pairs, *_ = _grams(codes, offsets)
            doc = np.searchsorted(offsets, where, "right") - 1
            names, place = np.unique(np.array(langs[at : at + len(offsets) - 1], object).astype(str), return_inverse=True)
            lang = place[doc]
            width = 2 * BUCKETS + len(letters.SCRIPTS)
            found = np.zeros(len(names) * width, np.int64)
            for bucket in (triples, pairs, script[codes[where]].astype(np.int64) + 2 * BUCKETS):
                found += np.bincount(lang * width + bucket, minlength=len(found))
            for name, part in zip(names.tolist(), found.reshape(len(names), width), strict=True):
                sums[name] = sums[name] + part if name in sums else part
    for name, total in sums.items():
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["lang", "bucket", "n"])


def train(labelled: DataFrame) -> Model:
    """A model from ``labelled(lang, text)``, all rows and whole texts. The counts are summed by Spark;
    what reaches the driver is one number for each bucket and language, however large the table."""
    spread = labelled.select(F.col("lang").cast("string"), "text").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sums = spread.mapInArrow(_count, _COUNTS).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    lang, place = np.unique(np.array(sums.column("lang").to_pylist(), object).astype(str), return_inverse=True)
    counts = np.zeros((2 * BUCKETS + len(letters.SCRIPTS), len(lang)), np.float64)
    if len(lang):
        counts[sums.column("bucket").to_numpy(), place] = sums.column("n").to_numpy()
    weights = np.zeros((2 * BUCKETS, len(lang)), np.float32)
    for a in (0, BUCKETS):
        part = counts[a : a + BUCKETS] + 0.05
        logs = np.log(part / part.sum(axis=0))
        weights[a : a + BUCKETS] = logs - logs.mean(axis=1, keepdims=True) if len(lang) else 0
    used = counts[2 * BUCKETS :]
    allowed = used >= SCRIPT_SHARE * np.maximum(used.sum(axis=0), 1)
    allowed[~allowed.any(axis=1)] = True
    return Model(lang.tolist(), weights, allowed)


def viterbi(scores: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Best states of a chain: scores (words, states); penalty[i] is what a switch before word i costs.

    Texts follow one another in one chain with penalty 0 where a text begins. The chain is cut into
    blocks that are walked side by side: first for every entering state, then with the right one.
    """
    n, states = scores.shape
    if not n or states < 2:
        return np.zeros(n, np.int64)
    blocks = -(-n // BLOCK)
    s = np.zeros((blocks * BLOCK, states))
    s[:n] = scores
    p = np.zeros(blocks * BLOCK)
    p[:n] = penalty
    s, p = s.reshape(blocks, BLOCK, states), p.reshape(blocks, BLOCK)
    value = np.where(np.eye(states, dtype=bool), 0.0, -1e18)[None].repeat(blocks, 0)
    for t in range(BLOCK):
        value = np.maximum(value, value.max(axis=2, keepdims=True) - p[:, t, None, None]) + s[:, t, None, :]
    enter = np.zeros((blocks, states))
    for b in range(1, blocks):
        enter[b] = (enter[b - 1][:, None] + value[b - 1]).max(axis=0)
        enter[b] -= enter[b].max()
    back = np.empty((BLOCK, blocks, states), np.int16)
    own = np.arange(states, dtype=np.int16)
    for t in range(BLOCK):
        best = enter.max(axis=1, keepdims=True) - p[:, t, None]
        stay = enter >= best
        back[t] = np.where(stay, own, enter.argmax(axis=1).astype(np.int16)[:, None])
        enter = np.where(stay, enter, best) + s[:, t]
    rows = np.arange(blocks)
    through = own[None].repeat(blocks, 0)
    for t in range(BLOCK - 1, -1, -1):
        through = np.take_along_axis(back[t], through, 1)
    last = np.empty(blocks, np.int16)
    state = int(enter[-1].argmax())
    for b in range(blocks - 1, -1, -1):
        last[b] = state
        state = int(through[b, state])
    out = np.empty((BLOCK, blocks), np.int64)
    for t in range(BLOCK - 1, -1, -1):
        out[t] = last
        last = back[t][rows, last]
    return out.T.reshape(-1)[:n]


def label_words(codes: np.ndarray, offsets: np.ndarray, model: Model):
    """Starts, ends, each text's first word, and the language of each word."""
    at, triples, pairs, starts, ends, first = _grams(codes, offsets)
    if not len(starts):
        return starts, ends, first, np.zeros(0, np.int64)
    each = model.weights[triples] + model.weights[pairs]
    scores = 0.5 * np.add.reduceat(each, np.searchsorted(at, starts), axis=0).astype(np.float64)
    scores[~model.allowed[letters.tables()[2][codes[starts]]]] -= 1e4
    penalty = np.full(len(starts), PENALTY)
    penalty[first[:-1][first[:-1] < len(starts)]] = 0.0
    return starts, ends, first, viterbi(scores, penalty)


def _predict(spark_model, spans: bool, text_at: int = -1):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = spark_model.value
        for batch in textcodes.pieces(batches):
            texts = batch.column(text_at % batch.num_columns).to_pylist()
            for at, codes, offsets in textcodes.slices(texts):
                docs = len(offsets) - 1
                starts, ends, first, label = label_words(codes, offsets, model)
                doc = np.repeat(np.arange(docs), np.diff(first))
                kept = batch.slice(at, docs)
                if spans:
                    new = np.ones(len(label), bool)
                    new[1:] = (label[1:] != label[:-1]) | (doc[1:] != doc[:-1])
                    begin = np.flatnonzero(new)
                    end = np.append(begin[1:], len(label))[: len(begin)] - 1
                    names = pa.array([model.languages[i] for i in label[begin].tolist()], pa.string()) if model.languages else pa.array(["und"] * len(begin), pa.string())
                    where = offsets[doc[begin]]
                    yield pa.RecordBatch.from_arrays([kept.column(0).take(pa.array(doc[begin])), pa.array(starts[begin] - where), pa.array(ends[end] - where), names], names=["doc_id", "start", "end", "lang"])
                    continue
                width = max(1, len(model.languages))
                weight = np.bincount(doc * width + label, ends - starts, docs * width).reshape(docs, width)
                total = weight.sum(axis=1)
                some = (total > 0) & bool(model.languages)
                best = weight.argmax(axis=1)
                lang = [model.languages[b] if s else "und" for b, s in zip(best.tolist(), some.tolist(), strict=True)]
                score = np.where(some, weight[np.arange(docs), best] / np.maximum(total, 1), 0.0)
                rest = batch.num_columns if text_at >= 0 else -1
                yield pa.RecordBatch.from_arrays([*kept.columns[:rest], pa.array(lang, pa.string()), pa.array(score)], names=[*batch.schema.names[:rest], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """``docs`` with columns ``keep``, lang_pred and score, the share of letters in spans of lang_pred.

    A text that is null or has no letter, or a model without languages, gives ``und`` and score 0.
    Ties go to the smaller language name. Scores never see anything but the text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep) if text_col in keep else docs.select(*keep, F.col(text_col).alias("_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]), "lang_pred string", "score double"])
    return rows.mapInArrow(_predict(shared, False, keep.index(text_col) if text_col in keep else -1), schema)


def language_spans(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of one language: doc_id, start and end (code points, end excluded), lang; none where there is no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text")).mapInArrow(_predict(shared, True), "doc_id long, start long, end long, lang string")


def fold(id_col: str, parts: int):
    """crc32 of the identifier as text, modulo ``parts``; null for a null identifier."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % parts


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: int = 2, parts: int = 4) -> DataFrame:
    """Predict every row's language: doc_id, held_out, lang_pred, score.

    Learns from the rows with a language whose fold isn't ``held_out``; rows with a null identifier
    have no fold, are not learned from and not held out. Repeated rows are learned from and
    predicted each. An empty table gives no rows; other columns are ignored.
    """
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    model = train(named.filter(fold("doc_id", parts) != held_out).select("lang", "text"))
    rows = named.select("doc_id", F.coalesce(fold("doc_id", parts) == held_out, F.lit(False)).alias("held_out"), "text")
    return predict(rows, model, ["doc_id", "held_out"])
