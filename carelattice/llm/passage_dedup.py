"""Substring dedup: paragraphs by content, MinHash banding, exact verification, components.

Passages are pasted into the middle of lines, so line breaks don't delimit what repeats. Paragraphs
are cut by content instead: before a word whose hash (with its neighbour's) is the least within
``REACH`` words to either side. The same passage is then cut alike wherever it stands, but for a
few words at its ends. Paragraphs that share a MinHash band are candidates; equal ones are the same
class, others are verified by the exact Jaccard similarity of their five-word shingles, and classes
are clustered by connected components. Runs of consecutive paragraphs that recur in other documents
are the repeated passages.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textcodes
from .graph import components
from .rare_first import rare_pairs
from .shared import materialize

#: Words to either side of a cut; a passage over 50 words holds on average 34 words of whole paragraphs, always some.
REACH = 4
#: Words of a shingle, similarity of paragraphs (percent), wanted recall at it.
K, PERCENT, RECALL = 5, 80, 0.95
#: Words of whole paragraphs in a row from which a run counts as a repeated passage.
RUN_WORDS = 20
U = np.uint64
_SEEDS = [U(0x8CB92BA72F3D8DD7), U(0xB492B66FBE98F273), U(0x9FB21C651E98DF25), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)]


def bands(percent: int = PERCENT, recall: float = RECALL) -> int:
    """Bands of one row each that find a pair of that similarity with probability ``recall``. One row is
    selective enough: two unlike paragraphs rarely share a five-word shingle at all."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - percent / 100)))


def paragraphs(codes: np.ndarray, offsets: np.ndarray, reach: int = REACH):
    """Word hashes, the paragraphs' first words (one more at the end), each paragraph's text, and each text's first word."""
    codes = textcodes.lower_ascii(codes)
    starts, ends, first = textcodes.runs(~textcodes.blank(codes), offsets)
    words, place = textcodes.spans(codes, starts, ends)
    h = textcodes.strong_hashes(words)[place, 0]
    n = len(h)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    follow = np.zeros(n, U)
    follow[:-1] = h[1:]
    mark = textcodes.mix(h * U(3) + textcodes.mix(follow))
    least = np.ones(n, bool)
    for shift in range(1, reach + 1):
        if n > shift:
            same = doc[shift:] == doc[:-shift]
            least[shift:] &= ~same | (mark[shift:] < mark[:-shift])
            least[:-shift] &= ~same | (mark[:-shift] <= mark[shift:])
    # A cut needs its whole surroundings in the text.
    place = np.arange(n) - first[:-1][doc] if n else np.zeros(0, np.int64)
    least &= (place >= reach) & (place + reach < np.diff(first)[doc] if n else True)
    least[first[:-1][np.diff(first) > 0]] = True
    cuts = np.flatnonzero(least)
    return h, np.append(cuts, n), doc[cuts] if n else np.zeros(0, np.int64), first


_SEGMENTS = "doc_id long, start int, n_words int, hash long, bands array<long>"


def _segments(k: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textcodes.pieces(batches):
            for at, codes, offsets in textcodes.slices(batch.column(1).to_pylist()):
                h, cuts, doc, first = paragraphs(codes, offsets)
                size = np.diff(cuts)
                keep = np.flatnonzero(size >= k)
                if not len(keep):
                    continue
                a, b = cuts[:-1][keep], cuts[1:][keep]
                flat = h.tobytes()
                own = np.array([xxhash.xxh3_64_intdigest(flat[8 * i : 8 * j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)], U)
                rolled = textcodes.roll(h, k)
                # Shingles of one paragraph stand together: positions a to b - k.
                spans = np.stack([a, b - k + 1], 1).reshape(-1)
                values = np.append(rolled, U(2**64 - 1))
                keys = np.stack([textcodes.mix(np.minimum.reduceat(textcodes.mix(values ^ seed), spans)[::2] + seed) for seed in _SEEDS[:count]], 1)
                ids = batch.column(0).take(pa.array(at + doc[keep]))
                begin = a - first[:-1][doc[keep]]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * count, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(begin, pa.int32()), pa.array(size[keep], pa.int32()), pa.array(own.view(np.int64)), lists], names=["doc_id", "start", "n_words", "hash", "bands"])

    return run


def _shingles(k: int):
    """Shingle hashes of chosen runs of words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textcodes.pieces(batches, 64):
            texts, chosen, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for at, codes, offsets in textcodes.slices(texts):
                codes = textcodes.lower_ascii(codes)
                starts, ends, first = textcodes.runs(~textcodes.blank(codes), offsets)
                words, place = textcodes.spans(codes, starts, ends)
                h = textcodes.strong_hashes(words)[place, 0]
                for i in range(len(offsets) - 1):
                    for c in chosen[at + i]:
                        a = int(first[i]) + c["start"]
                        out.append((c["hash"], np.unique(textcodes.roll(h[a : a + c["n_words"]], k)).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([s for _, s in out], pa.list_(pa.int64()))], names=["hash", "shingles"])

    return run


def _near(pairs: DataFrame, sample: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose sets of shingles are that similar."""
    both = pairs.join(sample.toDF("a", "x"), "a").join(sample.toDF("b", "y"), "b")
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def _across(pairs: DataFrame, sample: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links between paragraphs of different components, for bands whose members aren't all in their hub's.

    They meet by their rarest shingles; what made a band large comes last there, and is compared on only where a
    paragraph has nothing rarer.
    """
    named = lambda df, name, out: df.join(classes.select(F.col("node").alias(name), F.col("component").alias(out)), name, "left").withColumn(out, F.coalesce(out, name))
    apart = named(named(pairs, "hub", "hub_c"), "hash", "c")
    hubs = apart.filter("c != hub_c").select("hub").distinct()
    # All members that met such a hub, its own component's too: a stray may be near one of these.
    members = apart.join(hubs, "hub").select(F.explode(F.array(F.struct("hash", "c"), F.struct(F.col("hub").alias("hash"), F.col("hub_c").alias("c")))).alias("m")).select("m.*").distinct()
    sets = members.join(sample, "hash").select(F.col("hash").alias("node"), F.lit(0).cast("long").alias("part"), "c", F.col("shingles").alias("tokens"))
    return materialize(_near(materialize(rare_pairs(sets, percent), "paragraph-strays"), sample, percent), "paragraph-links")


def repeated_passages(docs: DataFrame, k: int = K, percent: int = PERCENT, run_words: int = RUN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The passages that recur across documents: doc_id, start_word, n_words, cluster_id, n_docs, kept.

    One row for each run of consecutive repeated paragraphs of a document, of ``run_words`` words or more, cut
    where ``kept`` changes (a part not kept may be shorter; a shorter one kept stays in the text without a row): where it starts (words from 0, split at ``[\\x20\\x09-\\x0D]+``), how long it is, the smallest doc_id of the
    components its paragraphs are in, the most documents that one of these is in,
    and whether this document keeps it, being the first of each of its components, or else the first of none. Documents without repeated passages
    have no row. Repeats within one document alone don't count. Null and empty texts, texts of fewer
    than ``k`` words and null identifiers take no part; rows with one doc_id count as one document. An
    empty table gives no rows; other columns are ignored.

    Equal paragraphs always meet; others are compared where they share a band, with recall ``RECALL`` at
    the threshold: with the band's first class, and then, where they still lie in other components,
    across components by their rarest shingles, so very common shingles don't pair all that hold them.
    """
    texts = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    segments = materialize(texts.mapInArrow(_segments(k, bands(percent)), _SEGMENTS), "segments")
    keyed = segments.select("doc_id", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("band")
    shared = materialize(shared, "bands")
    # Bands grow with the input, so this join is shuffled at every size.
    rows = segments.withColumn("band", F.explode("bands")).drop("bands")
    met = materialize(rows.join(shared.hint("merge"), "band"), "paragraphs")
    hubs = met.groupBy("band").agg(F.min("hash").alias("hub"), F.max("hash").alias("last")).filter("hub < last").select("band", "hub")
    pairs = materialize(met.select("band", "hash").join(hubs, "band").filter("hash != hub").select("hub", "hash").distinct(), "paragraph-pairs")
    wanted = pairs.select(F.col("hub").alias("hash")).unionByName(pairs.select("hash")).distinct()
    where = met.groupBy("hash").agg(F.min(F.struct("doc_id", "start", "n_words")).alias("at")).join(wanted, "hash")
    where = where.select(F.col("at.doc_id").alias("doc_id"), F.struct(F.col("at.start").alias("start"), F.col("at.n_words").alias("n_words"), "hash").alias("c"))
    where = materialize(where.groupBy("doc_id").agg(F.collect_list("c").alias("chosen")), "paragraph-places")
    sample = materialize(texts.join(where, "doc_id").select("text", "chosen").mapInArrow(_shingles(k), "hash long, shingles array<long>"), "shingles")
    sample = sample.groupBy("hash").agg(F.first("shingles").alias("shingles"))
    near = materialize(_near(pairs.toDF("a", "b"), sample, percent), "paragraph-links")
    classes = materialize(components(near), "paragraph-components")
    late = _across(pairs, sample, classes, percent)
    classes = components(near.unionByName(late))
    found = met.select("doc_id", "start", "n_words", "hash").distinct()
    found = found.join(classes.select(F.col("node").alias("hash"), "component"), "hash", "left").withColumn("cluster", F.coalesce("component", "hash"))
    found = materialize(found.select("doc_id", "start", "n_words", "cluster"), "found")
    clusters = found.select("cluster", "doc_id").distinct().groupBy("cluster").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count(F.lit(1)).alias("n_docs"))
    repeats = found.join(clusters.filter("first_doc < last_doc"), "cluster")
    in_doc = Window.partitionBy("doc_id").orderBy("start", "n_words")
    gap = F.col("start") != F.lag(F.col("start") + F.col("n_words")).over(in_doc)
    repeats = repeats.withColumn("run", F.sum(F.when(F.coalesce(gap, F.lit(True)), 1).otherwise(0)).over(in_doc.rowsBetween(Window.unboundedPreceding, 0)))
    # What a run keeps and what not are rows of their own, so each cluster's first document keeps it.
    own = F.col("first_doc") == F.col("doc_id")
    repeats = repeats.withColumn("kept", own).withColumn("turn", F.coalesce(F.col("kept") != F.lag("kept").over(in_doc), F.lit(True)))
    repeats = repeats.withColumn("part", F.sum(F.col("turn").cast("int")).over(in_doc.rowsBetween(Window.unboundedPreceding, 0)))
    passages = repeats.groupBy("doc_id", "run", "part", "kept").agg(
        F.min("start").alias("start_word"), F.sum("n_words").alias("n_words"), F.min("first_doc").alias("cluster_id"), F.max("n_docs").alias("n_docs"),
    )
    whole = F.sum("n_words").over(Window.partitionBy("doc_id", "run"))
    passages = passages.withColumn("counted", F.when(F.col("kept"), F.col("n_words")).otherwise(whole)).filter(F.col("counted") >= run_words)
    return passages.select("doc_id", "start_word", "n_words", "cluster_id", "n_docs", "kept")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in textcodes.pieces(batches):
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if text and spans:
                codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
                starts, ends, _ = textcodes.runs(~textcodes.blank(codes), np.array([0, len(codes)]))
                for s in sorted(spans, key=lambda s: -s["start_word"]):
                    a, b = int(starts[s["start_word"]]), int(ends[s["start_word"] + s["n_words"] - 1])
                    text = text[:a] + text[b:]
            out.append(text)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])


def remove_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and text of every row, without the passages that the document doesn't keep."""
    spans = passages.filter(~F.col("kept")).groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "n_words")).alias("spans"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).join(spans, "doc_id", "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, text string")
