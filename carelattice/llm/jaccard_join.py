"""N-gram Jaccard join by parity sketches.

Every shingle toggles (XOR) one bit of a document's bit sketch, so the Hamming distance of two
sketches is at most the symmetric difference of the shingle sets. For a pair of given sizes the
threshold bounds that difference by D; of D + s chunks of the sketch at least s are then equal
(pigeonhole). Documents are joined on equal chunks within bands of sizes, pairs are thinned by
the Hamming distance of a folded sketch of about a bit a shingle, and what is left is verified on the words of the whole texts.

Chunks are 2^32 bits wide and never stored: a chunk's key is a linear hash of its bits, the XOR of
one 64-bit value for each bit set. A chunk without any bit says nothing and has no key. A pair all of
whose s equal chunks are empty has s empty ones in both documents; so few documents have that many
that these also emit their least shingles as keys (a prefix filter), of which such a pair shares one.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcodes
from .graph import components
from .rare_first import rare_pairs
from .shared import materialize

#: Bits of the smallest folded sketch.
SKETCH_BITS = 512
#: Rows up to which a checked table of two numbers a row is broadcast (about 40 MB as a hash table); beyond, Spark shuffles.
BROADCAST_ROWS = 500_000
#: Code points of texts whose sets a worker keeps while it verifies pairs.
KEPT_TEXT = 2_000_000
U = np.uint64


@dataclass(frozen=True)
class Bands:
    """Size bands for links with 100 * intersection >= percent * union."""

    percent: int

    def difference(self, total: int) -> int:
        """The largest symmetric difference of a link between sets of ``total`` shingles together."""
        return total * (100 - self.percent) // (100 + self.percent)

    def starts(self, most: int) -> list[int]:
        ratio = max(1.5, 100 / self.percent + 0.1)
        out = [1]
        while out[-1] <= most:
            out.append(max(out[-1] + 1, int(out[-1] * ratio)))
        return out

    def schemes(self, size: int) -> list[tuple[int, int, int]]:
        """(number, D, smallest size) of each chunking that a set of this size takes part in: one for pairs within
        its band, one for each border near it, for pairs across. None where only equal sets link."""
        bounds = self.starts(size)
        band = len(bounds) - 2
        out = [(2 * band, self.difference(2 * (bounds[-1] - 1)), bounds[-2])]
        for number, border in ((2 * band + 1, bounds[-1]), (2 * band - 1, bounds[-2])):
            partner = (border - 1) * 100 // self.percent
            if border > 1 and partner >= border and (size * 100 >= border * self.percent if size < border else size <= partner):
                out.append((number, self.difference(border - 1 + partner), -(-border * self.percent // 100)))
        return [x for x in out if x[1] > 0]

    def prefix(self, size: int) -> int:
        """Of how many shingles, the first in any one order, two linked sets must share one."""
        return size - -(-size * self.percent // 100) + 1


@cache
def spare(difference: int, least: int) -> int:
    """How many chunks must be equal: more than are empty, but for a few of the sets of ``least`` shingles."""
    for s in range(1, difference + 2):
        mean = (difference + s) * math.exp(-least / (difference + s))
        if s > mean + 2 * math.sqrt(mean):
            break
    return s


def chunk_keys(hashes: np.ndarray, bands: Bands) -> np.ndarray:
    """Distinct join keys of a sorted set of shingle hashes."""
    out = []
    low, high = textcodes.mix(hashes), hashes >> U(32)
    for number, difference, least in bands.schemes(len(hashes)) if len(hashes) else ():
        s = spare(difference, least)
        chunks = difference + s
        part = ((high * U(chunks)) >> U(32)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        filled, toggled = part[first], np.bitwise_xor.reduceat(low, first)
        salt = U((number * 0x9E3779B97F4A7C15) & (2**64 - 1))
        out.append(textcodes.mix(toggled ^ textcodes.mix(filled.astype(U) + salt)))
        if chunks - len(filled) >= s:
            out.append(textcodes.mix(low[: bands.prefix(len(hashes))] + ~salt))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, U)


def fold_sketch(hashes: np.ndarray) -> np.ndarray:
    """A parity sketch of at least a bit for each shingle, as 64-bit words; a power of two of them, so halves can be folded."""
    bits = max(SKETCH_BITS, 1 << max(0, len(hashes) - 1).bit_length())
    toggles = np.bincount(((hashes >> U(20)) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(toggles.astype(np.uint8)).view(np.int64)


def _digest(found: textcodes.Shingled, second: int) -> bytes | None:
    return hashlib.blake2b(found.hashes.tobytes() + second.to_bytes(8, "little"), digest_size=16).digest() if found.size else None


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(v) for v in arrays]))), pa.int32()), pa.array(np.concatenate(arrays)))


_FEATURES = "doc_id long, n_shingles long, digest binary, sketch array<long>"
_KEYS = "doc_id long, digest binary, keys array<long>"


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textcodes.pieces(batches, 256):
            sizes, digests, sketches = [], [], []
            for found, second in textcodes.shingled(batch.column(1).to_pylist(), k):
                sizes.append(found.size)
                digests.append(_digest(found, second))
                sketches.append(fold_sketch(found.hashes))
            if sizes:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(sketches)], names=["doc_id", "n_shingles", "digest", "sketch"])

    return run


def _keys(k: int, percent: int):
    """The join keys go to their shuffle without being kept: they would take as much room as the texts."""
    bands = Bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textcodes.pieces(batches, 256):
            digests, keys = [], []
            for found, second in textcodes.shingled(batch.column(1).to_pylist(), k):
                digests.append(_digest(found, second))
                keys.append(chunk_keys(found.hashes, bands).view(np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), _lists(keys)], names=["doc_id", "digest", "keys"])

    return run


_MEMBERS = "key long, hub long, id long"


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, id) in the order of the keys, each key's other rows with its hub; keys of one row give none.

    The hub is the smallest id of the key (of its first batch, where a key goes on in the next), so copies meet one hub by all their keys.
    """
    last_key, hub = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key, own = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        hubs = np.minimum.reduceat(own, np.flatnonzero(new))
        if last_key is not None and key[0] == last_key:
            hubs[0] = hub
        each = hubs[np.cumsum(new) - 1]
        others = each != own
        last_key, hub = key[-1], hubs[-1]
        yield pa.RecordBatch.from_arrays([pa.array(key[others]), pa.array(each[others]), pa.array(own[others])], names=["key", "hub", "id"])


def _verify(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, textcodes.Shingled] = {}
        numbers: dict[str, int] = {}
        held = 0
        for batch in textcodes.pieces(batches, 64):
            a_text, b_text = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            if held > KEPT_TEXT:
                seen.clear(), numbers.clear()
                held = 0
            new = list(dict.fromkeys(t for t in a_text + b_text if t not in seen))
            held += sum(map(len, new))
            seen.update(zip(new, (s for s, _ in textcodes.shingled(new, k, numbers)), strict=True))
            linked = []
            for a, b in zip(a_text, b_text, strict=True):
                x, y = seen[a], seen[b]
                both = x.shared(y)
                linked.append(both > 0 and 100 * both >= percent * (x.size + y.size - both))
            yield batch.select(["a", "b"]).filter(pa.array(linked))

    return run


_SETS = "node long, part long, tokens array<long>"


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in textcodes.pieces(batches, 256):
            found = list(textcodes.shingled(batch.column(1).to_pylist(), k))
            if found:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int.from_bytes(_digest(*x)[:8], "little", signed=True) if x[0].size else None for x in found], pa.int64()), _lists([s.hashes.view(np.int64) for s, _ in found])], names=["node", "part", "tokens"])

    return run


def _few(table: DataFrame) -> DataFrame:
    """``table`` with the hint to broadcast it if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def _near(pairs: DataFrame, light: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and folded sketches allow a link."""
    side = lambda n: light.select(F.col("doc_id").alias(n), F.col("n_shingles").alias(f"n_{n}"), F.col("sketch").alias(f"s_{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(_close(percent)).select("a", "b").distinct()


def _close(percent: int):
    """Do sizes and sketches allow a link? A sketch twice as long as the other is folded by XOR of its halves."""
    total = F.col("n_a") + F.col("n_b")

    def folded(x: str, other: str):
        half = (F.size(x) / 2).cast("int")
        halves = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(x) > F.size(other), halves).otherwise(F.col(x))

    apart = F.zip_with(folded("s_a", "s_b"), folded("s_b", "s_a"), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    hamming = F.aggregate(apart, F.lit(0), lambda total, x: total + x)
    similar = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return F.when(similar, hamming * (100 + percent) <= total * (100 - percent)).otherwise(F.lit(False))


def _linked(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of ``pairs`` that the whole texts bear out."""
    pairs = materialize(pairs, "candidates")
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = texts.join(_few(materialize(wanted, "wanted")), "doc_id", "left_semi")
    # While the pairs are few they go to the texts, so only texts of pairs are shuffled, and once.
    both = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text")).join(_few(pairs), "b")
    both = both.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text")).hint("merge"), "a")
    return materialize(both.select("a", "b", "a_text", "b_text").mapInArrow(_verify(k, percent), "a long, b long"), "links")


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, class_id.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, a set is the distinct k-word shingles
    (a text of fewer words is one shingle), and two documents link when
    100 * intersection >= percent * union. component_id is the smallest doc_id reachable,
    class_id the smallest doc_id with the same set. Null and blank texts have no shingles and link
    with nothing. Rows sharing a doc_id count as one node: what either links with is one component;
    a row with a null doc_id links with nothing and has a null component. An empty table gives no
    rows; other columns are ignored.

    Documents with one set (by a 128-bit digest) are one class, of which only the smallest doc_id is compared. In a
    bucket of equal chunks all members are compared with the smallest. Where some of them then still lie apart from
    it, the bucket's members meet again by their rarest shingles (``rare_first``), so no link is lost and no
    bucket is paired with itself. A pair links by its words, not by hashes of them.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    features = materialize(texts.mapInArrow(_features(k), _FEATURES), "sketches")
    known = features.filter(F.col("doc_id").isNotNull() & F.col("digest").isNotNull())
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.max("doc_id").alias("last")).filter("class_id < last")
    classes = _few(materialize(classes.select("digest", "class_id"), "classes"))
    copies = materialize(known.select("doc_id", "digest").join(classes, "digest").filter("doc_id != class_id"), "copies")
    # A doc_id with several texts goes in the class of its copy only.
    gone = _few(copies.select("doc_id", "digest").distinct())
    apart = known.join(gone, ["doc_id", "digest"], "left_anti")
    known_texts = texts.filter(F.col("doc_id").isNotNull())
    keyed = known_texts.mapInArrow(_keys(k, percent), _KEYS).filter(F.col("digest").isNotNull()).join(gone, ["doc_id", "digest"], "left_anti").select(F.explode("keys").alias("key"), F.col("doc_id").alias("id"))
    # Nearly all keys stand alone; they are dropped where they are sorted, after the one shuffle of the keys.
    members = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_members, _MEMBERS)
    members = materialize(members, "members")
    light = apart.select("doc_id", "n_shingles", "sketch")
    pairs = members.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = _linked(_near(pairs, light, percent), known_texts, k, percent)
    found = materialize(components(links), "components")

    named = lambda df, name, out: df.join(found.select(F.col("node").alias(name), F.col("component").alias(out)), name, "left").withColumn(out, F.coalesce(out, name))
    # Buckets of three or more, with members that lie apart from the first.
    places = materialize(named(named(members, "id", "c"), "hub", "hub_c"), "places")
    mixed = places.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("c") != F.col("hub_c")).alias("mixed")).filter("n > 1 AND mixed")
    crowd = materialize(places.join(mixed.select("key"), "key").select(F.col("id").alias("doc_id"), "c").distinct(), "crowd")
    if crowd.limit(1).count():
        sets = known_texts.join(_few(crowd.select("doc_id")), "doc_id", "left_semi").mapInArrow(_sets(k), _SETS)
        sets = sets.filter(F.col("part").isNotNull()).join(crowd.withColumnRenamed("doc_id", "node"), "node")
        late = _linked(_near(rare_pairs(sets, percent), light, percent), known_texts, k, percent)
        links = links.unionByName(late)
        found = materialize(components(links), "components")

    nodes = copies.select(F.col("doc_id").alias("a"), F.col("class_id").alias("b"))
    shared = features.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).filter("x != y").limit(1).count()
    if shared:  # one doc_id in several classes: it joins them
        found = materialize(components(links.unionByName(nodes)), "components")
        copies = copies.filter("false")
    names = copies.groupBy("doc_id").agg(F.min("class_id").alias("class_id"))
    out = features.select("doc_id", "n_shingles").join(names, "doc_id", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    out = out.join(found.select(F.col("node").alias("class_id"), "component"), "class_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "class_id").alias("component_id"), "class_id")


def keep_smallest(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the smallest doc_id of each component only.

    Rows that link with nothing all stay: null and blank texts, null identifiers, and rows that repeat the
    kept identifier. An empty table stays empty. Columns may have any names.
    """
    found = jaccard_components(docs, k, percent, id_col, text_col)
    gone = materialize(found.filter("component_id != doc_id").select("doc_id").distinct(), "near-copies")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc_id"))
    return rows.join(_few(gone), "doc_id", "left_anti").select("row.*")
