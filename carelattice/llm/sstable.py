"""Sorted-string-table shards of token ids.

A shard is data blocks, a sparse index of them, a Bloom filter and a footer:

* key: one byte (0 for a null identifier, else 1) and the identifier as big-endian with its sign bit flipped, so keys sort as identifiers do
* block: entries (shared prefix length, rest of the key, value), compressed; the first entry has its whole key
* value: little-endian ids, of 16 bits where they fit, else of 32
* index: first key, place and length of each block
* footer: places of index and filter, entries, ids, the shard's part and sequence number, and a mark that ends in a line feed

Shards are written by Spark's text source, one record a file, so commit, retry and any file system
are Spark's concern; the line feed that it appends is the mark's last byte.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytelevel, pretokens, textcodes
from .shared import fresh_path, materialize

MARK = b"CLSSTAB\n"
FOOTER = struct.Struct("<QQQQQQQQI")
BLOCK_BYTES, SHARD_BYTES = 64 << 10, 8 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\0" + bytes(8) if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % bits for i in range(BLOOM_HASHES)]


class Writer:
    """Builds one shard from entries in key order."""

    def __init__(self, part: int, sequence: int):
        self.part, self.sequence = part, sequence
        self.data, self.index, self.keys = bytearray(), [], []
        self.block, self.first, self.last, self.ids = bytearray(), b"", b"", 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        key = key_of(doc_id)
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
        value = ids.astype("<u4" if wide else "<u2").tobytes()
        self.block += struct.pack("<BBIB", shared, len(key) - shared, len(value), wide) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.ids += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._close()

    def _close(self) -> None:
        if self.block:
            packed = zstandard.compress(bytes(self.block), 1)
            self.index.append((self.first, len(self.data), len(packed)))
            self.data += packed
            self.block = bytearray()

    def size(self) -> int:
        return len(self.data) + len(self.block)

    def finish(self) -> bytes:
        """The shard without its final line feed."""
        self._close()
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(bits, np.uint8)
        for key in self.keys:
            bloom[_bloom_places(key, bits)] = 1
        index = b"".join(struct.pack("<9sQI", *x) for x in self.index)
        packed = np.packbits(bloom).tobytes()
        body = bytes(self.data) + index + packed
        foot = FOOTER.pack(len(self.data), len(self.index), len(self.data) + len(index), bits, len(self.keys), self.ids, self.part, self.sequence, zlib.crc32(index + packed))
        return body + foot + MARK[:-1]


class Reader:
    """Looks up and scans one shard held as bytes."""

    def __init__(self, shard: bytes):
        if shard[-len(MARK) :] != MARK:
            raise ValueError("not a shard")
        self.shard = shard
        at, blocks, bloom, self.bits, self.entries, self.ids, self.part, self.sequence, check = FOOTER.unpack_from(shard, len(shard) - len(MARK) - FOOTER.size)
        index = shard[at:bloom]
        self.bloom = shard[bloom : len(shard) - len(MARK) - FOOTER.size]
        if zlib.crc32(index + self.bloom) != check:
            raise ValueError("damaged index")
        self.index = [struct.unpack_from("<9sQI", index, i * 21) for i in range(blocks)]
        self.firsts = [x[0] for x in self.index]

    def _entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, start, length = self.index[block]
        data, at, key = zstandard.decompress(self.shard[start : start + length]), 0, b""
        while at < len(data):
            shared, rest, size, wide = struct.unpack_from("<BBIB", data, at)
            at += 7
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, np.frombuffer(data, "<u4" if wide else "<u2", size // (4 if wide else 2), at)
            at += size

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for block in range(len(self.index)):
            for key, ids in self._entries(block):
                yield id_of(key), ids

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _bloom_places(key_of(doc_id), self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each row with this identifier: the filter, a binary search of the index, then the blocks it points to."""
        key, found = key_of(doc_id), []
        if not self.index or not self.may_hold(doc_id):
            return found
        block = max(0, bisect_right(self.firsts, key) - 1)
        while block > 0 and self.firsts[block] == key:
            block -= 1
        for b in range(block, len(self.index)):
            if self.firsts[b] > key:
                break
            found += [ids for k, ids in self._entries(b) if k == key]
        return found


@lru_cache(maxsize=1)
def _encoder(path: str):
    """The tokenizer at ``path``, its special strings and a memo, which a worker keeps from task to task."""
    tokenizer = bytelevel.load(path)
    return tokenizer, bytelevel.special_strings(tokenizer), pretokens.Packed(lambda words: bytelevel.encode_words(tokenizer, words))


def _build(path: str, end_id: int, shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tokenizer, special, memo = _encoder(path)
        part, sequence = TaskContext.get().partitionId(), 0
        shard = Writer(part, sequence)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([shard.finish()], pa.binary())], names=["shard"])
        for batch in textcodes.pieces(batches):
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, codes, offsets in textcodes.slices(texts):
                starts, ends, first = pretokens.split(codes, offsets)
                ids, length = memo.ids(codes, starts, ends)
                bounds = np.concatenate(([0], np.cumsum(length)))[first].tolist()
                for i in range(len(offsets) - 1):
                    text = texts[at + i]
                    own = np.array(bytelevel.encode_text(tokenizer, text), np.int64) if text and any(s in text for s in special) else ids[bounds[i] : bounds[i + 1]]
                    shard.add(keys[at + i], np.append(own, end_id))
                    if shard.size() >= shard_bytes:
                        yield done()
                        sequence += 1
                        shard = Writer(part, sequence)
        if shard.keys:
            yield done()

    return run


def write_shards(docs: DataFrame, tokenizer_path: str, out: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> None:
    """Encode every whole text, append ``end_id``, and write shards in ascending order of the identifier to folder ``out``.

    Null identifiers come first, rows with one identifier in the order of a hash of their text; null texts are empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("turn", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "turn").sortWithinPartitions("doc_id", "turn")
    shards = ordered.select("doc_id", "text").mapInArrow(_build(tokenizer_path, end_id, shard_bytes), "shard binary")
    shards.select(F.col("shard").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(out)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            reader = Reader(batch.column(0)[i].as_py())
            rows, before = [], 0
            for n, (doc, ids) in enumerate(reader.scan()):
                rows.append((doc, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), reader.part, reader.sequence, n))
                before += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "before", "n_tokens", "ids_crc32", "part", "sequence", "n"])


def read_shards(spark, out: str) -> DataFrame:
    """Scan the shards of folder ``out``: doc_id, start (ids of all rows before it), n_tokens, ids_crc32.

    Starts are running totals within each shard plus the totals of the shards before it; only one
    number for each shard is put in one order.
    """
    files = spark.read.format("binaryFile").load(out).filter(F.col("length") > 0).select("content")
    rows = materialize(files.mapInArrow(_scan, "doc_id long, before long, n_tokens long, ids_crc32 long, part long, sequence long, n long"), "shard-rows")
    totals = rows.groupBy("part", "sequence").agg(F.sum("n_tokens").alias("ids"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("part", "sequence").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", "sequence", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("offset"))
    return rows.join(totals, ["part", "sequence"]).select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def _get(wanted: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                reader = Reader(batch.column(0)[i].as_py())
                found = [(w, ids.astype(np.int64)) for w in wanted for ids in reader.get(w)]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.int64()), pa.array([ids for _, ids in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return run


def lookup(spark, out: str, wanted: list[int | None]) -> DataFrame:
    """The rows of the given identifiers (a short list): doc_id, ids."""
    return spark.read.format("binaryFile").load(out).filter(F.col("length") > 0).select("content").mapInArrow(_get(list(wanted)), "doc_id long, ids array<long>")


def encode_to_shards(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ``docs`` as shards in the session's shared folder and read them back with ``read_shards``.

    One row per row of ``docs``; repeated identifiers keep a row each, null identifiers come first,
    null texts are the end id alone, and an empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    out = fresh_path(spark, "shards")
    write_shards(docs, tokenizer_path, out, end_id, id_col, text_col)
    return read_shards(spark, out)
