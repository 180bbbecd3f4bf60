"""Byte-level BPE with Spark's higher-order functions.

``aggregate`` folds ranked merges over the bytes of a word, looking ranks up in a literal map; bytes are
characters of ISO-8859-1. The common words of a bounded sample of the texts are folded first and broadcast;
any other word is folded in the row of the text that holds it, once for each text, so nothing is shuffled
but the sample's words. A word of ``LONG_FOLD`` bytes or more that can't be cut (one sign over and over) is merged by a heap instead, in the
same order. Decoding concatenates the tokens' binary pieces.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pretokens, textcodes
from .shared import materialize

#: The words that are broadcast are at most so many, of at most so many bytes each (so under 400 MB, 40 MB as a rule),
#: and come from about so many rows. They only save work: the rows of the result don't depend on them.
COMMON_WORDS, COMMON_BYTES, SAMPLE_ROWS = 1 << 20, 64, 50_000
#: Maps that the literal rank map is dealt to by crc32; a lookup reads one of them.
RANK_BUCKETS = 16384
#: Code points from which a word is cut where no token reaches across.
LONG_WORD = 48
#: Distinct words that a worker gathers before it emits them.
GATHERED_WORDS = 300_000
NO_RANK, PLACES = 2**31 - 1, 1 << 20
#: Bytes from which an uncut word is merged by a heap: the fold copies its state at each merge, so its work grows with the square of a word.
LONG_FOLD = 1024


@cache
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """The ranks as one foldable literal: an array of small maps, a token's place being its crc32."""
    maps: list[dict[str, int]] = [{} for _ in range(RANK_BUCKETS)]
    for token, rank in ranks.items():
        spelled = token.decode("latin-1")
        maps[zlib.crc32(spelled.encode()) % RANK_BUCKETS][spelled] = rank
    return F.from_json(F.lit(json.dumps(maps)), "array<map<string,int>>")


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once: the start of a fold of nothing, which costs no array."""
    return F.aggregate(F.from_json(F.lit("[]"), "array<int>"), value, lambda same, _: same, use)


def _rank(piece: Column, ranks: Column) -> Column:
    return _let(piece, lambda p: F.element_at(F.get(ranks, (F.crc32(p.cast("binary")) % RANK_BUCKETS).cast("int")), p))


def fold_merges(word: Column, ranks: Column) -> Column:
    """Token ids of ``word`` (a string of bytes as ISO-8859-1): always merge the leftmost pair of lowest rank.

    The state is one array with an entry for each piece, rank * PLACES + start, where rank is that of the pair
    which the piece makes with the next one; the last piece and the end have NO_RANK. So the least entry is
    the leftmost pair of lowest rank, and a merge drops one entry and looks two ranks up.
    """
    end = F.length(word)
    entry = lambda start, stop: F.coalesce(_rank(F.substr(word, start + 1, stop - start), ranks), F.lit(NO_RANK)).cast("long") * PLACES + start
    start = lambda state, i: (F.get(state, i) % PLACES).cast("int")
    last = F.array(NO_RANK * PLACES + end.cast("long") - 1, NO_RANK * PLACES + end.cast("long"))
    begin = F.concat(F.transform(F.sequence(F.lit(0), end - 2), lambda i: entry(i, i + 2)), last)

    def merge(state: Column, _: Column) -> Column:
        def join(least: Column, place: Column) -> Column:
            own = (least % PLACES).cast("int")

            def put(after: Column) -> Column:
                mine = F.when(after == end, NO_RANK * PLACES + own.cast("long")).otherwise(entry(own, start(state, place + 2)))
                both = F.when(place == 1, F.array(mine)).otherwise(F.array(_let(start(state, place - 2), lambda left: entry(left, after)), mine))
                return F.concat(F.slice(state, F.lit(1), F.greatest(place - 2, F.lit(0))), both, F.slice(state, place + 2, F.size(state)))

            return _let(start(state, place + 1), put)

        done = lambda least: F.when(least >= NO_RANK * PLACES, state).otherwise(_let(F.array_position(state, least).cast("int"), lambda place: join(least, place)))
        return _let(F.array_min(state), done)

    pieces = F.aggregate(F.sequence(F.lit(2), end), begin, merge)
    ids = _let(pieces, lambda p: F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda i: _let(start(p, i), lambda a: _rank(F.substr(word, a + 1, start(p, i + 1) - a), ranks))))
    return _let(_rank(word, ranks), lambda whole: F.when(whole.isNotNull(), F.array(whole)).otherwise(ids))


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one long word, by the same merges in the same order as ``fold_merges``: a heap of the pairs' ranks and places, so n log n."""
    ends, before, heap = list(range(1, len(word) + 1)), list(range(-1, len(word))), []

    def offer(at: int) -> None:
        after = ends[at]
        rank = ranks.get(word[at : ends[after]]) if after < len(word) else None
        if rank is not None:
            heapq.heappush(heap, (rank, at, after, ends[after]))

    for i in range(len(word) - 1):
        offer(i)
    while heap:
        _, at, middle, end = heapq.heappop(heap)
        if ends[at] != middle or ends[middle] != end:  # one of the two has been merged since
            continue
        ends[at], ends[middle] = end, -1
        if end < len(word):
            before[end] = at
        offer(at)
        if before[at] >= 0:
            offer(before[at])
    out, at = [], 0
    while at < len(word):
        out.append(ranks[word[at : ends[at]]])
        at = ends[at]
    return out


def encode_words(words: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``words(word binary, ...)`` with column ids, by expressions of Spark alone. The literal map is bound once, so the plan holds one copy."""
    return words.withColumn("ids", _let(rank_literal(ranks), lambda literal: _let(F.decode("word", "ISO-8859-1"), lambda spelled: fold_merges(spelled, literal))))


@cache
def _inner_pairs(path: str) -> np.ndarray:
    """For each pair of bytes: does some token hold it? Where none does, no merge reaches across."""
    table = np.zeros(1 << 16, bool)
    for token in load_ranks(path):
        for a, b in zip(token, token[1:]):
            table[a << 8 | b] = True
    return table


def words_of(codes: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pre-tokens; long ones cut further where that can't change their ids."""
    starts, ends, first = pretokens.split(codes, offsets)
    long = np.flatnonzero(ends - starts > LONG_WORD)
    if not len(long):
        return starts, ends, first
    more, inner = [starts], _inner_pairs(path)
    for i in long.tolist():
        spelled = [chr(c).encode() for c in codes[starts[i] : ends[i]].tolist()]
        more.append(np.array([starts[i] + j for j in range(1, len(spelled)) if not inner[spelled[j - 1][-1] << 8 | spelled[j][0]]], np.int64))
    starts = np.sort(np.concatenate(more))
    return starts, np.append(starts[1:], len(codes)), np.searchsorted(starts, offsets)


def _distinct(path: str):
    """The words of the texts and how often each is used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}

        def emit() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()).cast(pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in textcodes.pieces(batches):
            for _, codes, offsets in textcodes.slices(batch.column(0).to_pylist()):
                starts, ends, _ = words_of(codes, offsets, path)
                words, place = textcodes.spans(codes, starts, ends)
                for word, n in zip(words, np.bincount(place, minlength=len(words)).tolist(), strict=True):
                    seen[word] = seen.get(word, 0) + n
            if len(seen) > GATHERED_WORDS:
                yield emit()
        if seen:
            yield emit()

    return run


_PACKED = "hashes binary, word_sizes binary, words binary, id_sizes binary, ids binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their ids as flat arrays, one row a batch."""
    for batch in batches:
        words, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        if words:
            hashes = np.concatenate([textcodes.span_hashes(codes, at[:-1], at[1:]) for _, codes, at in textcodes.slices([w.decode() for w in words])])
            sizes = [np.fromiter(map(len, x), np.int32, len(x)) for x in (words, ids)]
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes[1].sum()))
            cells = (hashes.tobytes(), sizes[0].tobytes(), b"".join(words), sizes[1].tobytes(), flat.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cells], names=[c.split()[0] for c in _PACKED.split(", ")])


def _gather(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs of ``size`` from ``begin`` on, one run after the other."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


def _spelled(offsets: np.ndarray, data) -> pa.LargeBinaryArray:
    """``data`` from offset to offset, not copied."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _in_utf8(codes: np.ndarray, starts: np.ndarray) -> pa.LargeBinaryArray:
    """The words from each of ``starts`` to the next; the first one is 0."""
    at = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF), out=at[1:])
    return _spelled(np.append(at[starts], at[-1]), codes.tobytes().decode("utf-32-le").encode())


class Common:
    """The broadcast words with their ids, sorted by a hash; a hit counts only if the word's bytes are the same."""

    def __init__(self, packed: pa.Table):
        whole = lambda name, kind: np.frombuffer(b"".join(c.as_buffer() for c in packed.column(name)), kind)
        ends = lambda name: np.concatenate(([0], np.cumsum(whole(name, np.int32), dtype=np.int64)))
        self.word_at, self.words, self.ids_at, self.ids = ends("word_sizes"), whole("words", np.uint8), ends("id_sizes"), whole("ids", np.int32)
        hashes = whole("hashes", np.uint64)
        self.order = np.argsort(hashes).astype(np.int32)
        self.hashes = hashes[self.order]

    def find(self, words: pa.LargeBinaryArray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's ids begin in ``ids`` and how many they are, 0 for a word that isn't here."""
        if not len(words) or not len(self.hashes):
            return np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        turn = np.argsort(hashes)  # neighbours are found near each other, which spares the cache
        at = np.empty(len(hashes), np.int32)
        at[turn] = self.order[np.minimum(np.searchsorted(self.hashes, hashes[turn]), len(self.hashes) - 1)]
        same = pc.equal(_spelled(self.word_at, self.words).take(pa.array(at)), words).to_numpy(zero_copy_only=False)
        return self.ids_at[at], np.where(same, self.ids_at[at + 1] - self.ids_at[at], 0)


_PARTS = "doc_id long, n long, ids array<string>, decoded array<string>, own array<binary>, rare array<int>"


def _parts(path: str, shared):
    """Each text's ids and decoded text between the words that aren't common, these words, each once, and which of them stand there.

    Arrow and numpy handle the words of a slice together; nothing is done in Python for each word but the long ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common: Common = shared.value
        ranks = load_ranks(path)
        pieces = pa.array(sorted(ranks, key=ranks.get), pa.binary())
        digits = pa.array(map(str, range(len(ranks))), pa.string())
        lists = lambda offsets, values: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
        for batch in textcodes.pieces(batches, 256):
            for at, codes, offsets in textcodes.slices(batch.column(1).to_pylist()):
                starts, ends, first = words_of(codes, offsets, path)
                coded = _in_utf8(codes, starts).dictionary_encode()
                words, place = coded.dictionary, coded.indices.to_numpy()
                met = np.zeros(len(words), np.int64)
                met[place[::-1]] = np.arange(len(place) - 1, -1, -1)
                begin, size = common.find(words, textcodes.span_hashes(codes, starts[met], ends[met]))
                ids = common.ids[_gather(begin, size)]
                begin = np.cumsum(size) - size
                long = np.flatnonzero(pc.binary_length(words).to_numpy() >= LONG_FOLD)
                merged = [np.array(merge_long(words[i].as_py(), ranks), np.int32) for i in long.tolist()]
                size[long] = [len(m) for m in merged]
                begin[long] = len(ids) + np.cumsum(size[long]) - size[long]
                ids = np.concatenate([ids, *merged])
                counts = size[place]
                tokens = pa.array(ids[_gather(begin[place], counts)])
                sums = np.concatenate(([0], np.cumsum(counts)))
                rare = np.flatnonzero(counts == 0)
                rare_at = np.searchsorted(rare, first)  # each text's first rare word
                # A part begins with each text and after each rare word, which has no tokens yet.
                cuts = np.append(np.sort(np.concatenate((sums[first[:-1]], sums[rare]))), sums[-1])
                parts_at = rare_at + np.arange(len(first))
                joined = pc.if_else(pa.array(np.diff(cuts) > 0), pc.binary_join(lists(cuts, digits.take(tokens)), ","), None)
                decoded = pc.binary_join(lists(cuts, pieces.take(tokens)), b"").cast(pa.string())
                text = np.repeat(np.arange(len(first) - 1), np.diff(rare_at))
                own, which = np.unique(text * len(words) + place[rare], return_inverse=True)
                own_at = np.searchsorted(own, np.arange(len(first)) * len(words))
                columns = (
                    batch.column(0).slice(at, len(first) - 1),
                    pa.array(np.diff(sums[first])),
                    lists(parts_at, joined),
                    lists(parts_at, decoded),
                    lists(own_at, words.take(pa.array(own % max(1, len(words)))).cast(pa.binary())),
                    lists(rare_at, pa.array(which - own_at[text], pa.int32())),
                )
                yield pa.RecordBatch.from_arrays(list(columns), names=["doc_id", "n", "ids", "decoded", "own", "rare"])

    return run


def common_words(rows: DataFrame, path: str, most: int = COMMON_WORDS, sample_rows: int = SAMPLE_ROWS) -> Common:
    """At most ``most`` of the words of about ``sample_rows`` rows, those used most often, with their ids."""
    every = max(1, rows.count() // sample_rows)
    found = rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).select("text").mapInArrow(_distinct(path), "word binary, n long")
    words = found.filter(F.octet_length("word") <= COMMON_BYTES).groupBy("word").agg(F.sum("n").alias("n"))
    words = materialize(words.withColumn("turn", F.col("n") * 64 + F.pmod(F.xxhash64("word"), F.lit(64))), "bpe-words")
    used = words.groupBy("turn").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("turn")).toPandas()
    beyond = used["words"].cumsum() > most
    chosen = words.filter(F.col("turn") > int(used["turn"][beyond].iloc[0])) if beyond.any() else words
    # Few bytes, but much work for each, so they are spread over all tasks.
    spread = chosen.select("word").repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    return Common(encode_words(spread, load_ranks(path)).mapInArrow(_pack, _PACKED).toArrow())


def encode_and_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", most: int = COMMON_WORDS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256 (ids in decimal, joined by commas), decoded_sha256.

    Ranks are those of the file at ``path``, which every worker reads; each match of the public
    pattern is encoded by itself, special strings as plain text. Null texts are empty and have no
    tokens; an empty table gives no rows; repeated rows are encoded each; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranks = load_ranks(path)
    shared = docs.sparkSession.sparkContext.broadcast(common_words(rows, path, most))
    pa.default_memory_pool().release_unused()  # the driver keeps no copy of what it has sent
    parts = rows.mapInArrow(_parts(path, shared), _PARTS)
    fold = lambda literal: lambda word: _let(F.decode(word, "ISO-8859-1"), lambda spelled: fold_merges(spelled, literal))
    own_ids = _let(rank_literal(ranks), lambda literal: F.transform("own", fold(literal)))
    # Bound once by ``_let``, or the fold would be evaluated for each place that a word stands at.
    folded = parts.withColumn("rare_ids", _let(own_ids, lambda own: F.transform("rare", lambda i: F.get(own, i))))
    tokens = F.from_json(F.lit(json.dumps([t.decode("latin-1") for t, _ in sorted(ranks.items(), key=lambda x: x[1])])), "array<string>")
    places = {r: i for i, r in enumerate(sorted(ranks.values()))}
    if any(r != i for r, i in places.items()):
        raise ValueError("ranks must be 0 to their number less one")
    spelled = lambda ids: F.decode(F.encode(F.array_join(F.transform(ids, lambda i: F.get(tokens, i)), ""), "ISO-8859-1"), "UTF-8")
    between = lambda parts, words: F.flatten(F.zip_with(parts, words, lambda a, b: F.array(a, b)))
    ids = F.concat_ws(",", between(F.col("ids"), F.transform("rare_ids", lambda r: F.array_join(r, ","))))
    decoded = F.concat_ws("", between(F.col("decoded"), F.transform("rare_ids", spelled)))
    n_tokens = F.col("n") + F.aggregate("rare_ids", F.lit(0), lambda total, r: total + F.size(r))
    return folded.select("doc_id", n_tokens.alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(decoded.cast("binary"), 256).alias("decoded_sha256"))
