"""Vectorised words, hashes and shingles of a batch of texts, on code points.

Everything works on one flat array of code points for many texts, cut into slices of at most
``SLICE`` code points (a longer text is a slice of its own), so memory doesn't follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE = 1 << 18
U = np.uint64
_BASE = U(0x9E3779B97F4A7C15 | 1)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_POWERS = {"up": np.ones(1, U), "down": np.ones(1, U)}
_M1, _M2, _M3 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values whose output bits all depend on all input bits."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base of the rolling sums, and of its inverse."""
    if len(_POWERS["up"]) < n:
        size = max(n, 2 * len(_POWERS["up"]))
        for key, factor in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, factor, U)
            steps[0] = U(1)
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in small batches, so that few texts at a time become Python strings."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def slices(texts: list[str | None], most: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (index of the first text, code points, offsets of the texts in them)."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= most):
            size += len(texts[end] or "")
            end += 1
        part = [t or "" for t in texts[at:end]]
        codes = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)
        yield at, codes, np.concatenate(([0], np.cumsum([len(t) for t in part]))).astype(np.int64)
        at = end


def blank(codes: np.ndarray) -> np.ndarray:
    """True at space, tab, line feed, vertical tab, form feed and carriage return."""
    return (codes == 32) | ((codes >= 9) & (codes <= 13))


def lower_ascii(codes: np.ndarray) -> np.ndarray:
    return codes + np.where((codes >= 65) & (codes <= 90), np.uint32(32), np.uint32(0))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that don't cross texts, and each text's first run (one more at the end)."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    cut = np.zeros(len(inside) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(inside), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(inside), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of code points; equal spans hash alike wherever they stand. It is a polynomial, so
    texts can be made that collide: it serves to hash features and to find what ``spans`` then compares."""
    up, down = powers(len(codes) + 1)
    x = (codes.astype(U) + U(1)) * _M3
    x ^= x >> U(32)
    x *= up[: len(codes)]
    total = np.empty(len(codes) + 1, U)
    total[0] = 0
    np.cumsum(x, out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U) * _M2)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each value among the distinct ones, and where each of these is first met."""
    coded = pa.array(h.view(np.int64)).dictionary_encode()
    place = coded.indices.to_numpy()
    first = np.empty(len(coded.dictionary), np.int64)
    first[place[::-1]] = np.arange(len(h) - 1, -1, -1)
    return place, first


def spans(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The distinct texts of spans that don't overlap, and the place of each span among them.

    Spans of one hash are compared in full with the first of them; where any differs, all are told apart as strings.
    """
    if not len(starts):
        return [], np.zeros(0, np.int64)
    whole = codes.tobytes().decode("utf-32-le")
    place, first = distinct(span_hashes(codes, starts, ends))
    a, length = starts[first][place], ends - starts
    shift = np.zeros(len(codes) + 1, np.int64)
    shift[starts] += a - starts
    shift[ends] -= a - starts
    twin = np.cumsum(shift[:-1])
    twin += np.arange(len(codes))
    np.minimum(twin, len(codes) - 1, out=twin)
    if (length != length[first][place]).any() or (codes[twin] != codes).any():
        known: dict[str, int] = {}
        place = np.array([known.setdefault(whole[i:j], len(known)) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)])
        return list(known), place
    return [whole[i:j] for i, j in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], place


def strong_hashes(words: list[str]) -> np.ndarray:
    """Two 64-bit hashes of each word, from XXH3 over its bytes."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(w.encode()) for w in words]), U).reshape(-1, 2)


def roll(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, texts' borders not heeded."""
    rolled = np.zeros(max(0, len(words) - k + 1), U)
    for i in range(k):
        rolled = mix(rolled * _M3 + words[i : i + len(rolled)])
    return rolled


class Shingled:
    """The set of a text's k-word shingles: sorted hashes, where each is first met, their number, and the words' numbers.

    A text of fewer than k words is one shingle, one without words none. Shingles of one hash are
    compared word by word, so ``size`` is exact, and so is ``shared``.
    """

    def __init__(self, words: np.ndarray, hashes: np.ndarray, k: int):
        self.words, self.k, self._hashes, self._first = words, min(k, len(words)), hashes, None
        ordered = np.sort(hashes)
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        self.repeats = not new.all()
        self.hashes = ordered[new] if self.repeats else ordered
        self.size = len(self.hashes)
        if self.repeats:
            order = np.argsort(hashes, kind="stable")
            again = np.flatnonzero(~new)
            if not self._same(order[again - 1], self, order[again]).all():
                self.size = len(np.unique(np.lib.stride_tricks.sliding_window_view(words, self.k), axis=0))

    @property
    def first(self) -> np.ndarray:
        """Where each of ``hashes`` is first met."""
        if self._first is None:
            self._first = np.unique(self._hashes, return_index=True)[1]
        return self._first

    def _same(self, at: np.ndarray, other: Shingled, there: np.ndarray) -> np.ndarray:
        return np.logical_and.reduce([self.words[at + i] == other.words[there + i] for i in range(self.k)])

    def shared(self, other: Shingled) -> int:
        """How many shingles both sets hold; the words of both must be numbered alike."""
        _, x, y = np.intersect1d(self.hashes, other.hashes, assume_unique=True, return_indices=True)
        return int(self._same(self.first[x], other, other.first[y]).sum()) if len(x) and self.k == other.k else 0


def shingled(texts: list[str | None], k: int, numbers: dict[str, int] | None = None) -> Iterator[tuple[Shingled, int]]:
    """Each lower-cased (A-Z) text's set, and a second hash of it. ``numbers`` keeps words' numbers alike over calls."""
    for _, codes, offsets in slices(texts):
        codes = lower_ascii(codes)
        starts, ends, first = runs(~blank(codes), offsets)
        words, place = spans(codes, starts, ends)
        h = strong_hashes(words)
        own = place if numbers is None else np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)[place]
        one, two = h[place, 0], h[place, 1]
        rolled, second = roll(one, k), roll(two, k)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= k:
                found, more = rolled[a : b - k + 1], second[a : b - k + 1]
            else:  # all words as one shingle, or none
                found, more = (mix(roll(x[a:b], b - a) + U(b - a)) if b > a else x[:0] for x in (one, two))
            s = Shingled(own[a:b], found, k)
            yield s, int((more[s.first] if s.repeats else more).sum())
