"""Vectorised pre-tokens of the public byte-level pattern, and a memo of what each one encodes to.

The pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+`` cuts where the class
of characters changes; a space before anything but white space goes with what follows it.
"""

from __future__ import annotations

from array import array
from itertools import accumulate, chain, repeat

import numpy as np

from . import letters, textcodes

#: Distinct pre-tokens that a worker's memo holds before it starts anew (about 200 bytes each).
MEMO = 600_000
_APOSTROPHE = 39


def split(codes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens, and each text's first one (one more at the end)."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = letters.classes()[codes]
    for code in np.unique(codes[kind == 4]).tolist():
        kind[codes == code] = letters.class_in_library(code)
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    cut[n] = True
    change = cut[:-1].copy()
    change[1:] |= kind[1:] != kind[:-1]
    begins = np.flatnonzero(change)
    ends = np.append(begins[1:], n)
    white = kind[begins] == 3
    mark = np.zeros(n + 1, bool)
    mark[begins[white]] = True
    other = begins[~white]
    joined = (other > 0) & ~cut[other] & (codes[other - 1] == 32)
    mark[other - joined] = True
    last = ends[white & (ends - begins > 1) & ~cut[ends]] - 1
    mark[last[codes[last] != 32]] = True
    quote = np.flatnonzero(mark[:-1] & (codes == _APOSTROPHE))
    quote = quote[(quote + 1 < n)]
    quote = quote[~cut[quote + 1]]
    if len(quote):
        after = codes[quote + 1]
        two = np.isin(after, [ord(c) for c in "stmd"])
        third = codes[np.minimum(quote + 2, n - 1)]
        room = (quote + 2 < n) & ~cut[np.minimum(quote + 2, n)]
        three = room & (((after == ord("r")) & (third == ord("e"))) | ((after == ord("v")) & (third == ord("e"))) | ((after == ord("l")) & (third == ord("l"))))
        for chosen, length in ((quote[two], 2), (quote[three], 3)):
            mark[chosen + 1] = False
            mark[chosen + length] = True
    mark[offsets[:-1][np.diff(offsets) > 0]] = True
    starts = np.flatnonzero(mark[:-1])
    return starts, np.append(starts[1:], n), np.searchsorted(starts, offsets)


class Memo:
    """Pre-token to what it encodes to, filled by ``encode(words) -> values`` for new ones."""

    def __init__(self, encode, known: dict[str, object] | None = None):
        self.encode, self.known = encode, dict(known or {})
        self.start = dict(self.known)

    def values(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list]:
        """The place of each pre-token among the slice's distinct ones, and the values of these."""
        words, place = textcodes.spans(codes, starts, ends)
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > MEMO:
            self.known = dict(self.start)
            new = [w for w in words if w not in self.known]
        self.known.update(zip(new, self.encode(new), strict=True))
        return place, [self.known[w] for w in words]


class Packed:
    """Pre-token to its ids, which lie end to end in one array; filled by ``encode(words) -> ids of each`` for new ones."""

    def __init__(self, encode):
        self.encode = encode
        self._empty()

    def _empty(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.bounds = array("I"), array("q", [0])

    def ids(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens of the slice, and how many each one has."""
        words, place = textcodes.spans(codes, starts, ends)
        numbers = self._numbers(words)
        new = np.flatnonzero(numbers < 0)
        if len(self.known) + len(new) > MEMO:
            self._empty()
            numbers[:] = -1
            new = np.arange(len(words))
        if len(new):
            fresh = [words[i] for i in new.tolist()]
            lists = self.encode(fresh)
            numbers[new] = len(self.known) + np.arange(len(new))
            self.known.update(zip(fresh, numbers[new].tolist(), strict=True))
            first = len(self.flat)
            self.flat.extend(chain.from_iterable(lists))
            self.bounds.extend(x + first for x in accumulate(map(len, lists)))
        flat, bounds = np.frombuffer(self.flat, np.uint32), np.frombuffer(self.bounds, np.int64)
        begin, length = bounds[numbers][place], (bounds[numbers + 1] - bounds[numbers])[place]
        shift = np.repeat(begin - (np.cumsum(length) - length), length)
        return flat[shift + np.arange(len(shift))], length

    def _numbers(self, words: list[str]) -> np.ndarray:
        """Where each word stands in the memo, -1 where it is new."""
        return np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
