"""Recursive character splitting of long texts into overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, separator: str) -> list[str]:
    """Cut before each separator, which stays with what follows it."""
    if not separator:
        return list(text)
    head, *rest = text.split(separator)
    return [p for p in [head, *(separator + r for r in rest)] if p]


def _pack(parts: list[str], size: int, overlap: int) -> Iterator[str]:
    """Greedy chunks of whole parts; each starts with the last parts of the one before, ``overlap`` characters at most."""
    window: list[str] = []
    length = 0
    for part in parts:
        if length + len(part) > size and window:
            yield "".join(window)
            while window and (length > overlap or length + len(part) > size):
                length -= len(window.pop(0))
        window.append(part)
        length += len(part)
    if window:
        yield "".join(window)


def split_text(text: str, size: int = 1000, overlap: int = 200, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of ``size`` characters at most, cut at the coarsest separator that does; stripped, blank ones dropped."""
    separator = next((s for s in separators if not s or s in text), "")
    finer = separators[separators.index(separator) + 1 :] if separator in separators else ()
    out: list[str] = []
    short: list[str] = []
    for piece in _pieces(text, separator):
        if len(piece) <= size:
            short.append(piece)
            continue
        out += _pack(short, size, overlap)
        short = []
        out += split_text(piece, size, overlap, finer) if finer else [piece]
    out += _pack(short, size, overlap)
    return [c for c in map(str.strip, out) if c]


def split_documents(docs: DataFrame, size: int = 1000, overlap: int = 200, text_col: str = "text") -> DataFrame:
    """One row per chunk: the columns of ``docs`` without the text, chunk_index (from 0) and chunk.

    Null and blank texts give no row. Texts travel to Python in Arrow batches, one at a time being split.
    """
    if size <= 0 or overlap < 0 or overlap >= size:
        raise ValueError("size must be positive, overlap at least 0 and less than size")

    @F.pandas_udf("array<string>")
    def chunks(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_text(t, size, overlap) if t else [])

    others = [c for c in docs.columns if c != text_col]
    return docs.select(*others, F.posexplode(chunks(F.col(text_col))).alias("chunk_index", "chunk"))
