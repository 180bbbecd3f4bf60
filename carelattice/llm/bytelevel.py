"""The tokenizers library's byte-level BPE files, one pre-token at a time."""

from __future__ import annotations

import json
from functools import cache

from tokenizers import Tokenizer


@cache
def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary: itself where printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in printable}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(printable))
    return table


@cache
def load(path: str) -> Tokenizer:
    """The tokenizer at ``path``; ValueError unless it splits and spells texts at byte level, and changes nothing else."""
    tokenizer = Tokenizer.from_file(path)
    spec = json.loads(tokenizer.to_str())
    split = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or spec["model"]["type"] != "BPE":
        raise ValueError("only byte-level BPE with the usual split and no normalizer is read by pre-token")
    return tokenizer


def special_strings(tokenizer: Tokenizer) -> list[str]:
    """Strings that the library cuts out of a text before it splits the rest."""
    return [t.content for t in tokenizer.get_added_tokens_decoder().values()]


def encode_words(tokenizer: Tokenizer, words: list[str]) -> list[tuple[int, ...]]:
    """Ids of each pre-token, by the library's own model."""
    model, table = tokenizer.model, byte_alphabet()
    return [tuple(t.id for t in model.tokenize(w.encode().decode("latin-1").translate(table))) for w in words]


def encode_text(tokenizer: Tokenizer, text: str) -> list[int]:
    return tokenizer.encode(text, add_special_tokens=False).ids
