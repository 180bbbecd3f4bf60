"""Code-point tables: letters, lower case, and coarse scripts."""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np

#: First code points of ranges and the script from there on (fixed values of the Unicode block layout); "" has none of its own.
SCRIPT_RANGES = [
    (0x0000, ""), (0x0041, "Latin"), (0x02B0, ""), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x0900, "Devanagari"), (0x0980, "Bengali"),
    (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"), (0x1000, "Myanmar"),
    (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, ""),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, ""), (0x2C60, "Latin"), (0x2C80, ""), (0x3040, "Kana"), (0x3100, ""),
    (0x3130, "Hangul"), (0x3190, ""), (0x31F0, "Kana"), (0x3200, ""), (0x3400, "Han"), (0xA000, ""), (0xA640, "Cyrillic"),
    (0xA6A0, ""), (0xA720, "Latin"), (0xA800, ""), (0xAC00, "Hangul"), (0xD7B0, ""), (0xF900, "Han"), (0xFB00, "Latin"),
    (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"), (0xFE00, ""), (0xFE70, "Arabic"), (0xFF00, "Latin"),
    (0xFF66, "Kana"), (0xFFA0, "Hangul"), (0x10000, ""), (0x20000, "Han"), (0x32000, ""),
]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: is it a letter, its lower case (of one code point), its script's place in SCRIPTS."""
    letter = np.zeros(sys.maxunicode + 1, bool)
    lower = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for i in range(sys.maxunicode + 1):
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            if len(low := c.lower()) == 1:
                lower[i] = ord(low)
    bounds = np.array([a for a, _ in SCRIPT_RANGES])
    places = np.array([SCRIPTS.index(name) for _, name in SCRIPT_RANGES], np.uint8)
    script = places[np.searchsorted(bounds, np.arange(sys.maxunicode + 1), "right") - 1]
    return letter, lower, script


@cache
def classes() -> np.ndarray:
    """For each code point: 1 letter, 2 number, 3 white space, 4 unassigned in this Python's Unicode, 0 other."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))
        out[i] = 4 if kind == "Cn" else {"L": 1, "N": 2}.get(kind[0], 0)
    for a, b in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        out[a : b + 1] = 3
    return out


@cache
def class_in_library(code: int) -> int:
    """1 letter, 2 number or 0 other, as the tokenizers library splits: its Unicode may be newer than Python's."""
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    return 1 if len(split("a" + chr(code))) == 1 else 2 if len(split("1" + chr(code))) == 1 else 0
