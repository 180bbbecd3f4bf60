"""Quality rules as a bitmask ledger.

One pass over the whole texts takes the measurements of every document, and every rule is evaluated
once, to one bit of ``fail_bits``. The ledger keeps both. Policies are data: which bits drop a
document, and how many of the lenient ones it may fail; a policy of any version is applied to a
ledger that is already there, without the texts. What each rule of a policy decides (its ablation) is
counted over the distinct bit patterns, of which there are at most two to the number of rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcodes
from .letters import tables

SYMBOLS = "#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_alpha_words", "n_upper_words", "n_ellipsis_lines"]
#: Rules in the order of their bits; each fails where its condition over the measurements holds. New rules go to the end, so ledgers stay readable.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "many_symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 4 * n_lines",
    "few_letters": "10 * n_alpha_words < 6 * n_words",
    "upper_case": "2 * n_upper_words > n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "cut_lines": "10 * n_ellipsis_lines > 3 * n_lines",
}
BASE = ("few_words", "repeated_words")


def mask(names) -> int:
    """The bits of these rules; KeyError for a name that isn't a rule."""
    place = {name: i for i, name in enumerate(RULES)}
    return reduce(lambda bits, name: bits | 1 << place[name], names, 0)


@dataclass(frozen=True)
class Policy:
    """Drops a document that fails a rule of ``strict``, or more than ``most`` of ``lenient``."""

    name: str
    version: int
    strict: tuple[str, ...]
    lenient: tuple[str, ...] = ()
    most: int = 0

    def dropped(self, bits: Column, without: int = 0) -> Column:
        """Does the policy drop documents of these bits, the rules of mask ``without`` left aside?"""
        hard = bits.bitwiseAND(F.lit(mask(self.strict) & ~without)) != 0
        return hard | (F.bit_count(bits.bitwiseAND(F.lit(mask(self.lenient) & ~without))) > self.most)


POLICIES = [
    Policy("corpus", 1, BASE),
    Policy("corpus", 2, (*BASE, "many_symbols", "repeated_lines", "few_letters", "upper_case"), ("short_words", "long_words", "cut_lines"), 1),
]


def policy(name: str = "corpus", version: int | None = None) -> Policy:
    """The policy of that version, or the newest one; KeyError if there is none."""
    found = {p.version: p for p in POLICIES if p.name == name}
    return found[max(found) if version is None and found else version]


@cache
def _signs() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: is it a symbol, a letter of A-Z, a small letter."""
    import sys
    import unicodedata

    small = np.fromiter((unicodedata.category(chr(i)) == "Ll" for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)
    symbol, capital = np.zeros_like(small), np.zeros_like(small)
    symbol[[ord(c) for c in SYMBOLS]] = True
    capital[65:91] = True
    return symbol, capital, small


def _within(marks: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many marks lie in each span."""
    total = np.concatenate(([0], np.cumsum(marks)))
    return total[ends] - total[starts]


def _repeated(words: np.ndarray, doc: np.ndarray, k: int = 3) -> np.ndarray:
    """Of each word, given by its number: is it in a run of k words that its text holds twice or more? Runs are compared exactly."""
    n = len(words)
    covered = np.zeros(n, bool)
    if n < k:
        return covered
    key = np.unique(doc[: n - k + 1], return_inverse=True)[1].astype(np.int64)
    for i in range(k):
        key = np.unique(key * (int(words.max()) + 1) + words[i : n - k + 1 + i], return_inverse=True)[1].astype(np.int64)
    twice = (np.bincount(key)[key] > 1) & (doc[: n - k + 1] == doc[k - 1 :])
    # A run that reaches into the next text was counted under its first word's text, so count again among whole runs.
    whole = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
    twice[whole] = np.bincount(key[whole], minlength=key.max() + 1)[key[whole]] > 1
    for i in range(k):
        covered[i : n - k + 1 + i] |= twice
    return covered


def measure(texts: list[str | None]) -> list[np.ndarray]:
    """The MEASURES of each text, as one array a measure."""
    out: list[list[np.ndarray]] = [[] for _ in MEASURES]
    letter, (symbol, capital, small) = tables()[0], _signs()
    for _, codes, offsets in textcodes.slices(texts):
        a, b = offsets[:-1], offsets[1:]
        starts, ends, first = textcodes.runs(~textcodes.blank(codes), offsets)
        place = textcodes.spans(codes, starts, ends)[1]
        doc = np.repeat(np.arange(len(a)), np.diff(first))
        per_doc = lambda marks, first=first: _within(marks, first[:-1], first[1:])
        lined, line_ends, line_first = textcodes.runs(codes != 10, offsets)
        full = _within(~textcodes.blank(codes), lined, line_ends) > 0
        lined, line_ends = lined[full], line_ends[full]
        line_first = np.concatenate(([0], np.cumsum(full)))[line_first]
        line_doc = np.repeat(np.arange(len(a)), np.diff(line_first))
        same = textcodes.spans(codes, lined, line_ends)[1]
        known = np.ones(len(same), bool)
        if len(same):
            known[np.unique(line_doc * (int(same.max()) + 1) + same, return_index=True)[1]] = False
        last = codes[_last(codes, line_ends)] if len(line_ends) else codes[:0]
        dotted = (last == 0x2026) | ((last == 46) & _three_dots(codes, line_ends))
        upper = (_within(capital[codes], starts, ends) > 0) & (_within(small[codes], starts, ends) == 0)
        found = [
            np.diff(first), per_doc(ends - starts), _within(symbol[codes], a, b), _within(known, line_first[:-1], line_first[1:]), per_doc(_repeated(place, doc)),
            np.diff(line_first), per_doc(_within(letter[codes], starts, ends) > 0), per_doc(upper), _within(dotted, line_first[:-1], line_first[1:]),
        ]
        for kept, values in zip(out, found, strict=True):
            kept.append(np.asarray(values, np.int64))
    return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in out]


def _last(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The place of the last character before each end that isn't blank; the lines have one."""
    solid = np.maximum.accumulate(np.where(textcodes.blank(codes), -1, np.arange(len(codes))))
    return solid[ends - 1]


def _three_dots(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    at = _last(codes, ends)
    return (at >= 2) & (codes[at] == 46) & (codes[at - 1] == 46) & (codes[at - 2] == 46)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in textcodes.pieces(batches):
        found = [pa.array(x, pa.int64()) for x in measure(batch.column(1).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), *found], names=["doc_id", *MEASURES])


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the measurements and ``fail_bits`` of every row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+``. n_repeat_words counts the words that stand in a run of three words found twice or
    more in the text; n_dup_lines the lines with a word that equal an earlier one. Null and empty texts have no words and
    fail few_words. Repeated rows and null identifiers have a row each; an empty table gives none; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    measured = texts.mapInArrow(_measured, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES))
    bits = reduce(Column.bitwiseOR, (F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, rule in enumerate(RULES.values())))
    return measured.withColumn("fail_bits", bits)


def failed_rules(bits: Column) -> Column:
    """The names of the rules whose bits are set."""
    return F.filter(F.array(*(F.when(bits.bitwiseAND(F.lit(1 << i)) != 0, F.lit(name)) for i, name in enumerate(RULES))), lambda x: x.isNotNull())


def verdict(kept: DataFrame, chosen: Policy) -> DataFrame:
    """A ledger with ``base_failed``, ``kept`` and ``policy`` by one policy."""
    bits = F.col("fail_bits")
    base = bits.bitwiseAND(F.lit(mask(BASE))) != 0
    return kept.withColumns({"base_failed": base, "kept": ~base & ~chosen.dropped(bits), "policy": F.lit(f"{chosen.name}:{chosen.version}")})


def ablation(kept: DataFrame, policies: list[Policy] | None = None) -> DataFrame:
    """What each rule of each policy decides: policy, version, rule, n_docs, n_dropped, n_failed (fail this rule), n_alone
    (dropped because of it alone) and words_alone (their words).

    Documents are first counted by bit pattern, with partial aggregates; rules and policies meet the patterns only. An empty ledger
    gives one row a rule with zeros.
    """
    patterns = kept.groupBy("fail_bits").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words"))
    bits, n = F.col("fail_bits"), F.col("n")
    count = lambda condition, what=n: F.coalesce(F.sum(F.when(condition, what)), F.lit(0)).cast("long")
    cases = [(p, rule) for p in policies or POLICIES for rule in (*p.strict, *p.lenient)]
    totals = []
    for p, rule in cases:
        alone = p.dropped(bits) & ~p.dropped(bits, mask([rule]))
        totals.append(F.struct(
            F.lit(p.name).alias("policy"), F.lit(p.version).alias("version"), F.lit(rule).alias("rule"), count(F.lit(True)).alias("n_docs"), count(p.dropped(bits)).alias("n_dropped"),
            count(bits.bitwiseAND(F.lit(mask([rule]))) != 0).alias("n_failed"), count(alone).alias("n_alone"), count(alone, F.col("words")).alias("words_alone"),
        ))
    return patterns.agg(F.array(*totals).alias("r")).select(F.explode("r").alias("r")).select("r.*")


def profile(kept: DataFrame, *groups: str) -> DataFrame:
    """For each group of rows: their number, and the names of the rules that some and that all of them fail."""
    found = kept.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_docs"), F.bit_or("fail_bits").alias("some"), F.bit_and("fail_bits").alias("every"))
    return found.withColumns({"some": failed_rules(F.col("some")), "every": failed_rules(F.col("every"))})


def quality_rules(docs: DataFrame, chosen: Policy | None = None) -> DataFrame:
    """The ledger of ``docs`` with the verdict of the newest policy, or of the given one."""
    return verdict(ledger(docs), chosen or policy())
