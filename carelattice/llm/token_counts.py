"""Token counts with a shortcut for whole tokens.

Once, before any text is read, the library is asked which strings of the vocabulary, taken alone,
it encodes as that one token. A pre-token found among them counts 1 without a merge; only the rest
are merged, each distinct one once for a worker's memo.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytelevel, pretokens, textcodes


def single_tokens(path: str) -> list[str]:
    """The vocabulary's strings that are one pre-token and, alone, encode as one token."""
    tokenizer = bytelevel.load(path)
    bytes_of = {ord(c): b for b, c in bytelevel.byte_alphabet().items()}
    strings = []
    for token in tokenizer.get_vocab(with_added_tokens=False):
        try:
            strings.append(token.translate(bytes_of).encode("latin-1").decode())
        except UnicodeDecodeError:  # a part of a character: never a pre-token
            continue
        except UnicodeEncodeError:
            continue
    strings = [s for s, e in zip(strings, tokenizer.encode_batch(strings, add_special_tokens=False), strict=True) if s and len(e.ids) == 1]
    found = []
    for at, codes, offsets in textcodes.slices(strings):
        _, _, first = pretokens.split(codes, offsets)
        found += [strings[at + i] for i in np.flatnonzero(np.diff(first) == 1).tolist()]
    return found


def _counts(path: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = bytelevel.load(path)
        special = bytelevel.special_strings(tokenizer)
        memo = pretokens.Memo(lambda words: [len(x) for x in bytelevel.encode_words(tokenizer, words)], dict.fromkeys(shared.value, 1))
        for batch in textcodes.pieces(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            total = np.zeros(len(texts), np.int64)
            for at, codes, offsets in textcodes.slices(texts):
                starts, ends, first = pretokens.split(codes, offsets)
                place, counts = memo.values(codes, starts, ends)
                sums = np.concatenate(([0], np.cumsum(np.array(counts, np.int64)[place] if len(place) else np.zeros(0, np.int64))))
                total[at : at + len(offsets) - 1] = sums[first[1:]] - sums[first[:-1]]
            for i, text in enumerate(texts):
                if text and any(s in text for s in special):
                    total[i] = len(bytelevel.encode_text(tokenizer, text))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(total)], names=[*batch.schema.names[:-1], "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Counts are the library's for the byte-level file at ``path`` (which every worker reads), without
    added special tokens; special strings inside a text are cut out as the library does by default.
    Null and empty texts count 0; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(single_tokens(path))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("_text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return rows.mapInArrow(_counts(path, shared), schema).withColumn("over_limit", F.col("n_tokens") > limit)
