import base64
import cProfile
import hashlib
import json
import random
import time
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pyspark
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from carelattice.llm import bpe_fold, bytelevel, pretokens, queries, sstable, textcodes, token_counts

from . import brute

JSON, RANKS = public.path("byte_bpe_50k.json"), public.path("byte_bpe_multi_50k.tiktoken")
PARTS = ["a", "Z", "é", "日", "1", "²", " ", " ", "\n", "\t", " ", "　", "\x85", "\x1c", "'", "'s", "'re", "'ll", "'t", "!", "?", "👍", "́", "​", "<|endoftext|>", "\U000105c0"]


def texts(rows):
    return [r["text"] or "" for r in rows]


def odd_rows():
    random.seed(5)
    made = ["".join(random.choices(PARTS, k=random.randint(0, 16))) for _ in range(400)] + ["x" * 300 + "日本" * 100, "ab" * 150, "<|endoftext|>"]
    return brute.awkward() + [{"doc_id": 1000 + i, "text": t} for i, t in enumerate(made)]


def library():
    return Tokenizer.from_file(JSON)


def test_split_agrees_with_the_library():
    random.seed(4)
    made = ["".join(random.choices(PARTS, k=random.randint(0, 12))) for _ in range(5000)] + ["", " ", "''s", " 's", "'rex", "a  "]
    split, pattern = library().pre_tokenizer.pre_tokenize_str, regex.compile(public.PATTERN)
    for at, codes, offsets in textcodes.slices(made, 500):
        starts, ends, first = pretokens.split(codes, offsets)
        for i in range(len(offsets) - 1):
            got = [codes[starts[j] : ends[j]].tobytes().decode("utf-32-le") for j in range(first[i], first[i + 1])]
            assert got == [made[at + i][a:b] for _, (a, b) in split(made[at + i])]
            if "\U000105c0" not in made[at + i]:
                assert got == pattern.findall(made[at + i])


def check_counts(rows, got):
    tokenizer = library()
    want = [(r["doc_id"], len(t.encode()), n := len(tokenizer.encode(t, add_special_tokens=False).ids), n > 512) for r, t in zip(rows, texts(rows), strict=True)]
    assert brute.order(got) == brute.order(want)


def test_token_counts(spark):
    rows = odd_rows()
    check_counts(rows, token_counts.token_counts(brute.frame(spark, rows), JSON).collect())
    assert token_counts.token_counts(brute.frame(spark, []), JSON).collect() == []
    check_counts(brute.table("documents"), queries.op10_token_counts(spark, brute.SF).collect())


def test_memo_starts_anew_when_full(monkeypatch):
    monkeypatch.setattr(pretokens, "MEMO", 3)
    memo = pretokens.Memo(lambda words: [len(w) for w in words], {"seven": 5})
    for text in ("one two three", "four five six seven", "one two"):
        ((_, codes, offsets),) = textcodes.slices([text])
        starts, ends, _ = pretokens.split(codes, offsets)
        place, sizes = memo.values(codes, starts, ends)
        assert [sizes[p] for p in place] == (ends - starts).tolist()


def test_packed_ids_start_anew_when_full(monkeypatch):
    monkeypatch.setattr(pretokens, "MEMO", 4)
    memo = pretokens.Packed(lambda words: [[ord(c) for c in w] for w in words])
    for text in ("", "one two three", "four five six seven", "one two", "seven one", "one two three four five six"):
        ((_, codes, offsets),) = textcodes.slices([text])
        starts, ends, _ = pretokens.split(codes, offsets)
        ids, length = memo.ids(codes, starts, ends)
        assert ids.tolist() == codes.tolist() and length.tolist() == (ends - starts).tolist()


def test_only_byte_level_files():
    with pytest.raises(ValueError):
        token_counts.single_tokens(public.path("word_bpe_49k.json"))


def check_shards(rows, got):
    tokenizer, start, want = library(), 0, []
    for r in rows:
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert brute.order(got) == brute.order(want)


def test_shards(spark):
    rows = sorted((r for r in odd_rows() if r["doc_id"] is not None), key=lambda r: r["doc_id"])
    rows = [r for i, r in enumerate(rows) if not i or r["doc_id"] != rows[i - 1]["doc_id"]]
    rows.insert(0, {"doc_id": None, "text": "first of all"})
    check_shards(rows, sstable.encode_to_shards(brute.frame(spark, rows[::-1]), JSON).collect())
    assert sstable.encode_to_shards(brute.frame(spark, []), JSON).collect() == []
    check_shards(sorted(brute.table("documents"), key=lambda r: r["doc_id"]), queries.op5_sstable(spark, brute.SF).collect())


def test_shards_with_repeated_ids_and_lookup(spark, tmp_path):
    rows = brute.awkward()
    out = str(tmp_path / "shards")
    sstable.write_shards(brute.frame(spark, rows), JSON, out, shard_bytes=2000)
    got = sstable.read_shards(spark, out).collect()
    assert len(got) == len(rows) and sum(r.n_tokens for r in got) == max(r.start + r.n_tokens for r in got)
    found = sstable.lookup(spark, out, [22, None, 10**9]).collect()
    tokenizer = library()
    want = [(r["doc_id"], tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [2]) for r in rows if r["doc_id"] in (22, None)]
    assert sorted(((r.doc_id, r.ids) for r in found), key=str) == sorted(want, key=str)


def test_words_are_encoded_once_for_all_tasks_of_a_worker(monkeypatch, tmp_path):
    path, rows, encoded, encode = tmp_path / "own.json", odd_rows(), [], bytelevel.encode_words
    monkeypatch.setattr(bytelevel, "encode_words", lambda tokenizer, words: encoded.extend(words) or encode(tokenizer, words))
    monkeypatch.setattr(pyspark.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 0))
    batch = pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in rows], pa.int64()), pa.array(texts(rows))], names=["doc_id", "text"])

    def task():
        (shard,) = sstable._build(str(path), 2, sstable.SHARD_BYTES)(iter([batch]))
        tokenizer = Tokenizer.from_file(str(path))
        assert [ids.tolist() for _, ids in sstable.Reader(shard.column(0)[0].as_py() + b"\n").scan()] == [[*tokenizer.encode(t, add_special_tokens=False).ids, 2] for t in texts(rows)]

    path.write_text(open(JSON).read())
    task()
    assert len(encoded) == len(set(encoded)) > 100
    task()
    assert len(encoded) == len(set(encoded))
    # Another file has a memo of its own.
    spec = json.loads(path.read_text())
    spec["model"]["merges"] = spec["model"]["merges"][:200]
    path = tmp_path / "short.json"
    path.write_text(json.dumps(spec))
    task()


def test_shard_of_many_blocks():
    writer = sstable.Writer(3, 4)
    ids = {i * 7 - 500: np.arange(i % 50) + (70_000 if i % 3 == 0 else 0) for i in range(20_000)}
    for doc, own in sorted(ids.items()):
        writer.add(doc, own)
    reader = sstable.Reader(writer.finish() + b"\n")
    assert len(reader.index) > 5 and (reader.part, reader.sequence, reader.entries) == (3, 4, 20_000)
    assert all((a == ids[d]).all() for d, a in reader.scan())
    for doc in random.Random(1).sample(sorted(ids), 200):
        assert (reader.get(doc)[0] == ids[doc]).all() and reader.get(doc + 1) == []
    assert sum(reader.may_hold(d * 7 - 499) for d in range(2000)) < 60
    with pytest.raises(ValueError):
        sstable.Reader(writer.finish()[:-3] + b"xxxx")


def check_bpe(rows, got):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r, t in zip(rows, texts(rows), strict=True):
        ids = encoding.encode_ordinary(t)
        want.append((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert brute.order(got) == brute.order(want)


@pytest.mark.parametrize("most", [0, 40, 1 << 20])
def test_bpe(spark, most):
    rows = odd_rows()
    check_bpe(rows, bpe_fold.encode_and_decode(brute.frame(spark, rows), RANKS, most=most).collect())
    assert bpe_fold.encode_and_decode(brute.frame(spark, []), RANKS).collect() == []


def test_bpe_query(spark):
    check_bpe(brute.table("documents"), queries.op7_bpe(spark, brute.SF).collect())


def test_words_that_collide_keep_their_own_tokens(spark):
    rows = [{"doc_id": i, "text": f"{w} end"} for i, w in enumerate(brute.thue_morse(1024) + brute.thue_morse(2048))]
    docs = brute.frame(spark, rows).coalesce(1)
    check_counts(rows, token_counts.token_counts(docs, JSON).collect())
    check_shards(rows, sstable.encode_to_shards(docs, JSON).collect())
    check_bpe(rows, bpe_fold.encode_and_decode(docs, RANKS).collect())


@pytest.mark.parametrize("word", ["=" * 1_200_000, "ea" * 500_000, "=" * 1023, "=" * 1024, "=-" * 2000, "".join(brute.thue_morse(4096)), "aab" * 3000])
def test_very_long_words(word):
    """Over a million bytes that can't be cut, merged in seconds."""
    ranks = bpe_fold.load_ranks(RANKS)
    began = time.time()
    ids = bpe_fold.merge_long(word.encode(), ranks)
    assert time.time() - began < 60
    assert ids == tiktoken.Encoding("whole", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary(word)


def test_long_words_among_others(spark):
    words = ["=" * 300_000, "ea" * 40_000, "=" * 1023 + "é", "日" * 2000, "=" * 1000]
    rows = [{"doc_id": i, "text": f"a {w} b {w}\n{w}"} for i, w in enumerate(words)]
    check_bpe(rows, bpe_fold.encode_and_decode(brute.frame(spark, rows), RANKS).collect())


def test_common_words_are_laid_out_without_a_call_for_each():
    """Of 2,000 texts' words nearly all are common; Python's calls must not grow with them (1.5 a word before)."""
    ranks, rng = bpe_fold.load_ranks(RANKS), random.Random(8)
    encoding = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = [" " + "".join(rng.choices("aeioulnrstéж", k=rng.randint(2, 9))) for _ in range(20_000)]
    texts = ["".join(rng.choices(words, k=50)) for _ in range(2000)]
    known = sorted(set(words))[10:]
    batch = pa.RecordBatch.from_arrays([pa.array([w.encode() for w in known]), pa.array([encoding.encode_ordinary(w) for w in known])], names=["word", "ids"])
    common = bpe_fold.Common(pa.Table.from_batches(list(bpe_fold._pack(iter([batch])))))
    run = bpe_fold._parts(RANKS, type("Shared", (), {"value": common}))
    with cProfile.Profile() as profile:
        out = list(run(iter([pa.RecordBatch.from_arrays([pa.array(range(2000)), pa.array(texts)], names=["doc_id", "text"])])))
    assert sum(entry.callcount for entry in profile.getstats()) < 100_000 / 4
    got = [row for part in out for row in part.to_pylist()]
    assert [r["doc_id"] for r in got] == list(range(2000)) and any(r["own"] for r in got)
    for r, text in zip(got, texts, strict=True):
        own = [r["own"][i].decode() for i in r["rare"]]
        assert r["decoded"][0] + "".join(a + b for a, b in zip(own, r["decoded"][1:], strict=True)) == text
        parts = [ids or "" for ids in r["ids"]] + [",".join(map(str, encoding.encode_ordinary(w))) for w in own]
        assert sorted(",".join(filter(None, parts)).split(",")) == sorted(map(str, encoding.encode_ordinary(text)))
