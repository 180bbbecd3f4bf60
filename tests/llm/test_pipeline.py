from collections import Counter, defaultdict

import corpus_pipeline as pipeline
from carelattice.llm.langid import identify

from . import brute, test_mixing
from .test_tokens import check_bpe

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "score", "lang_pred", "_id", "row", "_gone"]


def rows_of(df):
    assert df.columns == COLUMNS
    return [r.asDict() for r in df.collect()]


def same(a, b):
    key = lambda r: tuple(str(r[c]) for c in COLUMNS)
    assert Counter(map(key, a)) == Counter(map(key, b))


#: Names that the operators use themselves.
CLASHES = {"keep_id": "score", "key": "lang_pred", "a": "_id", "b": "row", "n": "_gone"}


def inputs(spark):
    real = [dict(r, keep_id="x", key=1, a=2, b=3, n=4) for r in brute.table("documents")]
    return tuple(brute.frame(spark, rows).withColumnsRenamed(CLASHES) for rows in (real, brute.awkward(), []))


def test_language_stage(spark):
    for docs in inputs(spark):
        rows = rows_of(docs)
        good = {(r.doc_id, r.lang_pred) for r in identify(docs.select("doc_id", "lang", "text")).collect() if r.lang_pred != "und" and r.score >= 0.5}
        ids = {i for i, _ in good}
        got = rows_of(pipeline.language_id(spark, docs, ""))
        if len({r["doc_id"] for r in rows}) == len(rows):
            assert {r["doc_id"] for r in got} == ids
        assert all(r["text"] and any(c.isalpha() for c in r["text"]) and r["lang"] for r in got)


def test_exact_stage(spark):
    for docs in inputs(spark):
        rows = rows_of(docs)
        want = {(d[0], d[4]) for d in brute.dedup(rows) if d[3]}
        got = rows_of(pipeline.exact_copies(spark, docs, ""))
        assert len(got) == len(want) == len({d[4] for d in brute.dedup(rows)})
        assert {(d[0], d[4]) for d in brute.dedup(got)} == want


def test_near_stage(spark):
    for docs in inputs(spark):
        rows = rows_of(docs)
        stays = [r for r, f in zip(rows, brute.jaccard(rows, 5, 80), strict=True) if f[2] == r["doc_id"]]
        same(rows_of(pipeline.near_copies(spark, docs, "")), stays)


def test_mix_stage(spark):
    for docs in inputs(spark):
        rows = rows_of(docs)
        got = rows_of(pipeline.mix(spark, docs, ""))
        size, target = test_mixing.targets(rows)
        words, longest, often = defaultdict(int), defaultdict(int), Counter(str(r) for r in rows)
        for r in rows:
            longest[r["source"]] = max(longest[r["source"]], len(brute.WORD.findall(r["text"] or "")))
        for r in got:
            words[r["source"]] += len(brute.WORD.findall(r["text"]))
        assert all(abs(words[s] - target[s]) <= max(longest.values()) + 1 for s in target)
        assert abs(sum(words.values()) - sum(target.values())) <= max(longest.values(), default=0) / 2 + 1
        assert all(n <= 2 * often[r] for r, n in Counter(str(r) for r in got).items())


def test_encode_stage(spark):
    docs = inputs(spark)[1]
    check_bpe(rows_of(docs), pipeline.encode(spark, docs, "").collect())


def test_run_follows_the_stages(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, brute.SF)
    assert brute.order(pipeline.run(spark, brute.SF).collect()) == brute.order(docs.collect())


def test_exact_stage_settles_ties_alike(spark):
    """One identifier with several texts of equal length that are equal without white space: the smallest text stays."""
    rows = [{"doc_id": 4, "text": t} for t in ("a\tb", "a b", "a\nb", "a b")] + [{"doc_id": 9, "text": "ab"}]
    for order in (rows, rows[::-1]):
        assert [r["text"] for r in pipeline.exact_copies(spark, brute.frame(spark, order), "").collect()] == ["a\tb"]
