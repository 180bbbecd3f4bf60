import math
import random
import tempfile
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from carelattice.llm import langid, passage_dedup, queries, toxicity
from carelattice.llm.passage_dedup import _segments, bands, remove_passages, repeated_passages
from carelattice.llm.pivot_topk import pivot_topk

from . import brute

SF = "/root/testdata/sf0.01"


def best(rows, k=5, every=50):
    clean = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(256 * x) for x in v]
            clean[i] = min(clean.get(i, w), w)
    out = []
    for q, v in clean.items():
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in clean.items() if i != q and len(w) == len(v))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return out


def test_topk_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in brute.table("embeddings", SF)]
    assert brute.order(queries.op1_pivot_topk(spark, SF).collect()) == brute.order(best(rows))


def test_topk_awkward_rows(spark):
    random.seed(2)
    rows = [(i, [random.gauss(0, 1) for _ in range(3)]) for i in range(120)] + [(i, [0.5, 0.5]) for i in range(200, 210)]
    rows += [(0, [9.0, 9.0, 9.0]), (None, [1.0, 1.0, 1.0]), (300, None), (350, []), (400, [1.0, None, 2.0]), (450, [1.0, float("nan"), 0.0]), (500, [float("inf"), 0.0, 0.0]), (550, [1.0]), (-50, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, score string, rank int")
    assert brute.order(pivot_topk(df).collect()) == brute.order(best(rows))
    assert pivot_topk(df.filter("false")).collect() == []


def viterbi_plainly(scores, penalty):
    value, back = np.zeros(scores.shape[1]), []
    for s, p in zip(scores, penalty):
        top = int(value.argmax())
        stay = value >= value[top] - p
        back.append([i if stay[i] else top for i in range(len(s))])
        value = np.where(stay, value, value[top] - p) + s
    state, out = int(value.argmax()), []
    for b in reversed(back):
        out.append(state)
        state = b[state]
    return out[::-1]


@pytest.mark.parametrize("n", [1, 5, 255, 256, 257, 1500])
def test_viterbi(n):
    random_ = np.random.default_rng(n)
    scores, penalty = random_.normal(size=(n, 4)), np.where(random_.random(n) < 0.02, 0.0, 2.0)
    got = langid.viterbi(scores, penalty)
    plain = viterbi_plainly(scores, penalty)

    def total(path):
        return sum(s[i] for s, i in zip(scores, path)) - sum(p for p, a, b in zip(penalty[1:], path, path[1:]) if a != b)

    assert abs(total(list(got)) - total(plain)) < 1e-6


def test_language_of_documents(spark):
    rows = {r["doc_id"]: r for r in brute.table("documents", SF)}
    got = queries.op8_language_id(spark, SF).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r.held_out]
    assert all(0 <= r.score <= 1 for r in got) and 150 < len(held) < 350
    assert sum(r.lang_pred == rows[r.doc_id]["lang"] for r in held) >= 0.98 * len(held)


def test_language_awkward_rows_and_spans(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.select("lang", "text"))
    rows = brute.table("documents", SF)
    english = next(r["text"] for r in rows if r["lang"] == "en")[:300]
    german = next(r["text"] for r in rows if r["lang"] == "de")[:300]
    mixed = brute.frame(spark, [{"doc_id": 1, "text": f"{english} {german}"}, {"doc_id": 2, "text": "12 !!"}, {"doc_id": 3, "text": None}, {"doc_id": None, "text": ""}])
    spans = langid.language_spans(mixed, model).orderBy("start").collect()
    assert {r.lang for r in spans} == {"en", "de"} and spans[0].lang == "en" and abs(spans[-1].start - len(english)) < 60
    got = langid.identify(mixed).collect()
    assert [r.lang_pred for r in sorted(got, key=lambda r: str(r.doc_id)) if r.doc_id in (2, 3, None)] == ["und"] * 3
    assert langid.identify(brute.frame(spark, [])).collect() == []
    assert langid.identify(brute.frame(spark, brute.awkward())).count() == len(brute.awkward())


def test_toxicity_of_documents(spark):
    """Labels here are few; texts marked toxic and held out must score above the others."""
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op2_toxicity(spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in brute.table("labels", sf)}
    held = [(got[d].score, t, got[d].predicted) for d, t in labels.items() if got[d].held_out]
    good, bad = [s for s, t, _ in held if t], [s for s, t, _ in held if not t]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
    assert sum(p for _, t, p in held if t) >= 0.85 * len(good) and sum(p for _, t, p in held if not t) <= 0.01 * len(bad)
    assert all((r.predicted == 1) == (r.score >= 0.5) for r in got.values())


def test_toxicity_awkward_rows(spark):
    rows = brute.awkward()
    docs = brute.frame(spark, rows)
    labels = spark.createDataFrame([(7, 1, 0), (7, 1, 1), (None, 1, 1), (10, 1, None), (13, 0, 5), (999, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, labels).count() == len(rows)
    empty = toxicity.toxicity(docs, labels.filter("false")).collect()
    assert all(r.score == 0.5 for r in empty) and len(empty) == len(rows)
    assert toxicity.toxicity(docs.filter("false"), labels).collect() == []


def test_toxicity_training_leaves_no_shuffles_or_broadcasts(spark):
    """What the rounds shuffle and broadcast goes with each of them; it piled up until the driver collected its garbage."""
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    labels = docs.select("doc_id", (F.instr("text", "the") > 0).cast("int").alias("toxic"))
    top = Path(spark.conf.get("spark.local.dir"))
    files = lambda: {str(f) for f in top.rglob("*") if f.name.startswith(("shuffle_", "broadcast_")) or f.parent == Path(spark.sparkContext._temp_dir)}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, was = files(), spark.conf.get(key, None)
    assert list(top.glob("blockmgr-*")) and len(toxicity.train(docs, labels).features)
    for _ in range(50):  # Spark deletes in the background
        if not files() - before:
            break
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(key, None) == was


def words(n, seed):
    random_ = random.Random(seed)
    return " ".join("".join(random_.choices("abcdefghijklmnop", k=random_.randint(2, 8))) for _ in range(n))


def test_repeated_passages(spark):
    rows = [{"doc_id": i, "text": words(300, i)} for i in range(60)]
    planted = {}
    for n, length in enumerate((51, 55, 60, 80, 120, 200)):
        passage = words(length, 1000 + n)
        for i in (n * 5, n * 5 + 1, n * 5 + 3):
            before, after = rows[i]["text"][:700], rows[i]["text"][700:]
            rows[i]["text"] = f"{before} {passage.upper() if i % 2 else passage} {after}"
            planted[i] = n * 5
    got = repeated_passages(brute.frame(spark, rows + brute.awkward()[:6])).collect()
    assert {r.doc_id: r.cluster_id for r in got} == planted
    assert {r.doc_id for r in got if r.kept} == set(planted.values())
    left = {r.doc_id: r.text for r in remove_passages(brute.frame(spark, rows), repeated_passages(brute.frame(spark, rows))).collect()}
    assert all((len(left[i]) < len(rows[i]["text"])) == (i in planted and planted[i] != i) for i in left)
    assert repeated_passages(brute.frame(spark, [])).collect() == []


def test_near_paragraphs_are_one_cluster(spark):
    base = words(60, 5).split()
    near = base[:30] + ["zzz"] + base[31:]
    rows = [{"doc_id": 1, "text": words(100, 1) + " " + " ".join(base)}, {"doc_id": 2, "text": words(100, 2) + " " + " ".join(near)}]
    assert {r.doc_id for r in repeated_passages(brute.frame(spark, rows), run_words=12).collect()} == {1, 2}
    assert bands(80, 0.95) == 2


def paragraph_links(rows, percent=80):
    """By brute force: the paragraphs (document, first word, words), and the pairs of them that are near or equal, with whether they share a band."""
    batch = pa.RecordBatch.from_arrays([pa.array([r["doc_id"] for r in rows]), pa.array([r["text"] for r in rows])], names=["doc_id", "text"])
    found = [r for out in _segments(5, bands())(iter([batch])) for r in out.to_pylist()]
    texts = {r["doc_id"]: r["text"].split() for r in rows}
    sets = [{tuple(texts[r["doc_id"]][i : i + 5]) for i in range(r["start"], r["start"] + r["n_words"] - 4)} for r in found]
    near = [(i, j) for i in range(len(found)) for j in range(i) if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return [(r["doc_id"], r["start"], r["n_words"]) for r in found], [(i, j, any(x == y for x, y in zip(found[i]["bands"], found[j]["bands"], strict=True))) for i, j in near]


def roots(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        parent[root(i)] = root(j)
    return [root(i) for i in range(n)]


def test_near_paragraphs_meet_behind_an_unlike_hub(spark):
    """Short texts that start with one common line, so that the first class of their bands is unlike; each is a near copy of one other."""
    line = words(9, 77)
    rows = [{"doc_id": i, "text": f"{line} {words(4, 2000 + i // 2)} {words(1, 4000 + i)}"} for i in range(120)]
    found, near = paragraph_links(rows)
    by_band, by_all = roots(len(found), [(i, j) for i, j, band in near if band]), roots(len(found), [(i, j) for i, j, _ in near])
    docs = lambda r: {x: {found[i][0] for i in range(len(found)) if r[i] == x} for x in set(r)}
    in_band, in_all = docs(by_band), docs(by_all)
    got = repeated_passages(brute.frame(spark, rows).coalesce(1), run_words=1).collect()
    words_in = lambda which, r: sum(n for i, (_, _, n) in enumerate(found) if len(which[r[i]]) > 1)
    assert words_in(in_band, by_band) <= sum(r.n_words for r in got) <= words_in(in_all, by_all)
    assert {d for s in in_band.values() if len(s) > 1 for d in s} <= {r.doc_id for r in got} <= {d for s in in_all.values() if len(s) > 1 for d in s}


def test_copies_that_hold_an_earlier_passage_keep_their_text_once(spark):
    """Documents 5 and 9 are copies and hold passages of 1 and 2 side by side; every word stays in some document."""
    a, b, before, after = words(60, 21), words(60, 22), words(120, 23), words(120, 24)
    rows = [{"doc_id": 1, "text": f"{words(90, 25)} {a} {words(90, 26)}"}, {"doc_id": 2, "text": f"{words(90, 27)} {b} {words(90, 28)}"}]
    rows += [{"doc_id": i, "text": f"{before} {a} {b} {after}"} for i in (5, 9)]
    docs = brute.frame(spark, rows)
    found = repeated_passages(docs).collect()
    left = {r.doc_id: set(r.text.split()) for r in remove_passages(docs, repeated_passages(docs)).collect()}
    assert {r.kept for r in found if r.doc_id == 5} == {True, False} and not any(r.kept for r in found if r.doc_id == 9)
    assert left[1] >= set(a.split()) and left[2] >= set(b.split())
    assert left[5] >= set(before.split()) | set(after.split())
    assert len(left[5] & set(a.split())) < 40 and len(left[5] & set(b.split())) < 40 and len(left[9]) < 10


def test_texts_are_cut_into_paragraphs_once(spark, tmp_path, monkeypatch):
    def counted(k, count):
        cut, folder = _segments(k, count), str(tmp_path)

        def run(batches):
            tempfile.mkstemp(dir=folder)
            return cut(batches)

        return run

    monkeypatch.setattr(passage_dedup, "_segments", counted)
    assert repeated_passages(brute.frame(spark, brute.awkward()).coalesce(1)).count()
    assert len(list(tmp_path.iterdir())) == 1


def test_passages_of_awkward_rows(spark):
    got = repeated_passages(brute.frame(spark, brute.awkward())).collect()
    assert {r.doc_id for r in got} >= {22, 25, 28} and all(r.doc_id is not None for r in got)
