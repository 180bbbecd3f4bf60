"""The models of op2 and op8 restated plainly: features, FTRL-proximal, counts, word scores, labels of whole documents."""

import math
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from carelattice.llm import langid, letters, toxicity

from . import brute
from .test_search_and_models import viterbi_plainly


def grams(text):
    """The features of a text as tuples: words, stems, pairs, pairs with one word between."""
    words = ["".join(c.lower() if len(c.lower()) == 1 else c for c in w) for w in re.findall(r"(?:[^\W\d_]|[0-9])+", text or "")]
    out = {("word", w) for w in words} | {("stem", w[:k]) for w in words for k in (4, 5) if len(w) > k}
    return out | {("pair", a, b) for a, b in zip(words, words[1:])} | {("skip", a, b) for a, b in zip(words, words[2:])}


def test_features_are_the_words_and_their_grams():
    texts = [r["text"] for r in brute.table("documents")] + [None, "", "a", "One two-three four4 fivesix", "one TWO three FOUR4 fivesiX!"]
    hashed, plain = defaultdict(set), defaultdict(set)
    for i, (h, text) in enumerate(zip(toxicity._sets(texts), texts, strict=True)):
        for x in h.tolist():
            hashed[x].add(i)
        for g in grams(text):
            plain[g].add(i)
    where = lambda found: Counter(frozenset(x) for x in found.values())
    assert where(hashed) == where(plain)


def ftrl_plainly(rounds, shards, size):
    """Per-coordinate FTRL-proximal: every shard starts from the common state, changes are averaged over the shards that met a coordinate."""
    z, n = [0.0] * size, [0.0] * size
    weight = lambda z, n: 0.0 if abs(z) <= toxicity.L1 else -(z - math.copysign(toxicity.L1, z)) / ((toxicity.BETA + math.sqrt(n)) / toxicity.ALPHA + toxicity.L2)
    for _ in range(rounds):
        changes = defaultdict(list)
        for rows in shards:
            own_z, own_n, met = list(z), list(n), set()
            for places, toxic in rows:
                used = [*places, size - 1]
                w = {i: weight(own_z[i], own_n[i]) for i in used}
                p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values())))))
                g = (p - toxic) * (toxicity.TOXIC_WEIGHT if toxic else 1.0)
                for i in used:
                    sigma = (math.sqrt(own_n[i] + g * g) - math.sqrt(own_n[i])) / toxicity.ALPHA
                    own_z[i] += g - sigma * w[i]
                    own_n[i] += g * g
                    met.add(i)
            for i in met:
                if own_n[i] != n[i]:
                    changes[i].append((own_z[i] - z[i], own_n[i] - n[i]))
        for i, c in changes.items():
            z[i] += sum(a for a, _ in c) / len(c)
            n[i] += sum(b for _, b in c) / len(c)
    return [weight(a, b) for a, b in zip(z, n, strict=True)]


def test_ftrl_learns_the_plain_weights():
    """The task's function over 200 rows of four shards, five rounds, beside the plain one: the same weights, and L1 leaves zeros."""
    rows = [r["text"] or "" for r in brute.table("documents")][:200]
    toxic = [i % 3 == 0 or "the" in rows[i][:40] for i in range(len(rows))]
    sets = [sorted(grams(t)) for t in rows]
    often = sorted(g for g, n in Counter(g for s in sets for g in s).items() if n >= toxicity.LEAST_TEXTS)
    place = {g: i for i, g in enumerate(often)}
    encoded = [[place[g] for g in s if g in place] for s in sets]
    shards = [[(encoded[i], int(toxic[i])) for i in range(len(rows)) if i % 4 == k] for k in range(4)]
    size = len(often) + 1
    z, n = np.zeros(size), np.zeros(size)
    schema = pa.schema([("shard", pa.int32()), ("toxic", pa.int32()), ("places", pa.list_(pa.int32()))])
    batches = [pa.RecordBatch.from_pydict({"shard": [i % 4 for i in part], "toxic": [int(toxic[i]) for i in part], "places": [encoded[i] for i in part]}, schema=schema) for part in (range(0, 90), range(90, len(rows)))]
    for _ in range(5):
        found = defaultdict(list)
        for out in toxicity._descend(SimpleNamespace(value=(z.copy(), n.copy())))(iter(batches)):
            for at, dz, dn in zip(*(c.to_pylist() for c in out.columns), strict=True):
                found[at].append((dz, dn))
        for at, c in found.items():
            z[at] += np.mean([a for a, _ in c])
            n[at] += np.mean([b for _, b in c])
    want = ftrl_plainly(5, shards, size)
    got = toxicity.weights_of(z, n)
    assert np.abs(got - want).max() < 1e-9 and 0 < np.count_nonzero(got) < size


def test_scores_are_the_sums_of_weights(spark):
    rows = brute.table("documents")
    labels = spark.createDataFrame([(r["doc_id"], int("the" in (r["text"] or "")[:60])) for r in rows], "doc_id long, toxic int")
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    model = toxicity.train(docs, labels)
    weight = dict(zip(model.features.tolist(), model.values.tolist(), strict=True))
    sets = {r["doc_id"]: h.tolist() for r, h in zip(rows, toxicity._sets([r["text"] for r in rows]), strict=True)}
    for r in toxicity.score(docs, model, ["doc_id"]).collect():
        total = model.bias + sum(weight.get(x, 0.0) for x in sets[r.doc_id])
        assert abs(r.score - 1 / (1 + math.exp(-max(-35.0, min(35.0, total))))) < 1e-9 and r.predicted == (r.score >= 0.5)


def letters_of(text):
    """Of each letter: its neighbours in lower case (0 beside what is no letter), as the table of letters has them."""
    letter, lower, _ = letters.tables()
    small = [int(lower[ord(c)]) if letter[ord(c)] else 0 for c in text]
    return [(([0] + small)[i], small[i], (small + [0])[i + 1]) for i in range(len(text)) if small[i]]


def buckets_of(text):
    """The triple and pair bucket of each letter, by the stated hash in Python's integers."""
    whole, m1, m2 = 2**64 - 1, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

    def mix(x):
        x = ((x ^ x >> 30) * m1) & whole
        x = ((x ^ x >> 27) * m2) & whole
        return x ^ x >> 31

    out = []
    for a, b, c in letters_of(text):
        pair = a << 21 | b
        triple = mix((pair << 21 & whole) ^ (c * 0x9E3779B97F4A7C15 & whole))
        out.append((triple & (langid.BUCKETS - 1), mix(pair) & (langid.BUCKETS - 1)))
    return out


@pytest.fixture(scope="module")
def labelled():
    rows = [r for r in brute.table("documents") if r["text"]]
    return [(r["lang"], r["text"]) for r in rows[:120]] + [("xx", "Ωμέγα καὶ ἄλφα Ж и снег"), (None, "not learned"), ("en", None), ("en", "12 345")]


def test_language_model_has_the_plain_counts(spark, labelled):
    model = langid.train(spark.createDataFrame(labelled, "lang string, text string").repartition(3))
    langs = sorted({a for a, t in labelled if a and t})
    assert model.languages == langs
    counts = {lang: (Counter(), Counter()) for lang in langs}
    scripts = {lang: Counter() for lang in langs}
    for lang, text in labelled:
        if lang and text:
            for t, p in buckets_of(text):
                counts[lang][0][t] += 1
                counts[lang][1][p] += 1
            scripts[lang].update(letters.SCRIPTS[letters.tables()[2][ord(c)]] for c in text if letters.tables()[0][ord(c)])
    for part, offset in ((0, 0), (1, langid.BUCKETS)):
        total = {lang: sum(counts[lang][part].values()) + 0.05 * langid.BUCKETS for lang in langs}
        for bucket in {b for lang in langs for b in counts[lang][part]}:
            logs = [math.log((counts[lang][part][bucket] + 0.05) / total[lang]) for lang in langs]
            mean = sum(logs) / len(logs)
            assert np.abs(model.weights[offset + bucket] - [x - mean for x in logs]).max() < 1e-4
    for i, script in enumerate(letters.SCRIPTS):
        enough = [scripts[lang][script] >= langid.SCRIPT_SHARE * max(1, sum(scripts[lang].values())) for lang in langs]
        assert model.allowed[i].tolist() == (enough if any(enough) else [True] * len(langs))


def test_language_of_whole_documents_plainly(spark, labelled):
    """Word scores, the walk over words and the share of letters, document by document."""
    model = langid.train(spark.createDataFrame(labelled, "lang string, text string"))
    texts = [(i, t) for i, (_, t) in enumerate(labelled)] + [(900, labelled[0][1][:200] + " " + next(t for a, t in labelled if a == "de")[:200]), (901, "…"), (902, "Ж")]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(texts, "doc_id long, text string"), model, ["doc_id"]).collect()}
    letter, _, script = letters.tables()
    for i, text in texts:
        words = []
        for at, c in enumerate(text or ""):
            if letter[ord(c)]:
                if at and letter[ord(text[at - 1])]:
                    words[-1].append(at)
                else:
                    words.append([at])
        if not words:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        each = dict(zip([p for w in words for p in w], buckets_of(text), strict=True))
        scores = []
        for w in words:
            own = 0.5 * sum((model.weights[each[p][0]] + model.weights[langid.BUCKETS + each[p][1]]).astype(float) for p in w)
            scores.append(own - 1e4 * ~model.allowed[script[ord(text[w[0]])]])
        path = viterbi_plainly(np.array(scores), [0.0] + [langid.PENALTY] * (len(words) - 1))
        share = Counter()
        for w, s in zip(words, path, strict=True):
            share[s] += len(w)
        best = min(share, key=lambda s: (-share[s], s))
        assert got[i].lang_pred == model.languages[best] and abs(got[i].score - share[best] / sum(share.values())) < 1e-9
