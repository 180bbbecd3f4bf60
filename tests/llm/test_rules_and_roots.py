import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from carelattice.llm import merkle, quality_rules, queries, whitening

from . import brute


def rules(row: dict) -> tuple:
    text = row["text"] or ""
    words = brute.WORD.findall(text)
    runs = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {p for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if brute.WORD.search(x)]
    n = len(words)
    failed = n < 50 or 100 * len(covered) > 50 * n
    return row["doc_id"], n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules_awkward_rows(spark):
    line = "a b c d\n"
    rows = [dict(r) for r in brute.awkward()] + [
        {"doc_id": 900, "text": line * 30}, {"doc_id": 901, "text": "x y " * 40000}, {"doc_id": 902, "text": "A b\r\nA b\nA b\r\n \n\n"}, {"doc_id": 903, "text": "#|<> $5 50% " * 20},
        {"doc_id": 904, "text": "wait ...\nend…\nno."}, {"doc_id": 905, "text": "SHOUT ÑLL!! " * 30}, {"doc_id": 906, "text": "p q r"}, {"doc_id": 907, "text": "p q r p"}, {"doc_id": 908, "text": "z p q"},
    ]
    found = quality_rules.quality_rules(brute.frame(spark, rows).coalesce(1))
    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert brute.order(found.select(*names).collect()) == brute.order(map(rules, rows))
    more = {r.doc_id: r for r in found.filter("doc_id >= 900").withColumn("rules", quality_rules.failed_rules(F.col("fail_bits"))).collect()}
    assert more[904].n_ellipsis_lines == 2 and "cut_lines" in more[904].rules and not more[904].kept
    assert "upper_case" in more[905].rules and "many_symbols" in more[903].rules and "repeated_lines" in more[900].rules
    assert quality_rules.quality_rules(brute.frame(spark, [])).collect() == []


def test_quality_policies_of_a_ledger(spark):
    docs = spark.read.parquet(f"{brute.SF}/documents.parquet")
    kept = quality_rules.ledger(docs).cache()
    rows = kept.collect()
    old, new = quality_rules.policy(version=1), quality_rules.policy()
    assert (old.version, new.version) == (1, 2)
    names = list(quality_rules.RULES)
    failed = [{names[i] for i in range(len(names)) if r.fail_bits >> i & 1} for r in rows]
    drops = lambda p, f: bool(f & set(p.strict)) or len(f & set(p.lenient)) > p.most
    for p in (old, new):
        assert [r.kept for r in quality_rules.verdict(kept, p).collect()] == [not drops(p, f) for f in failed]
    for r in quality_rules.ablation(kept).collect():
        p = quality_rules.policy(r.policy, r.version)
        alone = [x.n_words for x, f in zip(rows, failed, strict=True) if drops(p, f) and not drops(p, f - {r.rule})]
        assert (r.n_docs, r.n_dropped, r.n_failed) == (len(rows), sum(drops(p, f) for f in failed), sum(r.rule in f for f in failed))
        assert (r.n_alone, r.words_alone) == (len(alone), sum(alone))
    assert {r.n_docs for r in quality_rules.ablation(kept.limit(0)).collect()} == {0}
    whole = quality_rules.profile(kept).first()
    assert set(whole.some) == set().union(*failed) and set(whole.every) == set.intersection(*failed)
    with pytest.raises(KeyError):
        quality_rules.policy("none")


def test_good_documents_stay_and_most_bad_ones_go(spark):
    found = queries.op11_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    rates = {r.quality: r.rate for r in found.filter("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("rate")).collect()}
    assert rates[1] == 1.0 and rates[0] < 0.3


def h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row: dict, text: str | None) -> str:
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row["doc_id"], row.get("source"), row.get("lang"), row.get("n_chars"), text)))


def levels_of(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def proven(rows: list[dict]) -> list[tuple]:
    trees: dict = {}
    for row in rows:
        text = row["text"]
        tampered = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0 and text is not None
        claimed = leaf_of(row, "".join(c.lower() if "A" <= c <= "Z" else c for c in text)) if tampered else leaf_of(row, text)
        trees.setdefault(row.get("lang"), []).append((row["doc_id"] is not None, row["doc_id"] or 0, leaf_of(row, text), claimed, row["doc_id"]))
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    lower = {t: levels_of([x[2] for x in sorted(trees[t])]) for t in names}
    top = levels_of([lower[t][-1][0] for t in names])
    out = []
    for at, t in enumerate(names):
        for i, (_, _, own, claimed, doc_id) in enumerate(sorted(trees[t])):
            node, proof = claimed, ""
            for levels, place in ((lower[t], i), (top, at)):
                for level in levels[:-1]:
                    run = level[place // 8 * 8 : place // 8 * 8 + 8]
                    before, after = "".join(run[: place % 8]), "".join(run[place % 8 + 1 :])
                    node, proof, place = h(before, node, after), proof + before + after, place // 8
            out.append((doc_id, own, lower[t][-1][0], top[-1][0], h(proof), node, node == top[-1][0]))
    return out


def test_merkle_awkward_rows(spark):
    rows = brute.awkward()
    assert brute.order(merkle.dataset_manifest(brute.frame(spark, rows)).collect()) == brute.order(proven(rows))
    one = [{"doc_id": 3, "text": "Alone", "lang": "x"}]
    assert brute.order(merkle.dataset_manifest(brute.frame(spark, one)).collect()) == brute.order(proven(one))
    assert merkle.dataset_manifest(brute.frame(spark, [])).collect() == []


@pytest.mark.parametrize("block", [8, 64])
def test_merkle_many_superblocks(spark, block):
    """Trees of exactly one superblock, one more, and of several levels of superblocks; more than eight languages; a language with a third of the rows."""
    counts = {None: 1, "": 2, "a": 8, "b": 9, "c": 64, "d": 65, "e": 700, "é": 3, "z": 513, **{f"l{i}": i for i in range(1, 9)}}
    rows = [{"doc_id": i, "text": f"Text {i} {lang}", "lang": lang} for i, lang in enumerate(x for lang, n in counts.items() for x in [lang] * n)]
    np.random.default_rng(1).shuffle(rows)
    found = merkle.dataset_manifest(brute.frame(spark, rows).repartition(7), with_paths=True, block=block).collect()
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert brute.order([r[n] for n in names] for r in found) == brute.order(proven(rows))
    for r in found[::50]:
        assert merkle.fold(r.leaf, r.path) == r.root and h(merkle.siblings(r.path)) == r.proof_sha256


def whole_vectors(rows: list[dict]) -> list[tuple]:
    return [(r["vec_id"], [int(np.floor(256 * float(c))) for c in r["embedding"]]) for r in rows if r["embedding"] and all(c is not None and np.isfinite(c) for c in r["embedding"])]


def check_whitening(found, vectors: list[tuple], most: int = 4):
    """Against a plain computation; axes are compared up to sign, and by what they span where eigenvalues are equal."""
    fit = np.array(sorted({tuple(x) for _, x in vectors}), object)
    n, total = len(fit), fit.sum(0)
    centred = np.array([[float(n * a - s) / n for a, s in zip(x, total, strict=True)] for x in fit])
    values = np.linalg.eigvalsh(centred.T @ centred / n)[::-1]
    by_id: dict = {}
    for r in found:
        assert r.n == n
        by_id.setdefault(r.vec_id, {})[r.component] = r
    for vec_id, x in vectors:
        own = by_id[vec_id]
        assert sorted(own) == list(range(1, min(most, len(total)) + 1))
        for c, r in own.items():
            assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, total, strict=True))
            assert abs(r.explained - values[c - 1] / values.sum()) <= 1e-9
    scores = np.array([[by_id[v][c].whitened for c in sorted(by_id[v])] for v in {tuple(x): v for v, x in vectors}.values()])
    assert np.abs(scores.T @ scores / n - np.eye(scores.shape[1])).max() < 1e-8
    assert all(r.identity_error < 1e-8 for r in found)
    return scores


def test_whitening_query(spark):
    rows = brute.table("embeddings")
    check_whitening(queries.op13_whitening(spark, brute.SF).collect(), whole_vectors(rows))


def test_whitening_awkward_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(c) for c in rng.normal(size=6) * [9, 3, 1, 0.5, 0.2, 0.1]]) for i in range(200)]
    rows += [(500, rows[0][1]), (0, rows[0][1]), (None, rows[3][1])] * 30
    odd = [(600, None), (601, []), (602, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (603, [float("nan")] * 6), (604, [float("inf")] * 6), (605, [1.0, 2.0])]
    frame = lambda r: spark.createDataFrame([(v, x, 7, "n") for v, x in r], "vec_id long, embedding array<float>, component int, n string").repartition(5)
    found = whitening.whiten(frame(rows + odd)).collect()
    near = lambda v: [float(np.float32(c)) for c in v]
    check_whitening(found, whole_vectors([{"vec_id": v, "embedding": near(x)} for v, x in rows]))
    assert len(found) == 4 * len(rows)
    assert whitening.whiten(frame([])).collect() == [] and whitening.whiten(frame(odd[:5])).collect() == []
    same = whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert len(same) == 4 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(1, 0, None, 0.0, 0.0)}
    line = whitening.whiten(frame([(i, [float(i), 0.0, 2.0 * i]) for i in range(9)])).collect()
    assert {r.component for r in line if r.whitened is not None} == {1} and max(r.identity_error for r in line) < 1e-10


@pytest.mark.parametrize("spread", ["far", "close", "equal", "steep"])
def test_eigenvectors_are_refined(spread):
    """Clusters far below float32's resolution are told apart, and equal eigenvalues still give orthonormal vectors."""
    rng = np.random.default_rng(3)
    basis = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    values = {
        "far": np.linspace(40, 1, 40), "close": np.r_[1 + np.arange(6) * 1e-8, np.linspace(0.5, 0.1, 34)][np.argsort(-np.r_[1 + np.arange(6) * 1e-8, np.linspace(0.5, 0.1, 34)])],
        "equal": np.r_[np.full(5, 2.0), np.linspace(1, 0.1, 35)], "steep": np.logspace(0, -11, 40),
    }[spread]
    matrix = (basis * values) @ basis.T
    matrix = (matrix + matrix.T) / 2
    found, x = whitening.eigen(matrix, 6)
    assert np.abs(x.T @ x - np.eye(6)).max() < 1e-13
    assert np.abs(matrix @ x - x * found).max() < 4e-15 * values[0]
    assert np.allclose(found, values[:6], rtol=1e-12)
    start = np.linalg.eigh(matrix.astype(np.float32))[1][:, ::-1][:, :6].astype(float)
    assert np.abs(matrix @ start - start * found).max() > 1e-9  # what float32 alone gives


def test_polish_gains_on_doubles():
    rng = np.random.default_rng(4)
    a = rng.normal(size=(60, 60))
    a = a + a.T
    start = np.linalg.eigh(a.astype(np.float32))[1]
    values, x, near = whitening.refine(a, start)
    _, best = whitening.polish(a, values, x, 4, near)
    wide = a.astype(np.longdouble)
    left = lambda v: float(np.abs(wide @ v - v * (v * (wide @ v)).sum(0)).max())
    assert left(best) <= left(x[:, :4].astype(np.longdouble)) and left(best) < 1e-15
