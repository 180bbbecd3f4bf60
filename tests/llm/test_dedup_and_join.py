import numpy as np
import pyarrow as pa
import pytest

from carelattice.llm import queries
from carelattice.llm.exact_dedup import exact_dedup
from carelattice.llm import textcodes
from carelattice.llm.graph import components
from carelattice.llm.jaccard_join import Bands, _members, chunk_keys, jaccard_components, keep_smallest

from . import brute


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_exact_dedup_awkward_rows(spark, partitions):
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = brute.awkward()
        assert brute.order(exact_dedup(brute.frame(spark, rows)).collect()) == brute.order(brute.dedup(rows))
        many = [dict(rows[7], doc_id=i) for i in range(300)] + rows
        assert brute.order(exact_dedup(brute.frame(spark, many)).collect()) == brute.order(brute.dedup(many))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_exact_dedup_query(spark):
    assert brute.order(queries.op3_exact_dedup(spark, brute.SF).collect()) == brute.order(brute.dedup(brute.table("documents")))


def test_exact_dedup_empty_table(spark):
    assert exact_dedup(brute.frame(spark, [])).collect() == []


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_jaccard_awkward_rows(spark, k, percent):
    rows = brute.awkward()
    got = jaccard_components(brute.frame(spark, rows), k, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert brute.order(got) == brute.order(brute.jaccard(rows, k, percent))


def test_jaccard_query(spark):
    rows = brute.table("documents")
    got = queries.op4_jaccard_join(spark, brute.SF).select("doc_id", "n_shingles", "component_id").collect()
    assert brute.order(got) == brute.order(brute.jaccard(rows, 4, 85))


def test_jaccard_chain_of_copies(spark):
    """Each text links with the next only, so the component needs links that miss the smallest member."""
    words = [f"w{i}" for i in range(200)]
    rows, text = [], list(words)
    for i in range(40):
        rows.append({"doc_id": 500 - i, "text": " ".join(text)})
        for j in range(5):
            text[(i * 5 + j) % 200] = f"x{i}_{j}"
    got = jaccard_components(brute.frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert brute.order(got) == brute.order(brute.jaccard(rows, 4, 85))


def test_jaccard_one_id_for_two_texts(spark):
    rows = [{"doc_id": 5, "text": "a b c d e f"}, {"doc_id": 5, "text": "g h i j k l"}, {"doc_id": 7, "text": "a b c d e f"}, {"doc_id": 3, "text": "g h i j k l"}]
    got = jaccard_components(brute.frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert brute.order(got) == brute.order(brute.jaccard(rows, 4, 85))


def test_jaccard_copy_with_a_second_text(spark):
    """5's first text is a copy of 1's, its second one is near 7's."""
    text = [f"w{i}" for i in range(60)]
    rows = [{"doc_id": 1, "text": "a b c d e f"}, {"doc_id": 5, "text": "a b c d e f"}, {"doc_id": 5, "text": " ".join(text)}, {"doc_id": 7, "text": " ".join(text[:-1] + ["x"])}]
    got = jaccard_components(brute.frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert brute.order(got) == brute.order(brute.jaccard(rows, 4, 85))


def test_jaccard_empty_table(spark):
    assert jaccard_components(brute.frame(spark, [])).collect() == []


def test_every_linked_pair_shares_a_key():
    random = np.random.default_rng(3)
    bands = Bands(85)
    for size in list(range(1, 90)) + [200, 431, 1000, 3000]:
        a = np.unique(random.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
        for _ in range(12):
            drop = int(random.integers(0, size * 15 // 100 + 1))
            b = random.permutation(a)[drop:]
            grow = int(random.integers(0, size * 15 // 100 + 1))
            b = np.unique(np.concatenate([b, random.integers(0, 2**63, grow, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= 85 * (len(a) + len(b) - both) and len(a) and len(b) and not np.array_equal(a, b):
                assert len(np.intersect1d(chunk_keys(a, bands), chunk_keys(b, bands)))


def test_components_of_chain_and_star(spark):
    chain = [(i + 1, i) for i in range(10, 60)] + [(100, i) for i in range(101, 140)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 10 for i in range(10, 61)}, **{i: 100 for i in range(100, 140)}}


def test_words_that_collide_are_told_apart(spark):
    one, other = brute.thue_morse(1024)
    ((_, codes, offsets),) = textcodes.slices([f"{one} {other} {one}"])
    starts, ends, _ = textcodes.runs(~textcodes.blank(codes), offsets)
    assert len(set(textcodes.span_hashes(codes, starts, ends).tolist())) == 1
    words, place = textcodes.spans(codes, starts, ends)
    assert words == [one, other] and place.tolist() == [0, 1, 0]
    rows = [{"doc_id": 1, "text": f"x y z {one} u v"}, {"doc_id": 2, "text": f"x y z {other} u v"}]
    got = jaccard_components(brute.frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    assert brute.order(got) == [(1, 3, 1), (2, 3, 2)]


def test_shingles_of_one_hash_count_by_their_words():
    words = np.array([1, 2, 3, 1, 2, 4])
    same = textcodes.Shingled(words, np.zeros(4, np.uint64), 3)
    assert same.size == 4
    assert textcodes.Shingled(np.array([1, 2, 3, 1, 2, 3]), np.array([5, 6, 7, 5], np.uint64), 3).size == 3
    a, b = (textcodes.Shingled(np.array(w), np.array([9], np.uint64), 3) for w in ([1, 2, 3], [1, 2, 5]))
    assert (a.shared(b), a.shared(a)) == (0, 1)


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("size", [40, 400, 1000])
def test_unlinked_sets_share_few_keys(percent, size):
    """Sets that have nothing in common: pairs of one bucket must not grow with their square."""
    random = np.random.default_rng(size)

    def pairs(n: int) -> int:
        keys = np.concatenate([chunk_keys(np.unique(random.integers(0, 2**64, size, dtype=np.uint64)), Bands(percent)) for _ in range(n)])
        counts = np.unique(keys, return_counts=True)[1]
        return int((counts * (counts - 1) // 2).sum())

    assert pairs(2000) <= 20


def test_sets_with_many_empty_chunks_share_a_key():
    """All shingles in few chunks: pairs are found by their least shingles."""
    random = np.random.default_rng(8)
    a = np.unique(random.integers(0, 2**58, 300, dtype=np.uint64))
    for i in range(20):
        b = np.unique(np.concatenate([random.permutation(a)[20:], random.integers(0, 2**58, 20, dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        assert 100 * both >= 80 * (len(a) + len(b) - both)
        assert len(np.intersect1d(chunk_keys(a, Bands(80)), chunk_keys(b, Bands(80))))


def test_members_of_keys_over_batches():
    random = np.random.default_rng(1)
    rows = sorted({(int(k), int(i)) for k, i in zip(random.integers(0, 300, 900), random.integers(0, 99, 900))})
    cut = [pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows[a : a + 7]], pa.int64()) for c in (0, 1)], names=["key", "id"]) for a in range(0, len(rows), 7)]
    got = [tuple(r.values()) for out in _members(iter(cut)) for r in out.to_pylist()]
    first = {k: min(i for x, i in rows if x == k) for k, _ in rows}
    assert got == [(k, first[k], i) for k, i in rows if i != first[k]]


def test_texts_of_one_passage_that_link_with_each_other_only(spark):
    """All texts hold one long passage, so their buckets' first is unlike; each is near one other."""
    passage = [f"p{i}" for i in range(150)]
    rows = []
    for n in range(60):
        own = [f"x{n // 2}_{i}" for i in range(60)]
        own[7 + n % 2] = f"y{n}"
        rows.append({"doc_id": n, "text": " ".join(passage + own)})
    got = jaccard_components(brute.frame(spark, rows)).select("doc_id", "n_shingles", "component_id").collect()
    want = brute.order(brute.jaccard(rows, 4, 85))
    assert brute.order(got) == want and len({w[2] for w in want}) == 30


def test_keep_smallest_keeps_any_columns(spark):
    rows = brute.awkward()
    docs = brute.frame(spark, rows).withColumnsRenamed({"a": "_gone", "b": "row", "key": "component_id"})
    kept = keep_smallest(docs)
    assert kept.columns == docs.columns
    stays = [(r["doc_id"], r["text"]) for r, f in zip(rows, brute.jaccard(rows, 5, 80), strict=True) if f[2] == r["doc_id"]]
    assert brute.order(kept.select("doc_id", "text").collect()) == brute.order(stays)
    assert keep_smallest(docs.filter("false")).collect() == []
