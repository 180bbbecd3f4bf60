from collections import defaultdict

from carelattice.llm import queries
from carelattice.llm.mixing import fair_schedule

from . import brute


def targets(rows):
    size = defaultdict(int)
    for r in rows:
        size[r["source"]] += len(brute.WORD.findall(r["text"] or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    out, left, open_ = {}, 1.5 * sum(size.values()), set(names)
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * size[s] < level * weight[s]}
        if not full:
            return size, out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 2.0 * size[s]
            left -= out[s]
        open_ -= full
    return size, out


def queue_plainly(rows, target):
    """All turns in the order of their virtual finish times, each served from its start on at its source's rate, until all are served the budget."""
    before, turns, taken = defaultdict(int), [], [0] * len(rows)
    for i in sorted(range(len(rows)), key=lambda i: (rows[i]["text_hash"] % 2**64, rows[i]["begins"])):
        assert rows[i]["begins"] == before[rows[i]["source"]]
        before[rows[i]["source"]] += rows[i]["size"]
    for i, r in enumerate(rows):
        for n in range(2):
            if r["size"] and target[r["source"]]:
                start = r["begins"] + n * before[r["source"]]
                turns.append(((start + r["size"]) / target[r["source"]], start / target[r["source"]], i))
    low, high = 0.0, 4.0
    served = lambda time: sum(min(1.0, max(0.0, (time - start) / (end - start))) * rows[i]["size"] for end, start, i in turns)
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if served(middle) < sum(target.values()) - 1e-6 else (low, middle)
    for end, start, i in sorted(turns):
        taken[i] += min(1.0, max(0.0, (high - start) / (end - start))) * rows[i]["size"]
    return taken


def check(spark, rows, got):
    size, target = targets(rows)
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == size[r["source"]]
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(r["taken"] - words) < 1 for r, words in zip(got, queue_plainly(got, target), strict=True))
    assert all(abs(taken[s] - target[s]) < 1 for s in target)


def test_mix_of_awkward_rows(spark):
    rows = brute.awkward()
    got = [r.asDict() for r in fair_schedule(brute.frame(spark, rows)).collect()]
    check(spark, rows, got)
    again = [r.asDict() for r in fair_schedule(brute.frame(spark, rows[::-1])).collect()]
    key = lambda r: (str(r["doc_id"]), r["size"], r["taken"], str(r["source"]))
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mix_query(spark):
    got = [r.asDict() for r in queries.op9_mixing(spark, brute.SF).collect()]
    check(spark, brute.table("documents"), got)


def test_small_sources_meet_their_targets(spark):
    """At every scale each source's words are within a word of its target."""
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        found = queries.op9_mixing(spark, f"/root/testdata/{sf}").groupBy("source", "target").agg({"taken": "sum"}).collect()
        assert len(found) == 20 and all(abs(r["sum(taken)"] - r["target"]) < 1 for r in found)


def test_mix_of_nothing(spark):
    assert fair_schedule(brute.frame(spark, [])).collect() == []
    assert [r.taken for r in fair_schedule(brute.frame(spark, [{"doc_id": 1, "text": None, "source": None}])).collect()] == [0]


def test_mix_is_range_sorted_by_finish_time(spark):
    got = [r.finish for r in queries.op9_mixing(spark, brute.SF).collect() if r.finish is not None]
    assert got == sorted(got)
