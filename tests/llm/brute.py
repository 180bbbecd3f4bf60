"""Plain restatements of the contracts, and small tables with the awkward cases."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, key int, a int, b int, n int"


def table(name: str, sf: str = SF) -> list[dict]:
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


def awkward() -> list[dict]:
    """Nulls, empty and very long texts, repeated rows, near copies, boilerplate, names that clash."""
    words = "the cat sat on a mat while seven small green birds sang about rivers and old stone bridges over cold water".split()
    base = " ".join(words[(i * 7 + i // 5) % len(words)] + str(i % 37) for i in range(240))
    near = [base.replace("cat8", "dog"), base.replace("birds21", "x"), base + " end", base.upper()]
    texts = [None, "", " \t\n", "one", "One", "one two three", "ONE  two\nthree", base, base, base.replace(" ", "\n"), *near, "é" * 50, "日本語 テキスト です よ ね", base * 60, "one\x00two", "👍 ok 👍 ok 👍"]
    rows = [{"doc_id": i * 3 + 1, "text": t, "lang": ("en", None)[i % 2], "source": ("a", "b", None, "é", "Z")[i % 5]} for i, t in enumerate(texts)]
    rows += [rows[7], rows[7], {"doc_id": None, "text": base, "lang": None, "source": None}, {"doc_id": None, "text": None, "lang": "en", "source": "a"}]
    return [{"doc_id": r["doc_id"], "text": r["text"], "lang": r["lang"], "source": r["source"], "n_chars": None, "keep_id": "x", "key": 1, "a": 2, "b": 3, "n": 4} for r in rows]


def thue_morse(n: int) -> tuple[str, str]:
    """Two words of n letters a and b that collide in any polynomial hash modulo a power of two (from n = 1024 on)."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def frame(spark, rows: list[dict]):
    return spark.createDataFrame([tuple(r.get(c.split()[0]) for c in SCHEMA.split(", ")) for r in rows], SCHEMA)


def dedup(rows: list[dict]) -> list[tuple]:
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r["text"] or "")].append((-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0, r["doc_id"]))
    out = []
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            out.append((m[3], best[3], len(members), m[0] == best[0] and m[3] == best[3], hashlib.sha256(norm.encode()).hexdigest()))
    return out


def shingle_set(text: str | None, k: int) -> set[tuple]:
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def jaccard(rows: list[dict], k: int, percent: int) -> list[tuple]:
    sets = [shingle_set(r["text"], k) for r in rows]
    parent = {r["doc_id"]: r["doc_id"] for r in rows if r["doc_id"] is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    pairs = {(i, j) for found in where.values() for i in found for j in found if i < j}
    for i, j in pairs:
        if rows[i]["doc_id"] is None or rows[j]["doc_id"] is None:
            continue
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((root(rows[i]["doc_id"]), root(rows[j]["doc_id"])))
            parent[b] = a
    return [(r["doc_id"], len(s), None if r["doc_id"] is None else root(r["doc_id"])) for r, s in zip(rows, sets, strict=True)]


def order(rows) -> list[tuple]:
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))
