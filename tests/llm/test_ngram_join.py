"""The Jaccard join against all pairs, on texts with copies, near copies and odd rows."""

import random
import re

import numpy as np
import pytest

from parqyard.llm import ngram_join
from parqyard.llm.components import components


def shingle_set(t, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, num, den):
    sets = [shingle_set(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if sets[i] and ids else doc, links[i]))
    return sorted(out, key=str)


def corpus(seed, n_docs=160):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(12, 60))] for _ in range(12)]
    rows = []
    for i in range(n_docs):
        t = list(rnd.choice(base))
        for _ in range(rnd.choice((0, 0, 1, 1, 2, 3))):
            t[rnd.randrange(len(t))] = rnd.choice(words).upper() if rnd.random() < 0.3 else f"x{rnd.randrange(400)}"
        rows.append((i, rnd.choice((" ", "\n", "  ")).join(t)))
    return rows + [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "ONE  two"), (505, "one"), (None, rows[0][1]), (None, "only null has this text here"), (3, rows[3][1]), (506, "é x \xa0y"), (507, "a " * 3000), (508, "a " * 2999)]


@pytest.mark.parametrize(("n", "num", "den", "short", "block", "hot"), [(3, 9, 10, 16, 128, 1 << 17), (5, 4, 5, 2, 7, 1 << 17), (3, 1, 2, 3, 10, 4)])
def test_against_all_pairs(spark, n, num, den, short, block, hot):
    rows = corpus(n)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' as component_id", "1 as n", "2 as cls", "3 as rid")
    got = ngram_join.link(docs.repartition(5), n=n, num=num, den=den, bits=16, short=short, block_rows=block, hot_gram=hot)
    found = got.collect()
    assert sorted((tuple(r)[:4] for r in found), key=str) == brute(rows, n, num, den)
    by_label = {}
    for r in found:
        assert (r["label"] is None) == (r["n_shingles"] == 0)
        if r["label"] is not None:
            by_label.setdefault(r["label"], set()).add(r["component_id"])
    assert all(len(ids) == 1 for ids in by_label.values()) and len(by_label) >= len({r["component_id"] for r in found if r["label"] is not None})


def test_every_list_is_held_to_its_count():
    """Without enough shared prefix n-grams nothing is verified, whatever brought two classes together."""
    a, b = np.arange(100, dtype=np.uint64), np.arange(100, dtype=np.uint64)
    row = lambda k, s, head, level: (0, 0, 0, 0, k, 1, level, head.tobytes(), s.tobytes())
    assert list(ngram_join._verified([row(1, a, a[:3], 3), row(2, b, b[1:4], 3)], 9, 10)) == []
    (got,) = ngram_join._verified([row(1, a, a[:3], 2), row(2, b, b[1:4], 3)], 9, 10)
    assert got.to_pydict() == {"a": [1, 2], "b": [1, 1], "links": [1, 1]}


def test_no_rows(spark):
    assert ngram_join.link(spark.createDataFrame([], "doc_id long, text string"), bits=16).count() == 0
    assert [tuple(r)[:4] for r in ngram_join.link(spark.createDataFrame([(7, None)], "doc_id long, text string"), bits=16).collect()] == [(7, 0, 7, 0)]


def test_prefixes_meet():
    """Linked sets share at least the smaller number of matches among their indexed n-grams."""
    rnd = np.random.default_rng(2)
    for _ in range(300):
        freq = rnd.integers(1, 50, 1 << 16).astype(np.uint32)
        a = np.unique(rnd.integers(0, 2**63, rnd.integers(1, 60)).astype(np.uint64))
        b = np.unique(np.concatenate([a[rnd.random(len(a)) < 0.95], rnd.integers(0, 2**63, 2).astype(np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if 5 * shared >= 4 * (len(a) + len(b) - shared):
            (x, m), (y, k) = (ngram_join.prefix(s, freq, 16, 4, 5, 6, 0.0, v) for s, v in ((a, 8.0), (b, 0.1)))
            assert len(np.intersect1d(x, y)) >= min(m, k)


def test_components(spark):
    rnd = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(100, x) for x in range(101, 160)] + [(rnd.randrange(200, 300), rnd.randrange(200, 300)) for _ in range(60)] + [(400, 400)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    assert got == {x: find(x) for a, b in edges for x in (a, b) if a != b}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
