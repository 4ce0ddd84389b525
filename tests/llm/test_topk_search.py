"""Top-k search against all products, with ties, repeats and vectors that take no part."""

import numpy as np
import pytest

from parqyard.llm import topk_search
from parqyard.llm.topk_search import Tree


@pytest.mark.parametrize(("spread", "shard"), [(3, 50), (1 << 10, 400), (1 << 40, 100)])
def test_against_all_products(spark, spread, shard):
    rnd = np.random.default_rng(spread)
    rows = [(i, [int(x) for x in rnd.integers(-spread, spread, 6)], i % 7 == 0) for i in range(300)]
    rows += [(1000 + i, rows[3][1], i % 50 == 0) for i in range(200)] + [(2000, None, True), (2001, [1, None, 1, 1, 1, 1], True), (None, [1] * 6, True), (2002, [], True), (2003, [5, 5], True), (2004, [6, 5], None), (2005, [0] * 6, True)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>, q boolean").selectExpr("*", "'clash' as score", "1 as rank")
    got = {}
    for r in topk_search.search(df.repartition(3), "vec_id", "v", "q", k=5, shard_rows=shard).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = [r for r in rows if r[0] is not None and r[1] and None not in r[1]]
    want, top = {}, 1 << 63
    for i, v, q in whole:
        if q:
            each = sorted((-max(-top, min(top - 1, sum(a * b for a, b in zip(v, w)))), j) for j, w, _ in whole if j != i and len(w) == len(v))
            want[i] = [(k + 1, j, -s) for k, (s, j) in enumerate(each[:5])]
    assert {i: sorted(v) for i, v in got.items()} == {i: v for i, v in want.items() if v}


def test_few_and_none(spark):
    one = spark.createDataFrame([(1, [1, 2], True)], "vec_id long, v array<long>, q boolean")
    assert topk_search.search(one, "vec_id", "v", "q").count() == 0 and topk_search.search(one.limit(0), "vec_id", "v", "q").count() == 0
    two = one.union(spark.createDataFrame([(2, [3, 4], False)], one.schema))
    assert [tuple(r) for r in topk_search.search(two, "vec_id", "v", "q").collect()] == [(1, 1, 2, 11)]


def test_bounds_cut_work():
    """With clustered vectors most leaves are never looked at, and the result stays exact."""
    rnd = np.random.default_rng(0)
    centers = rnd.integers(-1000, 1000, (40, 8))
    x = (centers[rnd.integers(0, 40, 8000)] + rnd.integers(-20, 20, (8000, 8))).astype(np.int32)
    tree = Tree.build(np.arange(8000), x)
    seen: list[int] = []
    got = tree.search(np.arange(50), x[:50], 5, [None] * 50, seen)
    for i in range(50):
        s = x.astype(np.int64) @ x[i].astype(np.int64)
        s[i] = -(1 << 60)
        order = np.lexsort((np.arange(8000), -s))[:5]
        assert got[i] == [(int(s[j]), -int(j)) for j in order]
    assert sum(seen) < 0.3 * 50 * 8000
