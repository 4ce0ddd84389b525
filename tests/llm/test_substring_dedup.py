"""Substring dedup against windows found by plain Python, in one and several batches."""

import random

import pytest

from parqyard.llm import substring_dedup
from parqyard.llm.substring_dedup import FingerprintIndex


def brute(rows, window):
    first = {}
    words = [(d, (t or "").encode().split()) for d, t in rows]
    far = 1 << 62
    for d, w in words:
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            first[k] = min(first.get(k, far), far - 1 if d is None else d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < (far - 1 if d is None else d):
                gone |= set(range(i, i + window))
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    passages = [[f"p{k}_{i}" for i in range(rnd.randint(8, 40))] for k in range(5)]
    rows = []
    for i in range(120):
        t = [f"u{i}_{j}" for j in range(rnd.randint(0, 30))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randrange(0, 5)
            at = rnd.randint(0, len(t))
            t[at:at] = p[a : rnd.randint(a, len(p))]
        rows.append((i, rnd.choice((" ", "\n", " \t")).join(t)))
    return rows + [(300, None), (301, ""), (302, "a " * 200), (303, "a " * 150), (None, rows[5][1]), (5, rows[5][1]), (5, rows[5][1] + " more"), (304, "x y"), (305, "é\xa0" + " z" * 30), (None, "a " * 20)]


@pytest.mark.parametrize(("batches", "hot", "fanout"), [(1, 1000, 4), (3, 4, 2), (2, 0, 4)])
def test_against_all_windows(spark, batches, hot, fanout):
    rows = corpus(batches)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'clash' as rid", "1 as ord", "2 as n_words", "'x' as spans", "'keep' as other")
    got = substring_dedup.dedup(docs.repartition(3), batches=batches, window=9, gram=3, hot=hot, fanout=fanout)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got.collect()), key=str) == brute(rows, 9)
    assert {r["other"] for r in got.collect()} == {"keep"}


def test_no_rows(spark):
    assert substring_dedup.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_are_compacted_and_opened_again(spark, tmp_path):
    """Runs of a level become one of the next; what they hold stays, also for an index that is opened by its path."""
    path = f"file://{tmp_path}/index"
    text = "a b c d e f g"
    row = lambda i: (bytes([i]), i, text + f" only{i}")
    for i in range(5):
        index = FingerprintIndex(spark, window=4, gram=2, fanout=2, path=path) if not i else FingerprintIndex(spark, path=path)
        assert (index.window, index.gram, index.fanout, len(index.runs)) == (4, 2, 2, i.bit_count())
        part = spark.createDataFrame([row(i)], "rid binary, ord long, text string")
        past = spark.createDataFrame([row(j) for j in range(i)], "rid binary, ord long, text string") if i else None
        spans = index.add(part, past).collect()
        assert bool(spans) == bool(i)
        index.close()
    assert sorted(level for level, _ in index.runs) == [0, 2]
    index.close(delete=True)
    assert not (tmp_path / "index").exists()


def test_runs_are_joined_where_they_lie(spark):
    index = FingerprintIndex(spark, window=4, gram=2, hot=1000)
    runs = [index._run(spark.createDataFrame([(j * 7, bytes([i]), i) for i in part for j in range(9)], "anchor long, rid binary, ord long")) for part in (range(5), range(5, 9))]
    seen = []
    write = index._write
    index._write = lambda df, at: (seen.append(df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]), write(df, at))
    index._shared(runs[1], [runs[0]])
    assert "SortMergeJoin" in seen[0] and "Exchange" not in seen[0]
    index.close(delete=True)
