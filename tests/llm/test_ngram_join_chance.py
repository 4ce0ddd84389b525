"""N-grams that many unlike documents share by chance, where the frequency table is far too small to tell them apart."""

import random

from parqyard.llm import ngram_join
from test_ngram_join import brute


def test_chance_brings_few_together(spark, monkeypatch):
    rnd = random.Random(8)
    phrases = [" ".join(f"p{rnd.randrange(10**6)}" for _ in range(3)) for _ in range(450)]
    rows = []
    for i in range(400):
        parts = [rnd.choice(phrases) for _ in range(30)] + [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(3)) for _ in range(10)]
        rows.append((i, " ".join(rnd.sample(parts, len(parts)))))
    rows += [(1000 + i, rows[i][1] + " end") for i in range(20)]
    moved = []
    write = ngram_join.write_table

    def counted(df, label):
        out = write(df, label)
        if label == "sets":
            moved.append(sum(r["blocks"] for r in out.select("blocks").collect()))
        return out

    monkeypatch.setattr(ngram_join, "write_table", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.link(docs.repartition(4), n=3, num=9, den=10, bits=6).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == brute(rows, 3, 9, 10)
    assert sum(r["n_links"] > 0 for r in got) == 40
    assert moved[0] <= 120, moved  # sets that are compared: all 420 of them, several times, without the exact counts


def test_copies_belong_together(spark):
    """Lists of near copies are not taken for chance, and those of many copies in many tasks hold each class once."""
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(words)) for i in range(60)]
    for i in range(60):
        t = list(words)
        t[rnd.randrange(80)] = f"x{i}"
        rows.append((100 + i, " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.link(docs.repartition(30), n=3, num=9, den=10, bits=8).collect()
    assert sorted((tuple(r)[:4] for r in got), key=str) == brute(rows, 3, 9, 10)
