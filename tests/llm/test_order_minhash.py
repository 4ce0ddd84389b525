"""Order MinHash against plain Python selection; neighbours; the op6 query on odd rows."""

import random

from pyspark.sql import functions as F

from parqyard.llm import order_minhash, queries
from parqyard.llm.neighbours import neighbours, running


def fingerprints(spark, texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["fp"] for r in order_minhash.fingerprint(df, {"t": "fp"}, **kw).orderBy("i").collect()]


def test_against_selection(spark):
    """The same k-mers, numbered, dealt to bins, the two least of each in text order: with Spark's own hash, by a join."""
    rnd = random.Random(2)
    texts = [" ".join(rnd.choice("abcdef") for _ in range(rnd.randint(0, 80))) for _ in range(25)] + ["a " * 60, "", "one", "one two", "x y z", " \n", None, "w" * 100]
    got = fingerprints(spark, texts, k=3, sketches=8)
    low = (1 << 24) - 1
    top = (1 << 63) - 1 - low

    def hashed(columns, rows, types):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{j} {t}" for j, t in enumerate(types)))
        return [r["h"] for r in df.select("i", F.xxhash64(*[f"c{j}" for j in range(columns)]).alias("h")).orderBy("i").collect()]

    for text, fp in zip(texts, got):
        tokens = [t[i : i + 16] for t in (text or "").split() for i in range(0, len(t), 16)]
        if not tokens:
            assert fp == [None] * 8
            continue
        grams = [(tokens[i : i + 3] + [None] * 3)[:3] for i in range(max(1, len(tokens) - 2))]
        first = hashed(3, grams, ["string"] * 3)
        seen, keys = {}, []
        for h in first:
            keys.append(((h & top) >> 24, seen.get((h & top) >> 24, 0)))
            seen[keys[-1][0]] = keys[-1][1] + 1
        again = hashed(2, keys, ["long", "int"])
        marks = sorted(((h & top) >> 24 if n else x, at) for at, ((x, n), h) in enumerate(zip(keys, again)))
        bins = {}
        for mark, at in marks:
            bins.setdefault(mark >> 36, []).append((at, mark))
        pairs = {b: [m for _, m in sorted(v[:2])] for b, v in bins.items()}
        tuples = hashed(2, [(p + [-1])[:2] for p in pairs.values()], ["long", "long"])
        want = dict(zip(pairs, [((h & (2**64 - 1)) >> 40) for h in tuples]))
        assert fp == [want.get(b) for b in range(8)]


def test_order_matters(spark):
    words = [f"w{i}" for i in range(300)]
    a, b = " ".join(words), " ".join(words[150:] + words[:150])
    c = " ".join(words[:290] + ["new"] * 10)
    fa, fb, fc = fingerprints(spark, [a, b, c])
    df = spark.createDataFrame([(fa, fb, fc, [None] * 64)], "a array<int>, b array<int>, c array<int>, e array<int>")
    near = df.select(*[order_minhash.likeness(F.col(x), F.col(y)) for x, y in ("aa", "ab", "ac", "ee", "ae")]).first()
    assert near[0] == 1 and near[2] > near[1] and near[3] == 1 and near[4] == 0


def test_neighbours(spark):
    rows = spark.range(1000).select((F.col("id") * 7 % 1000).alias("x"), F.lit(1).alias("after_"))
    got = {r["x"]: (r["before"] and r["before"]["x"], r["after"] and r["after"]["x"]) for r in neighbours(rows.repartition(7), ["x"], ["x"]).collect()}
    assert got == {x: (x - 1 if x else None, x + 1 if x < 999 else None) for x in range(1000)}


def test_running_sums(spark):
    """Sums within keys, of which one holds most rows and spans several ranges."""
    rows = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit(1)).when(F.col("id") % 9 == 0, F.col("id") % 20).alias("k"), F.col("id").alias("x"), F.lit(5).alias("v"))
    got = running(rows.repartition(6), "k", ["x"], {"at": F.lit(1), "total": F.col("v") + F.col("x")}).collect()
    at, total = {}, {}
    for r in sorted(got, key=lambda r: r["x"]):
        at[r["k"]], total[r["k"]] = at.get(r["k"], 0) + 1, total.get(r["k"], 0) + 5 + r["x"]
        assert (r["at"], r["total"]) == (at[r["k"]], total[r["k"]])
    assert len(got) == 3000


def test_query_on_odd_rows(spark, tmp_path):
    import hashlib

    for rows in ([(1, "abcdef"), (5, None), (7, "häuser und mehr"), (9, ""), (None, "null id"), (3, "xy")], [(4, "alone in here")], [(2, "ab cd"), (2, "ab cd"), (1, "zz zz zz")], []):
        path = str(tmp_path / f"s{len(rows)}")
        spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as fp", "1 as k").write.parquet(f"{path}/documents.parquet")
        got = {r["doc_id"]: r for r in queries.op6_order_minhash(spark, path).collect()}
        order = sorted({r[0]: r for r in rows}.values(), key=lambda r: (r[0] is None, -(r[0] or 0)))
        for i, (doc, text) in enumerate(order):
            text, nxt = text or "", order[(i + 1) % len(order)][1] or ""
            cut = len(text) // 3
            edited = text[: len(text) - cut] + nxt[:cut]
            assert got[doc]["n_chars"] == len(text) and got[doc]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and 0 <= got[doc]["near_edited"] <= 1
