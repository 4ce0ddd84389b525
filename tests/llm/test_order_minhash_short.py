"""Order MinHash of short texts: every sketch has two k-mers, so the order counts."""

from pyspark.sql import functions as F

from parqyard.llm import order_minhash


def test_order_counts_in_short_texts(spark):
    rows, sizes = [], (20, 40, 60, 300)
    for n in sizes:
        for r in range(40):
            words = [f"w{n}x{r}x{i}" for i in range(n)]
            rows.append((n, " ".join(words), " ".join(words[n // 2 :] + words[: n // 2])))
    df = spark.createDataFrame(rows, "n int, a string, b string")
    both = order_minhash.fingerprint(df, {"a": "fa", "b": "fb"}, dense=True)
    got = both.select("n", "fa", order_minhash.likeness(F.col("fa"), F.col("fb")).alias("like")).collect()
    mean = {n: sum(r["like"] for r in got if r["n"] == n) / 40 for n in sizes}
    print(mean)
    assert all(x is not None for r in got for x in r["fa"])
    assert mean[20] < 0.5 and mean[40] < 0.55 and mean[60] < 0.6
    # before, short texts seemed more alike than long ones
    assert mean[20] < mean[300] + 0.1


def test_dense_bins(spark):
    texts = [None, "", "one", "one two three four", " ".join(f"w{i}" for i in range(4000))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    dense = [r["fp"] for r in order_minhash.fingerprint(df, {"t": "fp"}, dense=True).orderBy("i").collect()]
    plain = [r["fp"] for r in order_minhash.fingerprint(df, {"t": "fp"}).orderBy("i").collect()]
    assert dense[0] == dense[1] == [None] * 64 and all(len(x) == 64 for x in dense)
    assert len(set(dense[2])) == 1 and len(set(dense[3])) == 1 and dense[4] == plain[4]
    assert {x for x in plain[2] if x is not None} == set(dense[2])
