"""What the pipeline's stages shuffle: the texts that have something to do with others, not all."""

import random

import numpy as np

import corpus_pipeline
from parqyard.llm.common import bitmap, is_set, sieve, sifted


def shuffled(spark):
    done = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(done.apply(i).totalShuffleWrite() for i in range(done.size()))


def test_lone_texts_stay(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(i, " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(3000))) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(5)] + [(2000 + i, rows[i][1][:20000] + " other") for i in range(5)] + [(3000, None), (3000, None), (3001, "")]
    raw = sum(len(t or "") for _, t in rows)
    docs = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(2).write.parquet(f"{tmp_path}/docs")
    for stage, want in ((corpus_pipeline.one_of_each_group, 400 + 5 + 2), (corpus_pipeline.drop_passages, 400 + 5 + 3)):
        before = shuffled(spark)
        stage(spark, spark.read.parquet(f"{tmp_path}/docs"), "").write.parquet(f"{tmp_path}/{stage.__name__}")
        moved = shuffled(spark) - before
        assert spark.read.parquet(f"{tmp_path}/{stage.__name__}").count() == want, stage.__name__
        assert moved < raw, (stage.__name__, moved, raw)


def test_sieve_loses_nothing(spark):
    keys = spark.range(0, 3000, 3).selectExpr("cast(id as string) as k")
    may = sieve(keys, bits=18)
    got = {int(r["k"]) for r in sifted(spark.range(3000).selectExpr("cast(id as string) as k"), "k", may).collect()}
    assert set(range(0, 3000, 3)) <= got and len(got) < 1100
    flags = bitmap(spark.createDataFrame([(0,), (9,), (9,), ((1 << 18) - 1,)], "at long"), 18)
    assert np.flatnonzero(is_set(flags, np.arange(1 << 18))).tolist() == [0, 9, (1 << 18) - 1]


def test_bitmap_in_few_jobs(spark):
    """As many jobs whatever the number of partitions, which on a small table decided how long a sieve took."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.sparkContext.setJobGroup("bitmap", "")
    try:
        places = [i * 7919 % (1 << 23) for i in range(20000)]
        flags = bitmap(spark.createDataFrame([(p,) for p in places], "at long"), 23)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("bitmap")
    finally:
        spark.sparkContext._jsc.sc().clearJobGroup()
        for k, v in held.items():
            spark.conf.set(k, v)
    assert np.flatnonzero(is_set(flags, np.arange(1 << 23))).tolist() == sorted(set(places))
    assert 1 <= len(jobs) <= 4, len(jobs)
