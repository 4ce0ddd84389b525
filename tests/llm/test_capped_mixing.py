"""The sample's marginals are the raked ones, also where the share asked for is more than the targets allow."""

import random

import pytest

from parqyard.llm import mixing
from parqyard.llm.queries import TARGETS


@pytest.mark.parametrize("keep", [0.9, 0.7, 0.2])
def test_marginals_hold_with_a_hot_source(spark, keep):
    rnd = random.Random(3)
    cells = [(s, g, t, rnd.randint(100, 2000) * (12 if s == "hot" else 1)) for s in ("hot", None, *"abcdefgh") for g in ("en", "de", "es") for t in "1234" if rnd.random() < 0.9]
    targets = {"s": 0.5, "g": {"en": 2.0, "de": 1.0, "es": 1.0, "fr": 5.0}, "t": 0.0}
    raked = mixing.rake(spark.createDataFrame(cells, "s string, g string, t string, tokens long"), targets, keep=keep)
    got = {tuple(r)[:3]: r for r in raked.collect()}
    total = sum(r["tokens"] for r in got.values())
    given = sum(r["tokens"] * r["probability"] for r in got.values())
    assert all(0 <= r["probability"] <= 1 + 1e-12 for r in got.values()) and given <= (keep + 1e-6) * total
    want, most = brute(cells, targets, keep, 12, 4)
    assert all(abs(got[c]["probability"] - p) < 1e-9 for c, p in want.items())
    for i, name in enumerate("sgt"):
        told = {r["v"]: r for r in mixing.marginals(raked, name, targets[name]).collect()}
        for v in {c[i] for c in got}:
            share = sum(r["tokens"] * r["probability"] for c, r in got.items() if c[i] == v) / given
            assert abs(share - most[i][v]) < 1e-3 and abs(told[v]["share"] - share) < 1e-9 and abs(told[v]["target"] - most[i][v]) < 1e-9
    if keep == 0.2:
        assert abs(given / total - keep) < 1e-3


def brute(cells, targets, keep, rounds, plain):
    """Probabilities by plain Python, and the target shares of each marginal."""
    total, shares, most = sum(c[3] for c in cells), [], keep * sum(c[3] for c in cells)
    for i, t in enumerate(targets.values()):
        by = {}
        for c in cells:
            by[c[i]] = by.get(c[i], 0) + c[3]
        w = {v: t.get(v, 0.0) for v in by} if isinstance(t, dict) else {v: n**t for v, n in by.items()}
        shares.append({v: x / sum(w.values()) for v, x in w.items()})
        most = min(most, *(by[v] / s for v, s in shares[-1].items() if s))
    x = {c[:3]: c[3] * most / total for c in cells}
    size = {c[:3]: c[3] for c in cells}
    for k in range(rounds + plain):
        if k == rounds:
            x = {c: min(v, size[c]) for c, v in x.items()}
        for i, share in enumerate(shares):
            now = dict.fromkeys(share, 0.0)
            for c, v in x.items():
                now[c[i]] += min(v, size[c]) if k < rounds else v
            x = {c: v * most * share[c[i]] / now[c[i]] if now[c[i]] else 0.0 for c, v in x.items()}
    high = max(1.0, *(v / size[c] for c, v in x.items()))
    return {c: v / size[c] / high for c, v in x.items()}, shares


def test_pipeline_stage_keeps_the_mixture(spark):
    """By the probabilities that the stage itself asks for."""
    import corpus_pipeline

    seen = {}
    real = mixing.mix

    def spy(*args, **kw):
        seen["got"] = real(*args, **kw)
        return seen["got"]

    rnd = random.Random(5)
    rows = [(i, "a b c d " * rnd.randint(1, 30), rnd.choice(["en"] * 6 + ["de", "es"]), rnd.choice(["hot"] * 5 + list("abcdefg")), 1) for i in range(600)]
    docs = spark.createDataFrame([(i, f"{rnd.choice('uvwxyz')}{i % 9} {t}", g, s, n) for i, t, g, s, n in rows], "doc_id long, text string, lang string, source string, n_chars long")
    mixing.mix = spy
    try:
        corpus_pipeline.mix(spark, docs, "")
    finally:
        mixing.mix = real
    got = [r for r in seen["got"].collect()]
    given = sum(r["n_tokens"] * r["probability"] for r in got)
    for name, power in TARGETS.items():
        by = {}
        for r in got:
            by[r[name]] = by.get(r[name], 0) + r["n_tokens"]
        whole = sum(n**power for n in by.values())
        for v, n in by.items():
            assert abs(sum(r["n_tokens"] * r["probability"] for r in got if r[name] == v) / given - n**power / whole) < 1e-3
