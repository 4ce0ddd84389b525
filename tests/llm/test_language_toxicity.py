"""Language ID and toxicity: held-out accuracy, and every odd row."""

import random

import numpy as np

from parqyard.llm import language_id, toxicity

SYL = {"aa": "ka lo mi ne su ta".split(), "bb": "ßo ür ei sch ang tz".split()}


def _text(rnd, lang, n):
    return " ".join("".join(rnd.choice(SYL[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def test_language(spark):
    rnd = random.Random(5)
    rows = [(i, _text(rnd, lang, rnd.randint(8, 60)), lang) for i in range(200) for lang in [rnd.choice("ab") * 2]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = language_id.train(docs.filter("doc_id % 4 != 2"))
    assert set(profiles) == {"aa", "bb"}
    got = language_id.identify(docs.filter("doc_id % 4 = 2"), profiles).collect()
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["lang_score"] <= 1 for r in got)
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "12 !? 3"), (2, "12 !? 3"), (3, "kalomi" * 20000), (4, "日本")], "doc_id long, text string").selectExpr("*", "'clash' as Lang_Score", "1 as lang_pred", "2 as l")
    found = language_id.identify(odd, profiles)
    got = {(r["doc_id"], r["lang_pred"]) for r in found.collect()}
    assert found.columns == ["doc_id", "l", "lang_pred", "lang_score"] and found.dtypes[3] == ("lang_score", "double")
    assert got >= {(1, "und"), (None, "und"), (2, "und"), (3, "aa")} and not got & {(4, "und")}
    empty = docs.limit(0)
    assert language_id.train(empty) == {} and language_id.identify(empty, profiles).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs.limit(3), {}).collect()} == {"und"}


def test_profile_by_brute_force():
    """Counts and ranks of n-grams as plain Python finds them."""
    text = "The cat, the hat! Thé CAT"
    words = ["the", "cat", "the", "hat", "thé", "cat"]
    want = {}
    for w in words:
        padded = "_" + w + "_"
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                g = padded[i : i + n]
                if g != "_":
                    want[g] = want.get(g, 0) + 1
    codes, counts = language_id.ngram_counts([text], 3)

    def name(c):
        parts = []
        while c:
            parts.append(c & 0x1FFFFF)
            c >>= 21
        return "".join("_" if x == 1 else chr(x) for x in reversed(parts))

    assert {name(int(c)): int(n) for c, n in zip(codes, counts)} == want
    model = language_id.Profiles({"x": language_id.profile(text, 3, 10), "y": language_id.profile("zz yy", 3, 10)}, 3, 10)
    away, most = model.distances(text)
    assert list(away) == [0, most] and model.predict(text) == ("x", 1.0)


def test_toxicity(spark):
    rnd = random.Random(6)
    bad = ["grunch", "vlimpty"]
    rows = []
    for i in range(400):
        words, toxic = _text(rnd, "aa", rnd.randint(10, 80)).split(), int(rnd.random() < 0.3)
        if toxic:
            for _ in range(rnd.randint(1, 4)):
                words.insert(rnd.randrange(len(words)), rnd.choice(bad))
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = docs.select("doc_id", "toxic").unionByName(spark.createDataFrame([(None, 1), (1000, None), (0, 7)], "doc_id long, toxic int"))
    plain = docs.selectExpr("doc_id", "text", "'clash' as Toxic", "1 as k", "2 as y", "3 as _y", "'x' as toxic_score")
    model = toxicity.train(toxicity.labelled(plain, labels.filter("doc_id % 3 != 1 or doc_id is null")))
    got = toxicity.score(plain, model).filter("doc_id % 3 = 1").collect()
    assert all((r["toxic_score"] >= 0.7) == bool(rows[r["doc_id"]][2]) and 0 <= r["toxic_score"] <= 1 for r in got)
    assert set(got[0].asDict()) == {"doc_id", "Toxic", "k", "y", "_y", "toxic_score"} and isinstance(got[0]["toxic_score"], float)
    odd = spark.createDataFrame([(1, None), (None, ""), (2, "ab " * 50000 + "grunch"), (2, "ab " * 50000 + "grunch")], "doc_id long, text string")
    s = [r["toxic_score"] for r in toxicity.score(odd, model).collect()]
    assert s[0] == s[1] and s[2] == s[3] and s[2] > s[0]
    assert toxicity.score(plain.limit(0), model).count() == 0
    one_kind = toxicity.train(toxicity.labelled(plain, labels.filter("toxic = 0")))
    assert {r["toxic_score"] < 0.01 for r in toxicity.score(odd, one_kind).collect()} == {True}
    assert toxicity.train(toxicity.labelled(plain, labels.limit(0))).score("x") < 0.01


def test_features_and_ratios_by_brute_force(spark, monkeypatch):
    """N-grams as strings, their document counts by label, log-count ratios and choice, as plain Python finds them."""
    monkeypatch.setattr(toxicity, "LEAST", 2)
    monkeypatch.setattr(toxicity, "fit", lambda row, col, ratio, y, l2: (np.ones(len(ratio)), 0.0))
    rnd = random.Random(3)
    texts = list({("".join(rnd.choice("abßÉ日 \n") for _ in range(rnd.randint(4, 40))) + ("xyxy" if i % 2 and i % 5 else ""), i % 2) for i in range(60)})
    slots, docs = {}, {}
    for t, y in texts:
        padded = " " + t.lower().replace("\n", " ") + " "
        for n, found in zip((4, 6, 8), toxicity.hashed(t)):
            assert len(found) == len(padded) - n + 1
            for i, x in enumerate(found.tolist()):
                assert slots.setdefault(padded[i : i + n], x) == x
        docs.setdefault((toxicity.sketch(t), y), {g for n in (4, 6, 8) for g in (padded[i : i + n] for i in range(len(padded) - n + 1))})
    by_slot = {}
    for g, x in slots.items():
        by_slot.setdefault(x, []).append(g)
    assert len(by_slot) > 0.998 * len(slots)
    model = toxicity.train(spark.createDataFrame(texts, "text string, toxic int"))
    n = [sum(1 for _, y in docs if y == k) for k in (0, 1)]
    chosen, others = [], []
    for slot, (g, *more) in by_slot.items():
        if more:
            continue
        q, p = (sum(1 for (_, y), own in docs.items() if y == k and g in own) for k in (0, 1))
        share = (p + q) / sum(n)
        z = abs(p / n[1] - q / n[0]) / (share * (1 - share) * (1 / n[1] + 1 / n[0])) ** 0.5 if 0 < share < 1 else 0.0
        if model.slot[slot] < 0:
            others.append(z if p + q >= 2 else 0.0)
        else:
            chosen.append(z)
            assert p + q >= 2 and abs(model.weight[model.slot[slot]] - (np.log((p + 1) / (n[1] + 2)) - np.log((q + 1) / (n[0] + 2)))) < 1e-12
    assert 10 < len(chosen) <= len(model.weight) and max(others) <= min(chosen) + 1e-9 and max(chosen) >= 4


def test_stretches(monkeypatch):
    """Texts of several stretches have the same n-grams as in one."""
    text = "The cat, the hät! " * 40 + "x" * 100
    whole = toxicity.distinct(text), language_id.ngram_counts([text], 3)
    monkeypatch.setattr(toxicity, "STRETCH", 64)
    monkeypatch.setattr(language_id, "STRETCH", 37)
    assert (toxicity.distinct(text) == whole[0]).all()
    codes, counts = language_id.ngram_counts([text], 3)
    assert (codes == whole[1][0]).all() and (counts == whole[1][1]).all()


def test_fit_finds_the_minimum():
    """The regression's gradient vanishes, by finite differences too."""
    rnd = np.random.default_rng(1)
    row, col = np.repeat(np.arange(60), 3), rnd.integers(0, 8, 180)
    y, ratio = (rnd.random(60) < 0.5).astype(float), rnd.normal(size=8)
    w, b = toxicity.fit(row, col, ratio, y, 0.5, steps=500)

    def loss(w, b):
        s = np.bincount(row, ratio[col] * w[col], 60) + b
        return np.logaddexp(0, np.where(y > 0, -s, s)).sum() + 0.25 * (w**2).sum()

    base = loss(w, b)
    for i in range(8):
        for d in (1e-3, -1e-3):
            moved = w.copy()
            moved[i] += d
            assert loss(moved, b) >= base - 1e-6
