"""The pipeline's stages one after the other, each against a brute-force version of its own input."""

import random

import pytest

import corpus_pipeline
from test_ngram_join import shingle_set
from test_substring_dedup import brute as passages

SYL = "ka lo mi ne su ta re vo".split()


def _corpus():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice(SYL) for _ in range(rnd.randint(1, 3)))
    passage = " ".join(word() + str(i) for i in range(60))
    rows, labels = [], []
    for i in range(300):
        words = [word() + str(rnd.randrange(50)) for _ in range(rnd.randint(20, 120))]
        toxic = int(rnd.random() < 0.25)
        if toxic:
            for _ in range(6):
                words.insert(rnd.randrange(len(words)), rnd.choice(("grunch", "vlimpty")))
        text = " ".join(words)
        if rnd.random() < 0.1:
            text += "\n" + passage
        rows.append((i, text, rnd.choice(("en", "de")), rnd.choice(("s1", "s1", "s2")), len(text)))
        if i % 3:
            labels.append((i, 1, toxic))
    for i in range(300, 340):
        _, text, lang, source, n = rows[rnd.randrange(120)]
        rows.append((i, text + (" extra" if i % 2 else ""), lang, source, n))
    rows += [(400, None, None, None, None), (401, "", "en", "s1", 0), (None, "no id", "en", "s2", 5), (402, passage, "en", "s2", len(passage))]
    rows += [rows[100], rows[100], (None, rows[100][1], "en", "s1", 3), (None, "only without ids " * 9, "en", "s1", 3), (None, "only without ids " * 9, "de", "s1", 3), (7, rows[250][1], "en", "s2", 1), (401, "", "en", "s1", 0)]
    return rows, labels


def _kept(rows):
    """One row of each group of linked texts: by the brute-force links, least id first, nulls last."""
    parent, sets = list(range(len(rows))), [shingle_set(r["text"], 5) for r in rows]

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same = rows[i]["doc_id"] == rows[j]["doc_id"] and rows[i]["text"] == rows[j]["text"]
            if same or (sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])):
                parent[find(i)] = find(j)
    out = {}
    for i, r in enumerate(rows):
        out.setdefault(find(i), []).append(r["doc_id"])
    return sorted(str(min(ids, key=lambda d: (d is None, d or 0))) for ids in out.values())


def test_one_row_of_each_group(spark):
    """Rows that repeat, ids that repeat or are null, and columns named like the operators' own."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (1, text), (2, text + " x"), (None, text), (None, "other words " * 20), (None, "other words " * 20), (3, None), (3, None), (4, ""), (5, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1, "clash", 2) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, rid string, label int")
    got = corpus_pipeline.one_of_each_group(spark, docs.repartition(4), "")
    assert got.columns == docs.columns and sorted((str(r["doc_id"]), r["text"], r["rid"], r["label"]) for r in got.collect() if r["text"]) == [("1", text, "clash", 2), ("None", "other words " * 20, "clash", 2)]
    assert sorted(r["doc_id"] for r in got.collect() if not r["text"]) == [3, 4, 5]


def test_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    rows, labels = _corpus()
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, made = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = made[name] = docs.collect()
        if name == "toxicity":
            bad = lambda r: any(w in (r["text"] or "") for w in ("grunch", "vlimpty"))
            assert sorted((r for r in before if not bad(r)), key=str) == sorted(after, key=str) and not any(map(bad, after))
        elif name == "ngram_join":
            assert _kept(before) == sorted(str(r["doc_id"]) for r in after) and all(r in before for r in after) and len(after) < len(before)
        elif name == "substring_dedup":
            words = lambda t: b" ".join((t or "").encode().split()).decode()
            want = sorted((str(d), kept) for d, n, gone, kept in passages([(r["doc_id"], r["text"]) for r in before], 50) if not n or gone < n)
            assert sorted((str(r["doc_id"]), words(r["text"])) for r in after) == want != sorted((str(r["doc_id"]), words(r["text"])) for r in before)
            assert all(r in before or r["text"] == words(r["text"]) and r["n_chars"] == len(r["text"]) for r in after)
        elif name == "mixing":
            assert all(r in before for r in after) and 0 < len(after) <= len(before)
        else:
            assert sorted(str(r["doc_id"]) for r in after) == sorted(str(r["doc_id"]) for r in before) and all(r["lossless"] for r in after)
        if name != "sentencepiece":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(str, made["sentencepiece"]))


def test_no_rows(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
