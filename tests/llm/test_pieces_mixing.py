"""SentencePiece coding round trips, and raking against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from parqyard.llm import mixing, pieces

ODD = ["", " ", "  a ▁▁ b\n\n \t x", "<s></s><0x41>", "ünïcødé 日本語 🎉", "▁", "a▁", "▁ ▁", "x" * 5000, "a b " * 20000, "\n", "the the the the", "\x00\x01", "Ⅷ ﬁ é"]


def test_model_segmentation_and_round_trip():
    sentencepiece = pytest.importorskip("sentencepiece")
    pytest.importorskip("public_tokenizers")
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    plain, varied = pieces.Pieces(dropout=0), pieces.Pieces(dropout=0.3)
    rnd = random.Random(1)
    texts = ODD + [" ".join("".join(rnd.choice("therainos") for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(1, 40))) for _ in range(60)]
    for t in texts:
        assert plain.decode(plain.encode(t)) == t if t else len(plain.encode(t)) == 0
        if t and "▁" not in t and "\x00" not in t:
            assert list(plain.encode(t)) == sp.encode(t)
        for key in range(3):
            assert not t or varied.decode(varied.encode(t, key)) == t
    long = texts[-1] + " word" * 50
    assert list(varied.encode(long, 1)) != list(varied.encode(long, 2)) and list(varied.encode(long, 1)) == list(pieces.Pieces(dropout=0.3).encode(long, 1))


def test_encode_decode(spark):
    pytest.importorskip("public_tokenizers")
    rows = list(enumerate(ODD)) + [(100, None), (None, "no key"), (3, ODD[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as lang", "'clash' as n_tokens", "1 as Lossless", "2 as token_ids")
    got = pieces.encode(df)
    assert got.columns == ["doc_id", "lang", "token_ids", "n_tokens", "lossless"] and got.dtypes[3:] == [("n_tokens", "int"), ("lossless", "boolean")]
    back = pieces.decode(got).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in back), key=str) == sorted(rows, key=str) and all(r["lossless"] for r in back)
    assert pieces.decode(got.selectExpr("*", "'clash' as TEXT")).columns[-1] == "text"
    assert pieces.encode(df.limit(0)).count() == 0
    broken = spark.range(1).selectExpr("id as doc_id", "cast(unhex('61ff62') as string) as text")
    assert [(r["text"], r["lossless"]) for r in pieces.decode(pieces.encode(broken)).collect()] == [("a\ufffdb", True)]


def test_mix_odd_rows(spark):
    rows = [(i, "a b c " * (i % 7), "en" if i % 3 else "de", "s1" if i % 2 else "s2") for i in range(300)] + [(400, None, None, None), (401, "", "en", None), (None, "x " * 50000, "fr", "s1"), (5, "dup", "en", "s1"), (5, "dup", "en", "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "'clash' as Weight", "1 as tokens")
    marginals = {"source": F.col("source"), "lang": F.col("lang"), "topic": F.expr("coalesce(substring(text, 1, 1), 'none')")}
    got = mixing.mix(df, marginals, {"source": 0.5, "lang": 0.5, "topic": 0.0}, keep=0.02).collect()
    assert len(got) == len(rows) and {r["selected"] for r in got} == {True, False}
    assert all(0 <= r["probability"] <= 1 for r in got) and next(r for r in got if r["doc_id"] is None)["n_tokens"] == 50000
    twins = [r for r in got if r["doc_id"] == 5 and r["text"] == "dup"]
    assert len(twins) == 2 and twins[0] == twins[1]
    assert mixing.mix(df.limit(0), marginals, {"source": 0.5, "lang": 0.5, "topic": 0.0}).count() == 0
    with pytest.raises(ValueError):
        mixing.rake(spark.createDataFrame([("a", 1)], "s string, tokens long"), {"s": {}})
