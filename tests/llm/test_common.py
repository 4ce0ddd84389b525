"""Word hashes, shingles and the caches of workers."""

import random

import numpy as np

from parqyard.llm import common


def test_word_hashes(monkeypatch):
    rnd = random.Random(3)
    alphabet = ["a", "b", "é", "ß", "\x00", "\xa0", "日", "x" * 70, "Z"]
    text = "".join(rnd.choice(alphabet + [" ", "\n", "\t ", "\x0b", "\x85"]) for _ in range(4000))
    words = common.ascii_words(text)
    got = common.word_hashes(text)
    by_word, by_hash = {}, {}
    for w, h in zip(words, got, strict=True):
        assert by_word.setdefault(w, h) == h and by_hash.setdefault(h, w) == w
    monkeypatch.setattr(common, "STRETCH", 50)
    assert (common.word_hashes(text) == got).all()
    assert (common.word_hashes("A bÉ", lower=True) == common.word_hashes("a bÉ")).all() and (common.word_hashes("É") != common.word_hashes("é")).all()
    assert len(common.word_hashes(None)) == len(common.word_hashes("")) == len(common.word_hashes(" \n")) == 0


def test_shingles():
    h = np.arange(1, 8, dtype=np.uint64)
    assert len(common.shingles(h, 3)) == 5 and len(set(common.shingles(h, 3))) == 5 and len(common.shingles(h[:2], 3)) == 1 and len(common.shingles(h[:0], 3)) == 0
    assert common.shingles(h[:3], 3)[0] != common.shingles(h[:3][::-1].copy(), 3)[0] and common.shingles(h[1:4], 3)[0] == common.shingles(h, 3)[1]


def test_claim():
    kept = []
    common.claim("one", lambda: kept.append("one"))
    common.claim("one")
    assert not kept
    common.claim("two")
    assert kept == ["one"]
    common._OWNERS.pop("one")
