"""Merge-dropout: every candidate of every occurrence has a draw of its own."""

import random

import pytest
import xxhash

from parqyard.llm import pieces

MASK = (1 << 64) - 1


def splitmix(x):
    """The published finaliser, in plain Python."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def brute(p, text, key, dropout):
    """The agenda as its definition has it, one candidate after another, each skipped by its own hash."""
    out, place = [], 0
    for k, part in enumerate(text.split("▁")):
        if k:
            out += [p.byte[b] for b in "▁".encode()]
            place += 1
        for word in p.chunks((part if k else " " + part).replace(" ", "▁")):
            draw = splitmix((key + place) & MASK)
            place += 1
            s, gone, came = list(word), set(), 0
            ends = list(range(1, len(s) + 1))  # where each piece ends in the word tells it from others like it
            while True:
                found = [(p.rank[a + b], i) for i, (a, b) in enumerate(zip(s, s[1:])) if a + b in p.rank and (ends[i] - len(a), ends[i + 1], ends[i]) not in gone]
                if not found:
                    break
                _, i = min(found)
                came += 1
                if splitmix((draw + came * 0x9E3779B97F4A7C15) & MASK) >> 40 < dropout * 2**24:
                    gone.add((ends[i] - len(s[i]), ends[i + 1], ends[i]))
                    continue
                s[i : i + 2] = [s[i] + s[i + 1]]
                del ends[i]
            for x in s:
                out += [p.ids[x]] if x in p.ids else [p.byte[b] for b in x.encode()]
    return out


def test_skips_by_brute_force():
    pytest.importorskip("public_tokenizers")
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("▁therainosdübéß日x") for _ in range(rnd.choice((1, 2, 5, 9, 14, 30, 31, 32, 70))))
    texts = ["understanding", "", "a", " \n\n a  b", "▁▁", "x" * 33] + [" ".join(word() for _ in range(30)) for _ in range(20)]
    for dropout in (0.0, 0.1, 0.5, 1.0):
        p = pieces.Pieces(dropout=dropout)
        keys = [p.key(i) for i in range(len(texts))]
        flat, ends = p.encode_all(texts, keys)
        for i, t in enumerate(texts):
            assert flat[ends[i] : ends[i + 1]].tolist() == (brute(p, t, keys[i], dropout) if t else [])
            assert list(p.encode(t, keys[i])) == flat[ends[i] : ends[i + 1]].tolist()
    assert p.key(5) == xxhash.xxh3_64_intdigest(b"5", 17)


def test_occurrences_draw_for_themselves():
    pytest.importorskip("public_tokenizers")
    p = pieces.Pieces(dropout=0.1)
    whole = list(pieces.Pieces(dropout=0).encode("understanding"))
    got = [tuple(p.encode("understanding", key)) for key in range(0, 2_000_000, 1000)]
    assert len(set(got)) > 10 and 0.2 < got.count(tuple(whole)) / len(got) < 0.9
    assert len({tuple(p.encode("understanding " * 300, k)) for k in (1, 2)}) == 2


def test_cache_batches_and_stretches_do_not_matter(monkeypatch):
    pytest.importorskip("public_tokenizers")
    rnd = random.Random(8)
    texts = [" ".join("".join(rnd.choice("therainos") for _ in range(rnd.choice((2, 5, 9, 70)))) for _ in range(400)) * 3 + "  \n▁ end" for _ in range(4)]
    few, many = pieces.Pieces(dropout=0.3, cache=20), pieces.Pieces(dropout=0.3)
    want = [list(many.encode(t, i)) for i, t in enumerate(texts)]
    assert [list(few.encode(t, i)) for i, t in enumerate(texts)] == want == [list(many.encode(t, i)) for i, t in enumerate(texts)]
    monkeypatch.setattr(pieces, "STRETCH", 50)
    monkeypatch.setattr(pieces, "_ROWS", 37)
    assert [list(few.encode(t, i)) for i, t in enumerate(texts)] == want
