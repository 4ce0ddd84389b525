"""SentencePiece BPE encoding with seeded merge-dropout, and its exact inverse.

Merges come from an agenda ordered by score, then position. Each candidate that comes up is skipped for good if a keyed
hash of (seed, the document's id, the occurrence's number, the candidate's number) is below `dropout`; with dropout 0 the
result is the model's own segmentation. So copies of a text, and repeats within it, are segmented independently, and
nothing that a draw decides is shared or cached: only a word's outcome without skips is, for the occurrences in which no
candidate is skipped. The others go through the agenda, all those of a batch of texts side by side: a column of a matrix
is a word, and in each step every word takes its best candidate, merges or skips it, and looks up its two new neighbours.
Characters that the vocabulary lacks, and the literal U+2581, become byte pieces, so decoding returns
the text exactly.

Edge cases: a null text has null ids and n_tokens 0, an empty one an empty list. A null key counts as the text "null".
Repeated rows are encoded alike. Words of over 31 characters go through a heap instead, one by one; texts are never cut,
very long ones are gone through in stretches. Invalid UTF-8 in a text becomes U+FFFD before it is encoded. Extra columns
are kept; those named as the ones added here are replaced.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import MIX, claim, map_batches, mix, rest

SPACE = "▁"
_NEVER = 1 << 30
_STEP = 0x9E3779B97F4A7C15
_ALL = (1 << 64) - 1
_LONG = 31  # characters above which a word goes through a heap
_OTHER = 1 << 16  # symbols from here on are characters that the vocabulary lacks
_ROWS = 1 << 15  # words side by side
STRETCH = 1 << 20  # characters of a text that are cut into words at once


def _chunker(pieces) -> re.Pattern:
    """Cuts where no merge can cross: before the marks of a space, around line ends, and between letters and other
    characters (those that the vocabulary joins with the other kind count as no letters)."""
    odd: set[str] = set()
    letter = lambda c: c not in odd and re.match(r"[^\W\d_]", c) is not None
    while True:
        mixed = {a if letter(a) else b for p in pieces for a, b in zip(p, p[1:]) if SPACE not in (a, b) and letter(a) != letter(b)}
        if not mixed:
            break
        odd |= mixed
    kind = rf"[^\W\d_{re.escape(''.join(sorted(odd)))}]"
    return re.compile(rf"\n|{SPACE}*(?:{kind}+|(?:(?!{kind})[^{SPACE}\n])+)|{SPACE}+")


def skipped(draw: int, came: int, dropout: float) -> bool:
    """Whether the candidate number `came` (from 0) of an occurrence with this draw is skipped."""
    x = draw + (came + 1) * _STEP & _ALL
    x = (x ^ x >> 30) * MIX[0] & _ALL
    x = (x ^ x >> 27) * MIX[1] & _ALL
    return x >> 40 < dropout * (1 << 24)  # the 31 bits that a last step would change are not looked at


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    def __init__(self, model: str | None = None, dropout: float = 0.1, seed: int = 17, cache: int = 400_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model or default_model())
        self.dropout, self.seed, self.limit = dropout, seed, cache
        ids: dict[str, int] = {}
        self.byte = [0] * 256
        self.out: list[bytes] = []
        for i in range(sp.get_piece_size()):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(p[1:-1], 16)] = i
                self.out.append(bytes([int(p[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.out.append(b"")
            else:
                ids[p] = i
                self.out.append(p.replace(SPACE, " ").encode())
        if any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in ids) or len(self.out) > _OTHER:
            raise ValueError("the model has pieces that reach over spaces or line ends, or too many")
        self.ids, self.chunks = ids, _chunker(ids).findall
        by_score = sorted(ids, key=lambda p: -sp.get_score(ids[p]))
        self.rank = {p: r for r, p in enumerate(by_score)}
        self.made = np.array([ids[p] for p in by_score], np.int32)
        self.symbol = np.arange(0x110000, dtype=np.int32) + _OTHER
        for p, i in ids.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self._index_pairs()
        self._forget()

    def _index_pairs(self) -> None:
        """A hash table of the pairs of symbols that a merge joins, with the merge's rank."""
        known = lambda x: self.ids.get(x, ord(x) + _OTHER if len(x) == 1 else None)
        pairs = {}
        for p, r in self.rank.items():
            for cut in range(1, len(p)):
                a, b = known(p[:cut]), known(p[cut:])
                if a is not None and b is not None:
                    pairs[a << 21 | b] = r
        key, rank = np.array([*pairs, -1], np.int64)[:-1], np.array([*pairs.values(), 0], np.int32)[:-1]
        self.slots = max(10, len(key).bit_length() + 2)
        self.keys, self.ranks = np.full(1 << self.slots, -1, np.int64), np.full(1 << self.slots, _NEVER, np.int32)
        self.tries = 0
        while len(key):  # linear probing, all keys at once
            at = self._slot(key, self.tries)
            at[self.keys[at] >= 0] = -1
            slot, first = np.unique(at, return_index=True)
            first = first[slot >= 0]
            self.keys[at[first]], self.ranks[at[first]] = key[first], rank[first] << 5
            rest = np.ones(len(key), bool)
            rest[first] = False
            key, rank = key[rest], rank[rest]
            self.tries += 1

    def _slot(self, key: np.ndarray, step: int) -> np.ndarray:
        h = (key.astype(np.uint64) * np.uint64(_STEP) >> np.uint64(64 - self.slots)).astype(np.int64)
        return h + step & (1 << self.slots) - 1

    def _ranked(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of symbols the rank of its merge, times 32; _NEVER for none."""
        key = a.astype(np.int64) << 21 | b  # -1, beyond a word's end, gives no key of the table
        at = self._slot(key, 0)
        have = self.keys[at]
        out = np.where(have == key, self.ranks[at], _NEVER)
        todo = np.flatnonzero((have != key) & (have >= 0) & (key >= 0))
        for step in range(1, self.tries):
            if not len(todo):
                break
            at = self._slot(key[todo], step)
            have = self.keys[at]
            hit = have == key[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            todo = todo[~hit & (have >= 0)]
        return out

    def _forget(self) -> None:
        """Empties the cache of words: the numbers of candidates that come up, and the ids, without skips."""
        self.known: dict[str | None, int] = {None: 0}  # None is a literal mark, -1 a long word
        self.came = np.zeros(1, np.int32)
        self.size = np.array([len(SPACE.encode())])
        self.flat = np.array([self.byte[b] for b in SPACE.encode()], np.int32)
        self.first = np.zeros(1, np.int64)

    def key(self, doc: object) -> int:
        """What the occurrences in one document draw their skips from."""
        return xxhash.xxh3_64_intdigest(str("null" if doc is None else doc).encode(), self.seed)

    def _agenda(self, sym: np.ndarray, draw: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Takes words (columns of symbols, -1 beyond the end) through the agenda: their pieces, and the numbers of
        candidates that came up."""
        high, n = sym.shape
        out, came = np.full((high, n), -1, np.int32), np.zeros(n, np.int32)
        live, place, step = np.arange(n), np.arange(high, dtype=np.int32)[:, None], 0
        rank = np.full((high, n), _NEVER, np.int32)
        rank[:-1] = self._ranked(sym[:-1].ravel(), sym[1:].ravel()).reshape(high - 1, n)
        while True:
            best = (rank | place).min(0)
            over = best >= _NEVER
            if over.any():
                out[:, live[over]], came[live[over]] = sym[:, over], step
                go = ~over
                live, sym, rank, best = live[go], sym[:, go], rank[:, go], best[go]
                draw = draw[go] if draw is not None else None
                if not len(live):
                    return out, came
            j, at = best & 31, np.arange(len(live))
            merge = np.ones(len(live), bool)
            if draw is not None:
                merge = ~self._skips(draw, step)
                gone = np.flatnonzero(~merge)
                rank[j[gone], gone] = _NEVER
            step += 1
            j, at = j[merge], at[merge]
            sym[j, at] = self.made[best[merge] >> 5]
            where = np.where(merge, best & 31, 32)  # nothing moves where a candidate is skipped
            for c in range(1, high - 1):
                move = where < c
                np.copyto(sym[c], sym[c + 1], where=move)
                np.copyto(rank[c], rank[c + 1], where=move)
            sym[-1, at] = -1
            rank[-1, at] = _NEVER
            rank[high - 2, at] = _NEVER
            right = np.minimum(j + 1, high - 1)
            rank[j, at] = np.where(j + 1 < high, self._ranked(sym[j, at], sym[right, at]), _NEVER)
            some = np.flatnonzero(j)
            j, at = j[some], at[some]
            rank[j - 1, at] = self._ranked(sym[j - 1, at], sym[j, at])

    def _skips(self, draw: np.ndarray, came: int) -> np.ndarray:
        """skipped() for many occurrences."""
        return mix(draw + np.uint64((came + 1) * _STEP & _ALL)) >> np.uint64(40) < self.dropout * (1 << 24)

    def _segments(self, words: list[str], draw: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of many words of 1 to _LONG characters: candidates that came up, numbers of ids, and the ids of all."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.symbol[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        first = np.cumsum(size) - size
        came, count, parts = np.zeros(len(words), np.int32), np.zeros(len(words), np.int64), {}
        order = np.argsort(size, kind="stable")
        for lo in range(0, len(order), _ROWS):
            rows = order[lo : lo + _ROWS]
            high = max(2, int(size[rows[-1]]))
            at = first[rows] + np.arange(high)[:, None]
            inside = np.arange(high)[:, None] < size[rows]
            got, came[rows] = self._agenda(np.where(inside, sym[np.minimum(at, len(sym) - 1)], -1), None if draw is None else draw[rows])
            ids, owner = got.T[(t := got.T >= 0)], np.repeat(np.arange(len(rows)), t.sum(1))
            odd = np.flatnonzero(ids >= _OTHER)
            if len(odd):  # characters as bytes
                width = np.ones(len(ids), np.int64)
                raw = [chr(x - _OTHER).encode("utf-8", "surrogatepass") for x in ids[odd].tolist()]
                width[odd] = [len(x) for x in raw]
                start = np.cumsum(width) - width
                ids, owner = np.repeat(ids, width), np.repeat(owner, width)
                for x, i in zip(raw, start[odd].tolist()):
                    ids[i : i + len(x)] = [self.byte[b] for b in x]
            count[rows] = np.bincount(owner, minlength=len(rows))
            parts[lo] = ids
        flat = np.concatenate([np.zeros(0, np.int32), *parts.values()])
        begin = np.empty(len(words), np.int64)
        begin[order] = np.cumsum(count[order]) - count[order]
        return came, count, flat[_ragged(begin, count)]

    def _long(self, word: str, draw: int | None) -> list[int]:
        """The ids of one word, by a heap of (rank, position)."""
        s: list[str | None] = list(word)
        n, rank, came = len(s), self.rank, 0
        prev, nxt = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(r, i, i + 1, p) for i in range(n - 1) if (r := rank.get(p := s[i] + s[i + 1])) is not None]
        heapq.heapify(agenda)
        while agenda:
            r, i, j, p = heapq.heappop(agenda)
            if s[i] is None or s[j] is None or nxt[i] != j or len(s[i]) + len(s[j]) != len(p):
                continue
            came += 1
            if draw is not None and skipped(draw, came - 1, self.dropout):
                continue
            s[i], s[j] = p, None
            k = nxt[i] = nxt[j]
            if k >= 0:
                prev[k] = i
                if (r2 := rank.get(p2 := p + s[k])) is not None:
                    heapq.heappush(agenda, (r2, i, k, p2))
            h = prev[i]
            if h >= 0 and (r2 := rank.get(p2 := s[h] + p)) is not None:
                heapq.heappush(agenda, (r2, h, i, p2))
        out: list[int] = []
        for p in s:
            if p is not None:
                i = self.ids.get(p)
                out += [i] if i is not None else [self.byte[b] for b in p.encode("utf-8", "surrogatepass")]
        return out

    def _words(self, text: str) -> list[str | None]:
        """The words of a text behind a space, each literal mark as None."""
        out: list[str | None] = []
        for k, part in enumerate(text.split(SPACE)):
            if k:
                out.append(None)
            for x in _stretches(part if k else " " + part):
                out += self.chunks(x.replace(" ", SPACE))
        return out

    def encode_all(self, texts: list[str], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of whole texts, one after the other, and where each text's begin (and, last, end)."""
        per = [self._words(t) if t else [] for t in texts]
        n = np.array([len(w) for w in per], np.int64)
        words = [w for x in per for w in x]
        del per
        if len(self.known) > self.limit:
            self._forget()
        get = self.known.get
        which = np.array([get(w, -2) for w in words], np.int64)
        new = np.flatnonzero(which == -2)
        if len(new):
            fresh = list(dict.fromkeys(words[i] for i in new.tolist()))
            self._learn(fresh)
            which[new] = [self.known[words[i]] for i in new.tolist()]
        begin = np.cumsum(n) - n
        draw = np.arange(len(words), dtype=np.uint64) - np.repeat(begin, n).astype(np.uint64)
        draw = mix(draw + np.repeat(np.array(keys, np.uint64), n))
        came, size = np.where(which >= 0, self.came[which], 0), self.size[which]
        source, first = [self.flat], self.first[which]
        dropped = self._any_skipped(draw, came)
        if len(dropped):
            _, size[dropped], flat = self._segments([words[i] for i in dropped.tolist()], draw[dropped])
            first[dropped] = len(self.flat) + np.cumsum(size[dropped]) - size[dropped]
            source.append(flat)
        at = sum(map(len, source))
        for i in np.flatnonzero(which == -1).tolist():
            ids = self._long(words[i], int(draw[i]) if self.dropout > 0 else None)
            source.append(np.array(ids, np.int32))
            first[i], size[i] = at, len(ids)
            at += len(ids)
        out = np.concatenate(source)[_ragged(first, size)]
        ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate((begin, [len(words)]))]
        return out, ends

    def _learn(self, fresh: list[str]) -> None:
        """Caches words' outcomes without skips."""
        short = [w for w in fresh if len(w) <= _LONG]
        self.known.update((w, -1) for w in fresh if len(w) > _LONG)
        if short:
            came, size, flat = self._segments(short, None)
            self.known.update(zip(short, range(len(self.came), len(self.came) + len(short))))
            self.first = np.concatenate((self.first, len(self.flat) + np.cumsum(size) - size))
            self.came, self.size, self.flat = np.concatenate((self.came, came)), np.concatenate((self.size, size)), np.concatenate((self.flat, flat))

    def _any_skipped(self, draw: np.ndarray, came: np.ndarray) -> np.ndarray:
        """The occurrences of which one of the candidates that come up without skips is skipped."""
        if self.dropout <= 0:
            return np.zeros(0, np.int64)
        hit, live, step = np.zeros(len(draw), bool), np.flatnonzero(came > 0), 0
        while len(live):
            now = self._skips(draw[live], step)
            hit[live[now]] = True
            step += 1
            live = live[~now & (came[live] > step)]
        return np.flatnonzero(hit)

    def encode(self, text: str, key: int = 0) -> np.ndarray:
        """Piece ids of the whole text."""
        return self.encode_all([text], [key & _ALL])[0]

    def decode(self, ids) -> str:
        """The text that encode() was given."""
        raw = b"".join(map(self.out.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))
        return raw[1:].decode("utf-8", "replace")  # without the space that encoding puts first


def _stretches(text: str) -> Iterator[str]:
    """A long text in parts of about STRETCH characters, cut before a space that no other one precedes."""
    at = 0
    while len(text) - at > STRETCH:
        end = text.find(" ", at + STRETCH)
        while end > 0 and text[end - 1] == " ":
            end = text.find(" ", end + 1)
        if end < 0:
            break
        yield text[at:end]
        at = end
    yield text[at:]


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... up to size[0] numbers, then the same of first[1] and so on."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(first - before, size)


@lru_cache(4)
def _loaded(model: str | None, dropout: float, seed: int) -> Pieces:
    return Pieces(model, dropout, seed)


def _pieces(*settings) -> Pieces:
    claim("pieces", _loaded.cache_clear)
    return _loaded(*settings)


def encode(docs: DataFrame, text: str = "text", key: str = "doc_id", model: str | None = None, dropout: float = 0.1, seed: int = 17) -> DataFrame:
    """docs without the text, with token_ids, n_tokens and lossless (whether decoding gave the text back)."""
    keep = rest(docs, text, "token_ids", "n_tokens", "lossless")

    def run(batch: dict) -> dict:
        p, texts = _pieces(model, dropout, seed), batch[text]
        flat, ends = p.encode_all([t or "" for t in texts], [p.key(k) for k in batch[key]])
        same = [not t or p.decode(flat[a:b]) == t for t, a, b in zip(texts, ends.tolist(), ends[1:].tolist())]
        ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat), mask=pa.array([t is None for t in texts], pa.bool_()))
        return {c: batch[c] for c in keep} | {"token_ids": ids, "n_tokens": np.diff(ends).astype(np.int32), "lossless": same}

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return map_batches(docs, run, f"{schema}token_ids array<int>, n_tokens int, lossless boolean", "pieces")


def decode(encoded: DataFrame, ids: str = "token_ids", out: str = "text", model: str | None = None) -> DataFrame:
    """encoded with the text of each list of ids; null lists give null."""
    keep = rest(encoded, out)

    def run(batch: dict) -> dict:
        p = _pieces(model, 0.0, 0)
        return {c: batch[c] for c in keep} | {out: [None if x is None else p.decode(x) if len(x) else "" for x in batch[ids]]}

    schema = "".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}, " for c in keep)
    return map_batches(encoded, run, f"{schema}`{out}` string", "pieces")
