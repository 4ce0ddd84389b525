"""Language identification by rank-order n-gram profiles and out-of-place distance.

A profile lists the most frequent letter n-grams (1 to `max_n`, words padded with a boundary mark) by rank. A
document's language is that of the profile with the least out-of-place distance: the sum, over the document's own
profile, of the difference of ranks, or `size` where the language lacks the n-gram.

Edge cases: null texts and texts without a letter give `und` and score 0. Ties of counts go to the smaller n-gram code,
ties of distance to the language that sorts first. Repeated rows are scored each; empty tables give no rows; without
any training row every text is `und`. Invalid UTF-8 counts as U+FFFD. Extra columns are kept; those named as the ones
added here are replaced.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_table, map_batches, rest, write_table

#: Letters that are counted at once.
STRETCH = 1 << 20
_PAD = 1  # the code of a word's edge; letters have their code point, all other characters 0


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0."""
    out = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def ngram_counts(texts: list[str], max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams of all texts together, ascending, and how often each occurs."""
    raw = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.concatenate(([0], _letters()[raw], [0]))
    keep = c > 0
    keep[1:] |= c[:-1] > 0  # one gap behind each word
    keep[0] = True
    c = c[keep]
    c[c == 0] = _PAD
    found = [_counts(c[at : at + STRETCH + max_n - 1], min(STRETCH, len(c) - at), max_n) for at in range(0, len(c), STRETCH)]
    if len(found) == 1:
        return found[0]
    codes, where = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)


def _counts(c: np.ndarray, starts: int, max_n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams that begin at one of the first `starts` places."""
    parts = [c[:starts][c[:starts] != _PAD]]
    for n in range(2, max_n + 1):
        m = min(starts, len(c) - n + 1)
        if m < 1:
            break
        code = np.zeros(m, np.int64)
        ok = np.ones(m, bool)
        for i in range(n):
            at = c[i : i + m]
            code = (code << 21) | at
            if 0 < i < n - 1:
                ok &= at != _PAD
        if n == 2:
            ok &= (c[:m] != _PAD) | (c[1 : 1 + m] != _PAD)
        parts.append(code[ok])
    return np.unique(np.concatenate(parts), return_counts=True)


def profile(text: str, max_n: int, size: int) -> np.ndarray:
    """The codes of the text's `size` most frequent n-grams, by rank."""
    codes, counts = ngram_counts([text], max_n)
    if len(codes) > size:  # only what can be among the first
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        codes, counts = codes[keep], counts[keep]
    return codes[np.argsort(-counts, kind="stable")][:size]


def train(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", max_n: int = 3, size: int = 300, rows_per_lang: int = 5000) -> dict[str, np.ndarray]:
    """Profiles by language, fitted on about `rows_per_lang` rows of each, chosen by hash of `key`."""
    docs = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).filter("l is not null and t is not null")
    share = docs.groupBy("l").agg(F.least(F.lit(1.0), F.lit(rows_per_lang) / F.count("*")).alias("share"))
    rows = docs.join(F.broadcast(share), "l").filter(F.pmod(F.xxhash64("k", F.lit("language")), F.lit(1 << 20)) < F.col("share") * (1 << 20))

    def count(batch: dict) -> dict:
        langs, codes, counts = [], [], []
        by: dict[str, list[str]] = {}
        for name, t in zip(batch["l"], batch["t"]):
            by.setdefault(name, []).append(t)
        for name, texts in by.items():
            a, b = ngram_counts(texts, max_n)
            langs += [name] * len(a)
            codes.append(a)
            counts.append(b)
        return {"l": langs, "code": np.concatenate(codes), "n": np.concatenate(counts)} if codes else {}

    counted = write_table(map_batches(rows.select("l", "t"), count, "l string, code long, n long").groupBy("l", "code").agg(F.sum("n").alias("n")), "ngrams")
    # the first `size` of every language at once; Spark cuts each task's rows to that many before it exchanges them
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "code"))
    out: dict[str, list[int]] = {}
    for r in counted.withColumn("rank", rank).filter(F.col("rank") <= size).orderBy("l", "rank").select("l", "code").collect():
        out.setdefault(r["l"], []).append(r["code"])
    drop_table(counted)
    return {name: np.array(codes, np.int64) for name, codes in out.items()}


class Profiles:
    """Language profiles as one table of ranks by n-gram, for all languages at once."""

    def __init__(self, by_lang: dict[str, np.ndarray], max_n: int, size: int):
        self.langs, self.max_n, self.size = sorted(by_lang), max_n, size
        self.codes = np.unique(np.concatenate([np.zeros(0, np.int64), *by_lang.values()]))
        self.rank = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int32)
        for j, name in enumerate(self.langs):
            self.rank[np.searchsorted(self.codes, by_lang[name]), j] = np.arange(len(by_lang[name]))

    def distances(self, text: str) -> tuple[np.ndarray, int] | None:
        """The out-of-place distance to each language and the largest possible; None without letters."""
        top = profile(text, self.max_n, self.size)
        if not len(top) or not self.langs:
            return None
        at = np.searchsorted(self.codes, top)
        at[at < len(self.codes)] = np.where(self.codes[at[at < len(self.codes)]] == top[at < len(self.codes)], at[at < len(self.codes)], len(self.codes))
        rank = self.rank[at]
        away = np.where(rank < 0, self.size, np.abs(rank - np.arange(len(top), dtype=np.int32)[:, None]))
        return away.sum(0), self.size * len(top)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.distances(text) if text else None
        if found is None:
            return "und", 0.0
        away, most = found
        best = int(np.argmin(away))
        return self.langs[best], float(1 - away[best] / most)


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text: str = "text", max_n: int = 3, size: int = 300) -> DataFrame:
    """docs with lang_pred and lang_score, from the whole text alone."""
    model = docs.sparkSession.sparkContext.broadcast(Profiles(profiles, max_n, size))
    keep = rest(docs, text, "lang_pred", "lang_score")

    def score(batch: dict) -> dict:
        got = [model.value.predict(t) for t in batch[text]]
        return {c: batch[c] for c in keep} | {"lang_pred": [g[0] for g in got], "lang_score": [g[1] for g in got]}

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_batches(docs, score, f"{schema}{', ' if keep else ''}lang_pred string, lang_score double")
