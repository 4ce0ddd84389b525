"""Toxicity by a character n-gram linear classifier over naive Bayes log-count ratios.

Features are the distinct n-grams of 4, 6 and 8 characters (code points) of the lower-cased text, white space being one
kind of character, hashed to 2**22 slots. Each is scaled by the log ratio of its smoothed document counts in toxic and
other training texts; an L2 logistic regression over the scaled features gives the score.

What is fitted is bounded, what is scored is not: `train` takes about `max_rows` labelled rows, chosen by hash of their
key, and at most `features` n-grams, those that at least LEAST training texts have and whose shares among toxic and other
texts differ most, by a z-score of at least 4 (the 256 best whatever their score). Texts of one label count once if the
SKETCH least hashes of their n-grams agree: copies and near copies. In texts of many MB, whose n-grams fill most slots, these hashes
agree by chance too, so texts of over WIDE different n-grams are told apart by all their n-grams.

Edge cases: null and empty texts have no features and get the score of the intercept. Rows without a label, or with a
null key, are not learned from but are scored. Without training rows of both kinds the score is the share of toxic rows
(0 if there are none). Repeated rows are scored alike. Invalid UTF-8 counts as U+FFFD. Extra columns of training rows are
ignored; those of scored rows are kept, but for one named as the score, which is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, map_batches, rest, small_batches, trim, values, write_table

SIZES = (4, 6, 8)
BITS = 22
#: Training texts that must have an n-gram for it to be a feature.
LEAST = 4
#: Slots whose counts travel together.
PIECE = 1 << 14
#: Characters of a text that are hashed at once.
STRETCH = 1 << 20
#: Least hashes by which training texts are taken for copies, up to WIDE different n-grams.
SKETCH, WIDE = 6, 1 << 20


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two runs from theirs."""
    x = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    return x


def hashed(text: str | None) -> Iterator[np.ndarray]:
    """The hashed character n-grams of the padded, lower-cased text, with repeats, a stretch of the text at a time."""
    if not text:
        return
    whole = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for at in range(0, len(whole), STRETCH):
        b = whole[at : at + STRETCH + max(SIZES) - 1].copy()
        b[(b >= 9) & (b <= 13)] = 32
        width, runs = 1, {1: b + np.uint32(1)}
        while width * 2 <= min(len(b), max(SIZES)):  # hashes of runs of 2, 4, 8 ... characters, each from two halves
            half = runs[width]
            runs[width * 2] = _joined(half[:-width], half[width:])
            width *= 2
        for n in SIZES:
            m, at, h = len(b) - n + 1, 0, None
            if m < 1:
                continue
            for p in (1 << i for i in reversed(range(n.bit_length())) if n >> i & 1):
                part = runs[p][at : at + m]
                h = part if h is None else _joined(h, part)
                at += p
            x = h * np.uint32(0x85EBCA6B)
            yield (x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)


def sketch(text: str | None) -> bytes:
    """What copies and near copies of a training text have in common."""
    grams = distinct(text)
    if len(grams) > WIDE:
        return xxhash.xxh3_128_digest(grams.tobytes())
    return grams[:SKETCH].tobytes()


def distinct(text: str | None) -> np.ndarray:
    """The different hashes of the text's n-grams."""
    return np.unique(np.concatenate([np.zeros(0, np.uint32), *[np.unique(x) for x in hashed(text)]]))


@dataclass
class Model:
    slot: np.ndarray  # by hash: the feature's number, or -1
    weight: np.ndarray  # by feature: regression weight times log-count ratio
    bias: float

    def score(self, text: str | None) -> float:
        seen = np.zeros(len(self.weight), bool)
        for x in hashed(text):
            at = self.slot[x]
            seen[at[at >= 0]] = True
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weight[seen].sum(), -60, 60))))


def train(rows: DataFrame, text: str = "text", label: str = "toxic", features: int = 4096, l2: float = 0.01) -> Model:
    """Fits on labelled rows with a text and a 0/1 label, such as labelled() gives."""
    small_batches(rows.sparkSession)
    rows = rows.select(F.col(text).alias("t"), F.col(label).cast("int").alias("y")).filter("y in (0, 1)")

    def sign(batch: dict) -> dict:
        return {"t": batch["t"], "y": batch["y"], "sig": [sketch(t) for t in batch["t"]]}

    # copies count once: else what two copies share would look like a sign of their label
    once = map_batches(rows.select("t", "y"), sign, "t string, y int, sig binary").groupBy("sig", "y").agg(F.min_by("t", F.xxhash64("t")).alias("t"))
    rows = write_table(once.select("t", "y").coalesce(8), "toxic-rows")

    def count(batches):
        """Of each task: documents with the n-gram, by label, in pieces that have any; numbers of documents as the last."""
        import pyarrow as pa

        n = np.zeros((2, 1 << BITS), np.uint32)
        docs = np.zeros(2, np.uint32)
        for batch in batches:
            for t, y in zip(values(batch.column(0)), batch.column(1).to_pylist()):
                n[y, distinct(t)] += 1
                docs[y] += 1
        flat = n.reshape(-1)
        pieces = [(i, flat[i : i + PIECE]) for i in range(0, len(flat), PIECE) if flat[i : i + PIECE].any()] + [(len(flat), docs)]
        for i, x in pieces:
            yield pa.RecordBatch.from_pydict({"at": pa.array([i], pa.int32()), "n": [zlib.compress(x.tobytes(), 1)]})

    def add(batches):
        import pyarrow as pa

        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(zlib.decompress(raw), np.uint32)
                held[i] = held[i] + x if i in held else x
        for i, x in held.items():
            yield pa.RecordBatch.from_pydict({"at": pa.array([i], pa.int32()), "n": [zlib.compress(x.tobytes(), 1)]})

    flat, total = np.zeros(2 << BITS, np.uint32), [0, 0]
    for r in rows.select("t", "y").mapInArrow(count, "at int, n binary").repartition("at").mapInArrow(add, "at int, n binary").collect():
        x = np.frombuffer(zlib.decompress(r["n"]), np.uint32)
        if r["at"] == len(flat):
            total = [int(v) for v in x]
        else:
            flat[r["at"] : r["at"] + len(x)] = x
    neg, pos = flat.reshape(2, -1)
    none = np.full(1 << BITS, -1, np.int16)
    if not min(total):
        drop_table(rows)
        return Model(none, np.zeros(0), 30.0 if total[1] else -30.0)
    often = np.flatnonzero(pos + neg >= LEAST)
    p, q = pos[often].astype(float), neg[often].astype(float)
    share = (p + q) / sum(total)
    z = (p / total[1] - q / total[0]) / np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / total[0] + 1 / total[1]))
    best = np.argsort(-np.abs(z), kind="stable")[: min(features, 1 << 15)]
    best = best[(np.abs(z[best]) >= 4) | (np.arange(len(best)) < 256)]
    chosen = often[best]
    ratio = np.log((pos[chosen] + 1) / (total[1] + 2)) - np.log((neg[chosen] + 1) / (total[0] + 2))
    slot = none.copy()
    slot[chosen] = np.arange(len(chosen))
    sent = rows.sparkSession.sparkContext.broadcast(slot)

    def pick(batch: dict) -> dict:
        found = []
        for t in batch["t"]:
            at = sent.value[distinct(t)]
            found.append(np.unique(at[at >= 0]).astype(np.int16).tobytes())
        return {"y": batch["y"], "x": found}

    xs, ys = [], []
    for r in map_batches(rows, pick, "y int, x binary").collect():
        xs.append(np.frombuffer(r["x"], np.int16))
        ys.append(r["y"])
    drop_table(rows)
    sent.destroy()
    order = sorted(range(len(xs)), key=lambda i: (ys[i], xs[i].tobytes()))  # the same sums in whatever order rows arrive
    xs, y = [xs[i] for i in order], np.array([ys[i] for i in order], float)
    col = np.concatenate(xs).astype(np.int64)
    row = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    del xs, order
    w, b = fit(row, col, ratio, y, l2)
    del row, col
    trim()
    return Model(slot, w * ratio, b)


def fit(row: np.ndarray, col: np.ndarray, ratio: np.ndarray, y: np.ndarray, l2: float, steps: int = 120) -> tuple[np.ndarray, float]:
    """Logistic regression over x[row, col] = ratio[col], by limited-memory BFGS."""
    n, m, value = len(y), len(ratio), ratio[col]

    def loss(p: np.ndarray) -> tuple[float, np.ndarray]:
        s = np.bincount(row, value * p[col], n) + p[m]
        e = 1 / (1 + np.exp(-np.clip(s, -60, 60)))
        grad = np.append(np.bincount(col, value * (e - y)[row], m) + l2 * p[:m], (e - y).sum())
        return float(np.logaddexp(0, np.where(y > 0, -s, s)).sum() + l2 / 2 * (p[:m] ** 2).sum()), grad

    p = np.zeros(m + 1)
    p[m] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    f, g = loss(p)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, alphas = -g, []
        for s, t, r in reversed(past):
            alphas.append(a := r * (s @ d))
            d = d - a * t
        if past:
            s, t, _ = past[-1]
            d = d * ((s @ t) / (t @ t))
        for (s, t, r), a in zip(past, reversed(alphas)):
            d = d + s * (a - r * (t @ d))
        step = 1.0 if past else min(1.0, 1 / (np.abs(g).sum() + 1e-12))
        while step > 1e-10:
            q = p + step * d
            f2, g2 = loss(q)
            if f2 <= f + 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            break
        s, t = q - p, g2 - g
        if s @ t > 1e-12:
            past = [*past[-9:], (s, t, 1 / (s @ t))]
        done = abs(f - f2) <= 1e-7 * max(1.0, abs(f))
        p, f, g = q, f2, g2
        if done:
            break
    return p[:m], float(p[m])


def labelled(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "toxic", text: str = "text", max_rows: int = 24_000) -> DataFrame:
    """(key, text, label) of docs joined with at most about max_rows labels, chosen by hash of the key: few enough to broadcast."""
    labels = labels.select(F.col(key).alias("k"), F.col(label).alias("y")).filter("k is not null and y in (0, 1)")
    n = max(1, labels.count())
    part = labels.filter(F.pmod(F.xxhash64("k", F.lit("toxicity")), F.lit(1 << 20)) < int(min(1.0, max_rows / n) * (1 << 20)))
    plain = docs.select(F.col(key).alias("d"), F.col(text).alias("t"))
    return plain.join(F.broadcast(part), F.col("d") == F.col("k")).select(F.col("d").alias(key), F.col("t").alias(text), F.col("y").alias(label))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "toxic_score", keep_text: bool = False) -> DataFrame:
    """docs with a score from 0 to 1 for each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = rest(docs, out, *([] if keep_text else [text]))

    def run(batch: dict) -> dict:
        return {c: batch[c] for c in keep} | {out: [sent.value.score(t) for t in batch[text]]}

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return map_batches(docs, run, f"{schema}`{out}` double")
