"""Incremental substring dedup with a log-structured index of window fingerprints.

A window is `window` consecutive words. Each window has an anchor: the least hash among its `gram`-word runs, so equal
windows have equal anchors and neighbouring windows mostly share one. The index is a log of immutable runs of (anchor,
row, order), bucketed and sorted by anchor. A new batch becomes a run of its own, and its anchors are merge-joined with those of all runs, bucket by bucket,
without moving what is stored; only anchors that two different documents hold are looked at again. There windows are verified by
digests of their words' own bytes (64 bits of BLAKE2b, beside the anchor's 64): they decide which windows a document
of smaller order holds too. Runs of a level are compacted into one of the next once there are `fanout` of them. The manifest is stored
with the runs, so an index is opened again by its path.

Anchors that more than `hot` rows hold are kept apart, so that no bucket grows with one, and are settled by a partial
aggregation and a join on (anchor, window), whose skew Spark can split; the others by one sorted stream. The texts of
earlier batches are scanned for those rows that share an anchor with the new batch; they are given to add(), not kept.

Edge cases: null and empty texts have no words and stay as they are; texts shorter than a window lose nothing. A null
document id is later than all others. Repeats within one document, and rows with the same id, are not removed for
each other's sake; repeated rows get the same result. Empty tables give no rows. Invalid UTF-8 counts as U+FFFD. Extra
columns are kept; columns named like those added here (`n_words`, `n_removed`, `kept_text`) are replaced. Rows are told
apart by 128 bits.
"""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import POWERS, ascii_words, drop_table, identity, map_batches, mix, rest, scratch_root, sieve, sifted, word_hashes, write_table

_PART = 62  # windows in one row: their marks fit in a long


def anchor_of(words: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The anchor of each window of the words with these hashes, by its first word."""
    n = len(words)
    if n < window:
        return np.zeros(0, np.uint64)
    up, down = POWERS.of(n + 1)
    total = np.concatenate(([np.uint64(0)], np.cumsum(words * up[:n])))
    least, width, want = mix((total[gram:] - total[:-gram]) * down[: n - gram + 1]), 1, window - gram + 1
    while width < want:
        step = min(width, want - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    return least


class Digests:
    """Digests of windows of a text, from the bytes of the words themselves."""

    def __init__(self, text: str | None, window: int):
        words = ascii_words(text)
        self.raw, self.window = b" ".join(words), window
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        self.at = np.concatenate(([0], np.cumsum(size))).tolist()

    def of(self, first: int, end: int) -> bytes:
        """Eight bytes for each window that begins at one of the places."""
        raw, at, w, digest = self.raw, self.at, self.window, hashlib.blake2b
        return b"".join([digest(raw[at[i] : at[i + w] - 1], digest_size=8).digest() for i in range(first, end)])


def _segments(least: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last+1 of the runs of windows with one wanted anchor, of at most _PART windows."""
    ok = np.isin(least, wanted)
    at = np.nonzero(ok)[0]
    if not len(at):
        return at, at
    new = np.ones(len(at), bool)
    new[1:] = (least[at[1:]] != least[at[:-1]]) | (at[1:] != at[:-1] + 1)
    start = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    new |= (np.arange(len(at)) - start) % _PART == 0
    first = np.nonzero(new)[0]
    return at[first], at[first] + np.diff(np.append(first, len(at)))


class FingerprintIndex:
    """The log of runs. A manifest, a new file for each version, lists them by (level, name); no run is ever changed.

    A run has three tables: `heads`, a row for each anchor with the number of rows and the least and greatest order;
    `posts`, the rows (anchor, rid, ord); and `often`, the same of anchors that more than `hot` rows of the run hold. Heads and
    posts are bucketed and sorted by anchor, so that runs are merge-joined where they lie. Opened with the path of an existing index, it
    goes on where that one stopped, with the settings that it was made with.
    """

    def __init__(self, spark: SparkSession, window: int = 50, gram: int = 16, fanout: int = 4, hot: int = 1000, path: str | None = None, buckets: int | None = None):
        self.spark, self.window, self.gram, self.fanout, self.hot = spark, window, gram, fanout, hot
        self.root = path or f"{scratch_root(spark)}/fingerprints-{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[tuple[int, str]] = []
        self.version, self.tables = 0, {}
        path_of = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = path_of(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        at = path_of(f"{self.root}/manifests")
        if self.fs.exists(at):
            self.version = max((int(f.getPath().getName()) for f in self.fs.listStatus(at) if f.getPath().getName().isdigit()), default=0)
        if self.version:
            stream = self.fs.open(path_of(f"{self.root}/manifests/{self.version:08}"))
            told = json.loads(bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
            stream.close()
            self.window, self.gram, self.fanout, self.hot, self.buckets = (told[k] for k in ("window", "gram", "fanout", "hot", "buckets"))
            self.runs = [(level, name) for level, name in told["runs"]]

    def _save(self, runs: list[tuple[int, str]]) -> None:
        """Makes runs the current ones: a whole manifest appears at once under the next number, or not at all."""
        path_of = self.spark._jvm.org.apache.hadoop.fs.Path
        told = {k: getattr(self, k) for k in ("window", "gram", "fanout", "hot", "buckets")} | {"runs": runs}
        draft = path_of(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(json.dumps(told).encode())
        stream.close()
        if not self.fs.rename(draft, path_of(f"{self.root}/manifests/{self.version + 1:08}")):
            raise RuntimeError("another writer has changed the index")
        self.version, self.runs = self.version + 1, runs

    def _table(self, at: str) -> DataFrame:
        """A bucketed table of the index, which this session may not know yet."""
        if at not in self.tables:
            name = f"fingerprints_{uuid.uuid4().hex}"
            columns = "anchor bigint, n bigint, a bigint, b bigint" if at.endswith("heads") else "anchor bigint, hot boolean" if at.endswith("shared") else "anchor bigint, rid binary, ord bigint"
            self.spark.sql(f"create table {name} ({columns}) using parquet clustered by (anchor) sorted by (anchor) into {self.buckets} buckets location '{self.root}/{at}'")
            self.tables[at] = name
        return self.spark.table(self.tables[at])

    def _write(self, rows: DataFrame, at: str) -> None:
        """Stores rows in one file for each bucket."""
        name = f"fingerprints_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, "anchor").sortWithinPartitions("anchor")
        dealt.write.format("parquet").bucketBy(self.buckets, "anchor").sortBy("anchor").option("compression", "zstd").option("path", f"{self.root}/{at}").saveAsTable(name)
        self.tables[at] = name

    def _often(self, run: str) -> DataFrame:
        return self.spark.read.schema("anchor long, rid binary, ord long").parquet(f"{self.root}/{run}/often")

    def _run(self, rows: DataFrame) -> str:
        """A new run of stored rows (anchor, rid, ord)."""
        run = uuid.uuid4().hex
        self._write(rows.groupBy("anchor").agg(F.count("*").alias("n"), F.min("ord").alias("a"), F.max("ord").alias("b")), f"{run}/heads")
        many = self._table(f"{run}/heads").filter(F.col("n") > self.hot).select("anchor")
        self._write(rows.join(many, "anchor", "left_anti"), f"{run}/posts")
        rows.join(many, "anchor", "left_semi").write.option("compression", "zstd").parquet(f"{self.root}/{run}/often")
        return run

    def _drop(self, at: str) -> None:
        for name in [k for k in self.tables if k == at or k.startswith(f"{at}/")]:
            self.spark.sql(f"drop table if exists {self.tables.pop(name)}")
        self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{at}"), True)

    def compact(self) -> None:
        """Merges the runs of each full level into one of the next level."""
        level = 0
        while any(at >= level for at, _ in self.runs):
            full = [run for at, run in self.runs if at == level]
            if len(full) >= self.fanout:
                rows = None
                for run in full:
                    part = self._table(f"{run}/posts").unionByName(self._often(run))
                    rows = part if rows is None else rows.unionByName(part)
                merged = self._run(rows)
                self._save([r for r in self.runs if r[0] != level] + [(level + 1, merged)])
                for run in full:
                    self._drop(run)
            level += 1

    def _shared(self, new: str, old: list[str]) -> str:
        """The anchors that a row of the new run and a row of another order, in any run, hold: merge joins of sorted
        buckets, one row for each anchor in either, without an exchange."""
        joined = self._table(f"{new}/heads")
        least, n = [F.col("a")], [F.col("n")]
        for i, run in enumerate(old):
            heads = self._table(f"{run}/heads").select("anchor", F.col("a").alias(f"a{i}"), F.col("n").alias(f"n{i}"))
            joined = joined.join(heads.hint("merge"), "anchor", "left")
            least.append(F.coalesce(f"a{i}", "a"))
            n.append(F.coalesce(f"n{i}", F.lit(0)))
        low = F.least(*least) if len(least) > 1 else least[0]
        shared = joined.filter(low < F.col("b")).select("anchor", (sum(n[1:], n[0]) > self.hot).alias("hot"))
        at = f"{new}/shared"
        self._write(shared, at)
        return at

    def add(self, batch: DataFrame, history: DataFrame | None) -> DataFrame:
        """Indexes a batch (rid binary, ord, text) and returns (rid, spans): the windows that earlier rows hold.

        history has the rows of earlier batches, for verifying. spans: array of (first window, marks), where bit i of
        marks stands for window first + i.
        """
        window, gram = self.window, self.gram

        def anchors(b: dict) -> dict:
            rid, out, ords = [], [], []
            for r, o, t in zip(b["rid"], b["ord"], b["text"]):
                a = np.unique(anchor_of(word_hashes(t), window, gram))
                out.append(a.view(np.int64))
                rid += [r] * len(a)
                ords.append(np.full(len(a), o, np.int64))
            return {"anchor": np.concatenate(out), "rid": rid, "ord": np.concatenate(ords)}

        raw = write_table(map_batches(batch.select("rid", "ord", "text"), anchors, "anchor long, rid binary, ord long"), "anchors")
        old = [run for _, run in self.runs]
        new = self._run(raw)
        drop_table(raw)
        shared_at = self._shared(new, old)
        shared = self._table(shared_at)
        held = None
        for run in (new, *old):
            for part in (self._table(f"{run}/posts").join(shared.hint("merge"), "anchor"), self._often(run).join(shared, "anchor")):
                part = part.select("rid", "anchor", "hot", F.lit(run == new).alias("new"))
                held = part if held is None else held.unionByName(part)
        wanted = held.groupBy("rid").agg(F.collect_set(F.when(~F.col("hot"), F.col("anchor"))).alias("cold"), F.collect_set(F.when(F.col("hot"), F.col("anchor"))).alias("hot"), F.max("new").alias("new"))
        wanted = write_table(wanted, "wanted")
        self._drop(shared_at)
        texts = batch.select("rid", "ord", "text")
        if history is not None:
            texts = texts.unionByName(history.select("rid", "ord", "text"))
        may = sieve(wanted.select("rid"))  # the texts of other rows need not be moved
        texts = sifted(texts, "rid", may).join(wanted, "rid")

        def windows(b: dict) -> dict:
            out: dict[str, list] = {k: [] for k in ("anchor", "rid", "ord", "new", "hot", "first", "hashes")}
            for r, o, t, cold, hot, new in zip(b["rid"], b["ord"], b["text"], b["cold"], b["hot"], b["new"]):
                least, digests = anchor_of(word_hashes(t), window, gram), Digests(t, window)
                for kind, ids in ((False, cold), (True, hot)):
                    if not ids:
                        continue
                    for i, j in zip(*_segments(least, np.array(ids, np.int64).view(np.uint64))):
                        out["anchor"].append(int(least[i].view(np.int64)))
                        out["rid"].append(r)
                        out["ord"].append(o)
                        out["new"].append(new)
                        out["hot"].append(kind)
                        out["first"].append(int(i))
                        out["hashes"].append(digests.of(int(i), int(j)))
            return out

        occ = map_batches(texts.select("rid", "ord", "text", "cold", "hot", "new"), windows, "anchor long, rid binary, ord long, new boolean, hot boolean, first int, hashes binary")
        occ = write_table(occ, "windows")
        drop_table(wanted)

        def settle(batches):
            """In order of (anchor, ord): a window is marked if a smaller ord had it."""
            at, order, seen, fresh = None, None, set(), set()
            for b in batches:
                rid, first, marks = [], [], []
                for a, o, r, new, f, h in zip(*(b.column(c).to_pylist() for c in ("anchor", "ord", "rid", "new", "first", "hashes"))):
                    if a != at:
                        at, order, seen, fresh = a, o, set(), set()
                    elif o != order:
                        seen |= fresh
                        order, fresh = o, set()
                    own = np.frombuffer(h, np.uint64).tolist()
                    if new and seen:
                        m = sum(1 << i for i, x in enumerate(own) if x in seen)
                        if m:
                            rid.append(r)
                            first.append(f)
                            marks.append(m)
                    fresh.update(own)
                if rid:
                    yield pa.RecordBatch.from_arrays([pa.array(rid, pa.binary()), pa.array(first, pa.int32()), pa.array(marks, pa.int64())], names=["rid", "first", "marks"])

        cold = occ.filter("not hot").select("anchor", "ord", "rid", "new", "first", "hashes").repartition("anchor").sortWithinPartitions("anchor", "ord")
        marked = cold.mapInArrow(settle, "rid binary, first int, marks long")

        def spread(b: dict) -> dict:
            n = [len(h) // 8 for h in b["hashes"]]
            rep = {c: np.repeat(np.array(b[c], np.int64), n) for c in ("anchor", "ord")}
            rep["rid"] = [r for r, k in zip(b["rid"], n) for _ in range(k)]
            at = np.concatenate([np.arange(f, f + m, dtype=np.int32) for f, m in zip(b["first"], n)])
            return rep | {"new": np.repeat(np.array(b["new"], bool), n), "h": np.frombuffer(b"".join(b["hashes"]), np.int64), "first": at}

        single = map_batches(occ.filter("hot").select("anchor", "rid", "ord", "new", "first", "hashes"), spread, "anchor long, rid binary, ord long, new boolean, h long, first int")
        least = single.groupBy("anchor", "h").agg(F.min("ord").alias("least"))
        least = write_table(least, "least")  # a table on either side of the join: Spark can split a hot window
        late = single.filter("new").join(least, ["anchor", "h"]).filter("least < ord").select("rid", "first", F.lit(1).cast("long").alias("marks"))
        spans = marked.unionByName(late).groupBy("rid").agg(F.collect_list(F.struct("first", "marks")).alias("spans"))
        spans = write_table(spans, "spans")
        drop_table(occ)
        drop_table(least)
        self._save([*self.runs, (0, new)])
        self.compact()
        return spans

    def close(self, delete: bool = False) -> None:
        """Forgets the session's names of the index's tables; with delete, the index goes too."""
        for name in self.tables.values():
            self.spark.sql(f"drop table if exists {name}")
        self.tables.clear()
        if delete:
            self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.root), True)


def remove(batch: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """batch (with rid and text) plus n_words, n_removed and kept_text: the words that no marked window covers."""

    def cut(b: dict) -> dict:
        total, gone, kept = [], [], []
        for t, found in zip(b["text"], b["spans"]):
            words = ascii_words(t)
            total.append(len(words))
            if found:
                edge = np.zeros(len(words) + 1, np.int32)
                for s in found:
                    marks = s["marks"]
                    while marks:
                        low = (marks & -marks).bit_length() - 1
                        edge[s["first"] + low] += 1
                        edge[s["first"] + low + window] -= 1
                        marks &= marks - 1
                keep = np.cumsum(edge[:-1]) == 0
                gone.append(int(len(words) - keep.sum()))
                words = [w for w, k in zip(words, keep) if k]
            else:
                gone.append(0)
            kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
        return {c: b[c] for c in keep_columns} | {"n_words": total, "n_removed": gone, "kept_text": kept}

    keep_columns = [c for c in batch.columns if c not in ("n_words", "n_removed", "kept_text")]
    schema = "".join(f"`{c}` {batch.schema[c].dataType.simpleString()}, " for c in keep_columns)
    rows, may = batch.select(*keep_columns), sieve(spans.select("rid"))
    found = sifted(rows, "rid", may).join(spans, "rid", "left").select(*keep_columns, "spans")

    def whole(b: dict) -> dict:
        """Of rows that stay where they lie."""
        mine = np.flatnonzero(~may(np.array(b["sieve_hash"], np.int64))).tolist()
        return cut({c: [b[c][i] for i in mine] for c in keep_columns} | {"spans": [None] * len(mine)})

    schema = f"{schema}n_words long, n_removed long, kept_text string"
    return map_batches(found, cut, schema).unionByName(map_batches(rows.select("*", F.xxhash64("rid").alias("sieve_hash")), whole, schema))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", batches: int = 3, window: int = 50, gram: int = 16, fanout: int = 2, hot: int = 1000) -> DataFrame:
    """Feeds docs to an index in `batches` batches of ascending id; returns them with n_words, n_removed, kept_text. The
    stored tables that the result is read from are in its attribute `scratch`."""
    spark = docs.sparkSession
    index = FingerprintIndex(spark, window, gram, fanout, hot)
    others = rest(docs, doc_id, text, "n_words", "n_removed", "kept_text")
    rows = docs.select(F.unhex(identity(doc_id, text)).alias("rid"), F.coalesce(F.col(doc_id), F.lit(2**63 - 1)).cast("long").alias("ord"), F.col(text).alias("text"), F.struct(F.col(doc_id), *[F.col(f"`{c}`") for c in others]).alias("rest"))
    cuts = rows.select(F.percentile_approx("ord", [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] if batches > 1 else []
    edges = [None, *sorted(set(cuts or [])), None]
    out = []
    for low, high in zip(edges, edges[1:]):
        part, past = rows, None
        if low is not None:
            part, past = part.filter(F.col("ord") > low), rows.filter(F.col("ord") <= low)
        if high is not None:
            part = part.filter(F.col("ord") <= high)
        spans = index.add(part.select("rid", "ord", "text"), past)
        out.append(spans)
    index.close(delete=True)
    spans = out[0]
    for x in out[1:]:
        spans = spans.unionByName(x)
    whole = remove(rows, spans, window)
    whole = whole.select(F.col(f"rest.`{doc_id}`").alias(doc_id), F.col("text").alias(text), *[F.col(f"rest.`{c}`").alias(c) for c in others], "n_words", "n_removed", "kept_text")
    whole.scratch = out
    return whole
