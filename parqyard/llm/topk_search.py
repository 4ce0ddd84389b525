"""Exact top-k inner-product search by ball-tree branch and bound over shards.

Vectors hold integers. Each shard builds a ball tree; a query visits its nodes in the order of their upper bound
q.c + |q| r and stops at the current kth score. A query first searches the shard it lives in, then some others (the
square root of their number), then the rest; in each round the kth score of all shards before goes with it, so only nodes
that can still beat it are looked at. In a round a tree is moved once, to the task that takes the queries sent to its
shard; nothing is broadcast, and what moves besides is each query, once for each shard.

Edge cases: rows with a null id, and vectors that are null, empty or hold nulls, take no part. Ties go to the smaller
id. Rows that share a query's id count as the query itself; of several queries of one id, the one whose vector sorts first asks. Vectors of another length than the query's are no
candidates. Fewer candidates than k: all are returned. Scores beyond a long's range count as its
ends. An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_table, write_table

LEAF = 128
_FOUND = "array<struct<score: long, id: long>>"
_PACKED = f"shard int, d int, tree binary, query_id long, v array<long>, found {_FOUND}"
_ARROW = pa.schema([("shard", pa.int32()), ("d", pa.int32()), ("tree", pa.binary()), ("query_id", pa.int64()), ("v", pa.list_(pa.int64())), ("found", pa.list_(pa.struct([("score", pa.int64()), ("id", pa.int64())])))])
_LEAST = -(1 << 63)


@dataclass
class Tree:
    ids: np.ndarray
    rows: np.ndarray  # integers, in the tree's order
    first: np.ndarray
    last: np.ndarray
    left: np.ndarray  # number of the left child, -1 for a leaf; the right child is the next
    center: np.ndarray
    radius: np.ndarray
    least: np.ndarray  # smallest id below

    @classmethod
    def build(cls, ids: np.ndarray, rows: np.ndarray) -> Tree:
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], rows[order].astype(float)
        at = np.arange(len(ids))
        first, last, left, center, radius = [0], [len(ids)], [-1], [None], [0.0]
        todo = [0]
        while todo:
            k = todo.pop()
            a, b = first[k], last[k]
            part = x[at[a:b]]
            center[k] = c = part.mean(0)
            radius[k] = float(np.sqrt(((part - c) ** 2).sum(1).max()))
            if b - a <= LEAF or radius[k] == 0:
                continue
            p = part[((part - c) ** 2).sum(1).argmax()]
            q = part[((part - p) ** 2).sum(1).argmax()]
            rank = np.argsort(part @ (q - p), kind="stable")
            at[a:b] = at[a:b][rank]
            m = (a + b) // 2
            left[k] = len(first)
            for lo, hi in ((a, m), (m, b)):
                todo.append(len(first))
                for into, v in ((first, lo), (last, hi), (left, -1), (center, None), (radius, 0.0)):
                    into.append(v)
        ids = ids[at]
        least = np.array([ids[a:b].min() for a, b in zip(first, last)])
        return cls(ids, rows[order][at], np.array(first), np.array(last), np.array(left), np.array(center), np.array(radius), least)

    def search(self, qids: np.ndarray, queries: np.ndarray, k: int, floor: list[tuple[int, int] | None], seen: list[int] | None = None) -> list[list[tuple[int, int]]]:
        """For each query its k best (score, -id) here, none below its floor (score, -id)."""
        q = queries.astype(float)
        top = float(np.abs(self.rows.astype(float)).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(1, q.shape[1])
        exact = top < 2**53
        own = self.rows.astype(float if exact else object)
        asked = q if exact else queries.astype(object)
        slack = 1e-9 * (top + 1)  # more than the rounding of a bound
        bound = q @ self.center.T + np.sqrt((q**2).sum(1))[:, None] * self.radius + slack
        out = []
        for i, qid in enumerate(qids):
            u, best = bound[i], []
            base = floor[i]
            nodes = [(-u[0], 0)]
            while nodes:
                high, n = heapq.heappop(nodes)
                kth = best[0] if len(best) == k else base
                if kth is not None and (-high < kth[0] or (-high < kth[0] + 1 - slack and -self.least[n] < kth[1])):
                    if -high < kth[0]:
                        break
                    continue
                if self.left[n] >= 0:
                    for c in (self.left[n], self.left[n] + 1):
                        heapq.heappush(nodes, (-u[c], int(c)))
                    continue
                a, b = self.first[n], self.last[n]
                if seen is not None:
                    seen.append(b - a)
                score, ids = own[a:b] @ asked[i], self.ids[a:b]
                if not exact:
                    score = np.array([max(_LEAST, min(-_LEAST - 1, int(x))) for x in score], object)
                may = np.nonzero(((score >= kth[0]).astype(bool) if kth is not None else np.ones(len(ids), bool)) & (ids != qid))[0]
                if len(may) > 4 * k:  # the best k of a leaf are enough
                    may = may[np.lexsort((ids[may], -score[may]))[:k]]
                for j in may:
                    x = (int(score[j]), -int(ids[j]))
                    if base is not None and x < base:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, x)
                    elif x > best[0]:
                        heapq.heapreplace(best, x)
            out.append(sorted(best, reverse=True))
        return out


def search(vectors: DataFrame, vec_id: str, vector: str, is_query: str, k: int = 5, shard_rows: int = 8192) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best for each row where the boolean column is_query holds."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<long>").alias("v"), F.coalesce(F.col(is_query), F.lit(False)).alias("q"))
    rows = rows.filter("id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null)")
    shards = max(1, -(-rows.count() // shard_rows))

    def pack(batches):
        """For each length of vector a row with the tree, and a row for each own query with what was found for it there."""
        ids, vs, qs = [], [], []
        for b in batches:
            ids.append(b.column(0).to_numpy())
            vs += [np.array(x, np.int64) for x in b.column(1).to_pylist()]
            qs.append(np.array(b.column(2).to_pylist(), bool))
        if not vs:
            return
        shard = TaskContext.get().partitionId()
        ids, qs, dims = np.concatenate(ids), np.concatenate(qs), np.array([len(v) for v in vs])
        for d in np.unique(dims):
            part = np.nonzero(dims == d)[0]
            own, x = ids[part], np.stack([vs[i] for i in part])
            for kind in (np.int16, np.int32):
                if np.iinfo(kind).min <= x.min() and x.max() <= np.iinfo(kind).max:
                    x = x.astype(kind)
                    break
            tree, asks = Tree.build(own, x), np.nonzero(qs[part])[0]
            found = tree.search(own[asks], x[asks], k, [None] * len(asks))
            yield _batch([(shard, int(d), pickle.dumps(tree), None, None, None)])
            for at in range(0, len(asks), 1000):
                yield _batch([(shard, int(d), None, int(own[i]), x[i].tolist(), [{"score": s, "id": -j} for s, j in f]) for i, f in zip(asks[at : at + 1000], found[at : at + 1000])])

    packed = write_table(rows.repartition(shards, "id").mapInArrow(pack, _PACKED), "shards")
    # a retried or widened shuffle may number shards differently from `shards`, so the table says how many there are
    count = 1 + packed.agg(F.coalesce(F.max("shard"), F.lit(-1))).first()[0]
    trees = packed.filter("tree is not null").select("shard", "d", "tree", F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("array<long>").alias("v"), F.lit(None).cast(_FOUND).alias("found"))
    asks = packed.filter("tree is null").groupBy("query_id").agg(F.min(F.struct("v", "shard", "d", "found")).alias("s"))  # one row of a repeated query
    asks = asks.select(F.col("s.shard").alias("home"), "s.d", "query_id", "s.v", "s.found")

    def look(batches):
        """Rows come by shard, its tree first; queries follow with the k best so far, which this shard's are added to."""
        at, tree = None, None
        for b in batches:
            shard, d, raw = (b.column(i).to_pylist() for i in range(3))
            qids, found, v = b.column(3).to_pylist(), b.column(5).to_pylist(), b.column(4)
            asked: list[int] = []

            def answer():
                if not asked:
                    return
                queries = np.stack([np.array(v[i].as_py(), np.int64) for i in asked])
                best = [[(f["score"], -f["id"]) for f in found[i] or ()] for i in asked]
                floor = [min(f) if len(f) == k else None for f in best]
                got = tree.search(np.array([qids[i] for i in asked]), queries, k, floor) if tree is not None else [[] for _ in asked]
                yield pa.RecordBatch.from_pydict({"query_id": pa.array([qids[i] for i in asked], pa.int64()), "found": pa.array([[{"score": s, "id": -j} for s, j in g] for g in got], _ARROW.field("found").type)})
                asked.clear()

            for i in range(b.num_rows):
                if (shard[i], d[i]) != at:
                    yield from answer()
                    at, tree = (shard[i], d[i]), None
                if raw[i] is not None:
                    tree = pickle.loads(raw[i])
                else:
                    asked.append(i)
            yield from answer()

    # each round sends every query, with the kth score of all shards before, to more shards; trees move once a round
    near = max(1, math.isqrt(count))
    best, held = asks, None
    for low, high in ((1, min(near, count - 1)), (near + 1, count - 1)):
        if low > high:
            continue
        away = F.explode(F.expr(f"transform(sequence({low}, {high}), x -> cast((home + x) % {count} as int))"))
        sent = best.select(away.alias("shard"), "d", F.lit(None).cast("binary").alias("tree"), "query_id", "v", "found")
        met = trees.unionByName(sent).repartition("shard", "d").sortWithinPartitions("shard", "d", F.col("tree").isNull())
        more = met.mapInArrow(look, f"query_id long, found {_FOUND}").filter("size(found) > 0").select("query_id", F.explode("found").alias("f"))
        known = best.select("query_id", F.explode("found").alias("f")).unionByName(more).select("query_id", "f.score", "f.id")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        top = known.withColumn("rank", rank).filter(F.col("rank") <= k).groupBy("query_id").agg(F.collect_list(F.struct("score", "id")).alias("found"))
        now = best.drop("found").join(top.withColumnRenamed("query_id", "_q"), F.col("query_id") == F.col("_q"), "left").drop("_q")
        new = write_table(now, "found")
        if held is not None:
            drop_table(held)
        best = held = new
    listed = F.array_sort("found", lambda x, y: F.when(x["score"] != y["score"], F.when(x["score"] > y["score"], -1).otherwise(1)).when(x["id"] < y["id"], -1).otherwise(1))
    return best.select("query_id", F.posexplode(listed).alias("place", "f")).select("query_id", (F.col("place") + 1).alias("rank"), F.col("f.id").alias("vec_id"), "f.score")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)
