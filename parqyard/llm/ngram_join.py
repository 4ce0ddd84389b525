"""N-gram Jaccard self-join with adaptive multi-match prefixes, as components and link counts.

A document is the set of its hashed word n-grams. Equal sets form one class, and only one row of each class is indexed.
All classes order their n-grams alike, by
an estimated document frequency (counts in a table of fixed size, over all documents), then by hash. A class that
needs m of its n n-grams to be shared (m = ceil(t n)) indexes its first n - m + L n-grams, and two classes can only link
if they share at least the smaller L of the two among those. Each class picks its L by the estimated cost of candidates:
a longer prefix is read more often but lets fewer coincidences through.

The estimate can't tell n-grams apart that are rarer than its own noise, which grows with the data. So prefixes a quarter
longer are counted exactly first, n-gram by n-gram; those in more than `short` classes that are not copies of one text go
behind all others in the order (a bitmap of fixed size says which), and the classes that they would bring together by
chance alone are not.

Where to look: pairs from short posting lists that meet the count, and stars along long ones, which are no pairs yet. The
components of this graph are cut into blocks, and each pair of blocks of one component goes to one task. There every
pair of classes is held to the count of shared prefix n-grams, whatever lists it came from, and what passes is verified
by its whole sets; link counts and a spanning forest come out instead of pairs. The forest's components are the
result. No pair is dropped: long lists only make the groups wider in which counts are taken.

Edge cases: null or blank texts have no n-grams and link with nothing; texts with fewer words than n have one n-gram,
the whole sequence. Rows with a null id are linked like others; an id of null is never a component's id unless all its
rows have none. Repeated rows are members of one class. Invalid UTF-8 counts as U+FFFD. Empty tables give no rows; extra
columns are ignored. Classes and rows are told apart by 128 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, claim, drop_table, identity, is_set, map_batches, shingles, sieve, sifted, small_batches, trim, values, word_hashes, write_table
from .components import components

_CHUNK = 14  # the frequency table travels in pieces of 2**14 counts
_CROWDED = 26  # bits of the bitmap of n-grams that many classes hold
_PARTS = 10  # n-grams are counted in 2**10 parts, by the first bits of their hashes
_ALIKE = 4  # so many lists with the same first and last class are of copies, not of chance
_SEEN = 200_000  # classes that a task remembers


def ngram_set(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of the text's word n-grams, A-Z lower-cased."""
    return np.unique(shingles(word_hashes(text, lower=True), n))


def survey(rows: DataFrame, n: int, bits: int, kind: str) -> DataFrame:
    """In one pass over rows (doc_id, rid, text), stored: of each row its number of n-grams and its class (chunk is null),
    and of each task document counts of n-grams by the first `bits` bits of their hash, in pieces."""

    def look(batches):
        import xxhash

        total, fields = np.zeros(1 << bits, np.uint32), None
        for batch in batches:
            fields = batch.schema.field(0).type, batch.schema.field(1).type
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                sets = [ngram_set(t, n) for t in values(part.column(2))]
                total += np.bincount(np.concatenate([np.zeros(0, np.uint64), *sets]).astype(np.uint64) >> np.uint64(64 - bits), minlength=1 << bits).astype(np.uint32)
                own = [xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None for s in sets]
                none = [None] * len(sets)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(own, pa.string()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], names=["doc_id", "rid", "n", "cls", "chunk", "counts"])
        for i in range(0, 1 << bits, 1 << _CHUNK):
            piece = np.minimum(total[i : i + (1 << _CHUNK)], 65535).astype(np.uint16)  # of a task; they only order
            if fields and piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([None], fields[0]), pa.array([None], fields[1]), pa.array([None], pa.int64()), pa.array([None], pa.string()), pa.array([i], pa.int32()), pa.array([piece.tobytes()], pa.binary())], names=["doc_id", "rid", "n", "cls", "chunk", "counts"])

    return write_table(rows.select("doc_id", "rid", "text").mapInArrow(look, f"doc_id {kind}, rid string, n long, cls string, chunk int, counts binary"), "members")


def frequencies(surveyed: DataFrame, bits: int) -> np.ndarray:
    """The document counts of all tasks added up: as many numbers as the table has, whatever the data."""

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x = np.frombuffer(b, np.uint16).astype(np.uint32)
                held[i] = held[i] + x if i in held else x
        for i, x in held.items():
            yield pa.RecordBatch.from_pydict({"chunk": pa.array([i], pa.int32()), "counts": [x.tobytes()]})

    out = np.zeros(1 << bits, np.uint32)
    for r in surveyed.filter("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(add, "chunk int, counts binary").collect():
        out[r["chunk"] : r["chunk"] + (1 << _CHUNK)] = np.frombuffer(r["counts"], np.uint32)
    return out


def prefix(grams: np.ndarray, freq: np.ndarray, bits: int, num: int, den: int, most: int, load: float, verify: float = 8.0, late: np.ndarray | None = None, spare: float = 0.0) -> tuple[np.ndarray, int]:
    """The n-grams to index and the number of matches L that goes with them.

    late says which n-grams come behind all others. With spare, so large a share of n-grams more is returned, those next in order.
    """
    n = len(grams)
    need = -(-num * n // den)
    f = freq[(grams >> np.uint64(64 - bits)).astype(np.int64)].astype(float)
    order = np.lexsort((grams, f) if late is None else (grams, f, late))
    top = min(most, need)
    first = n - need + 1
    own = np.maximum(f[order[: first + top - 1]] - 1 - load, 0) + 0.01  # what others hold, without the table's own crowding
    cost = np.cumsum(own)[first - 1 :]
    level = np.arange(1, top + 1)
    best = int(np.argmin(cost + 0.02 * level + verify * cost / level))
    more = int(np.ceil(spare * (first + best))) + 8 if spare else 0
    return grams[order[: first + best + more]], best + 1


def crowded(texts: DataFrame, n: int, heads, short: int) -> np.ndarray:
    """A bitmap, by the first bits of their hashes, of the n-grams that more than `short` classes have among heads(set).

    Lists that begin and end with the same two classes as others do are left out: they are of near copies, which belong
    together. Only the order of n-grams depends on it, so hashes cut to 40 bits, classes to 24 and classes counted once a
    task do.
    """
    low = 40 - _PARTS

    def look(batches):
        import xxhash

        claim("texts")
        seen: set[int] = set()
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                grams, keys = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)]
                for t in values(batch.slice(lo, 2000).column(0)):
                    s = ngram_set(t, n)
                    own = xxhash.xxh3_64_intdigest(s.tobytes())
                    if len(s) and own not in seen:
                        seen.add(own)
                        grams.append(heads(s) >> np.uint64(24))
                        keys.append(np.full(len(grams[-1]), own & 0xFFFFFF, np.uint32))
                if len(seen) > _SEEN:
                    seen.clear()
                v, k = np.concatenate(grams).astype(np.int64), np.concatenate(keys)
                order = np.argsort(v)
                v, k = v[order], k[order]
                parts = np.unique(v >> low)
                ends = np.searchsorted(v >> low, parts, "right").tolist()
                # sorted numbers as steps, and their bytes by place: they compress
                steps = [np.diff(v[a:b] & ((1 << low) - 1), prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a, b in zip([0, *ends], ends)]
                names = [k[a:b].astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a, b in zip([0, *ends], ends)]
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(steps, pa.binary()), pa.array(names, pa.binary())], names=["part", "steps", "names"])

    def plain(raw: bytes) -> np.ndarray:
        return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()

    def count(batches):
        at, grams, keys = None, [], []

        def lists():
            v, k = np.concatenate(grams), np.concatenate(keys)
            order = np.argsort(v)
            v, k = v[order], k[order]
            first = np.flatnonzero(np.diff(v, prepend=-1))
            size = np.diff(np.append(first, len(v)))
            many = size > short
            place = ((at << low) + v[first[many]]) >> (40 - _CROWDED)
            return pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(np.minimum.reduceat(k, first)[many], pa.int32()), pa.array(np.maximum.reduceat(k, first)[many], pa.int32())], names=["at", "least", "most"])

        for batch in batches:
            for part, steps, names in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if part != at:
                    if grams:
                        yield lists()
                    at, grams, keys = part, [], []
                grams.append(np.cumsum(plain(steps).astype(np.int64)))
                keys.append(plain(names))
        if grams:
            yield lists()

    found = texts.mapInArrow(look, "part int, steps binary, names binary").repartition("part").sortWithinPartitions("part").mapInArrow(count, "at long, least int, most int")
    found = write_table(found, "lists")
    copies = found.groupBy("least", "most").agg(F.count("*").alias("lists")).filter(F.col("lists") >= _ALIKE).select("least", "most")
    out = bitmap(found.join(copies, ["least", "most"], "left_anti").select("at"), _CROWDED)
    drop_table(found)
    return out


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, num: int = 4, den: int = 5, bits: int = 22, most: int = 6, short: int = 16, hot_gram: int = 1 << 12, block_rows: int = 128, block_most: int = 1024, block_grams: int = 1 << 19) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, rid, label) for each row: sets link when den * shared >= num * union.

    rid is identity(doc_id, text). n_links counts the other rows that the row links with, copies included. label is the
    same for all rows of a component, also where ids are null or repeated, and null for rows without n-grams. The stored
    tables that the result is read from are in its attribute `scratch`, for drop_table() once it has been used.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), identity(doc_id, text).alias("rid"))
    surveyed = survey(rows, n, bits, docs.schema[doc_id].dataType.simpleString())
    members = surveyed.filter("chunk is null").select("doc_id", "rid", "n", "cls")
    classes = members.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"), F.count("*").alias("size"), F.min("rid").alias("rid"), F.first("n").alias("n"))
    # a class has its number once written; by their keys, which two may share, classes are only brought together
    classes = write_table(classes.withColumns({"node": F.monotonically_increasing_id(), "key": F.conv(F.substring("cls", 1, 15), 16, 10).cast("long")}), "classes")

    freq = frequencies(surveyed, bits)
    load = float(freq.sum()) / (1 << bits)
    sent = spark.sparkContext.broadcast(freq)

    def pool(s: np.ndarray) -> np.ndarray:
        kept, _ = prefix(s, sent.value, bits, num, den, most, load, spare=0.25)
        return kept[sent.value[(kept >> np.uint64(64 - bits)).astype(np.int64)] > 1]

    late = spark.sparkContext.broadcast(crowded(rows.select("text"), n, pool, short))

    def head_of(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The prefix of a set, without what no other has, its n-grams' counts, and its L."""
        kept, level = prefix(s, sent.value, bits, num, den, most, load, late=is_set(late.value, (s >> np.uint64(64 - _CROWDED)).astype(np.int64)))
        held = sent.value[(kept >> np.uint64(64 - bits)).astype(np.int64)]
        return kept[held > 1], held[held > 1].astype(np.int64), level

    seen: set[int] = set()  # by each task

    def index(b: dict) -> dict:
        """Postings of each class, once a task: copies in other tasks repeat them, and are dropped along the lists."""
        import xxhash

        out: dict[str, list] = {"gram": [np.zeros(0, np.int64)], "salt": [np.zeros(0, np.int64)], "cls": [np.zeros(0, np.int64)], "n": [np.zeros(0, np.int32)], "matches": [np.zeros(0, np.int16)]}
        for t in b["text"]:
            s = ngram_set(t, n)
            node = int(xxhash.xxh3_128_hexdigest(s.tobytes())[:15], 16)
            if not len(s) or node in seen:
                continue
            if len(seen) > _SEEN:
                seen.clear()
            seen.add(node)
            kept, held, level = head_of(s)
            out["gram"].append(kept.view(np.int64))
            out["salt"].append(np.where(held > hot_gram + 4 * load, (node * 0x9E3779B1 & 0x7FFFFFFF) % (1 + held // (hot_gram // 2)), -1))
            out["cls"].append(np.full(len(kept), node, np.int64))
            out["n"].append(np.full(len(kept), len(s), np.int32))
            out["matches"].append(np.full(len(kept), level, np.int16))
        return {k: np.concatenate(v) for k, v in out.items()}

    postings = map_batches(rows.select("text"), index, "gram long, salt long, cls long, n int, matches short")

    def candidates(batches):
        """Along each list in order of size: all pairs of a short one (with L), or stars (with 0) along a long one,
        whose pairs are held to L when they are verified.

        A list dealt to several tasks becomes a star around a node that stands for the n-gram, whatever the sizes.
        Classes have keys from 0, such nodes negative ones.
        """
        a: list[int] = []
        b: list[int] = []
        m: list[int] = []
        run: list[tuple[int, int, int]] = []
        at, center, size, long = None, 0, 0, False

        def close():
            if not long:
                for i, (ci, ni, mi) in enumerate(run):
                    for cj, nj, mj in run[:i]:
                        if den * nj >= num * ni:
                            a.append(min(ci, cj))
                            b.append(max(ci, cj))
                            m.append(min(mi, mj))
                run.clear()

        def star(c: int, k: int):
            nonlocal center, size
            if den * size >= num * k and size:
                a.append(center)
                b.append(c)
                m.append(0)
            else:
                center = c
            size = k

        for batch in batches:
            gram, salt, cls, sizes, matches = (batch.column(i).to_numpy() for i in range(5))
            same = np.zeros(len(gram), bool)
            same[1:] = (gram[1:] == gram[:-1]) & (cls[1:] == cls[:-1])
            near = salt >= 0
            near[1:] |= gram[1:] == gram[:-1]
            near[:-1] |= gram[1:] == gram[:-1]
            near[:1] = near[-1:] = True
            pick = np.nonzero(near & ~same)[0]
            for g, d, c, k, x in zip(gram[pick].tolist(), salt[pick].tolist(), cls[pick].tolist(), sizes[pick].tolist(), matches[pick].tolist()):
                if (g, d) != at:
                    close()
                    at, long, size = (g, d), False, 0
                if d >= 0:
                    a.append(g | -(1 << 63) if g >= 0 else g)
                    b.append(c)
                    m.append(0)
                    continue
                if run and run[-1][0] == c:
                    continue
                if long:
                    star(c, k)
                    continue
                run.append((c, k, x))
                if len(run) > short:
                    long = True
                    for ci, ki, _ in run:
                        star(ci, ki)
                    run.clear()
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(m, pa.int16())], names=["a", "b", "m"])
                a.clear(), b.clear(), m.clear()
        close()
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(m, pa.int16())], names=["a", "b", "m"])

    found = postings.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "n", "cls").mapInArrow(candidates, "a long, b long, m short")
    edges = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "m").groupBy("a", "b").agg(F.count("*").alias("shared"), F.min("m").alias("m")).filter("shared >= m").select("a", "b")
    groups = components(edges)

    info = groups.withColumnRenamed("node", "key").join(classes.select("key", "node", "n", "rid", "size"), "key")
    sizes = info.groupBy("label").agg(F.count("*").alias("rows"), F.sum("n").alias("grams"))
    sizes = write_table(sizes.select("label", F.greatest(F.ceil(F.col("rows") / F.least(F.lit(block_most), F.greatest(F.lit(block_rows), F.col("rows") / 12))), F.ceil(F.col("grams") / block_grams)).cast("int").alias("blocks")), "blocks")
    placed = write_table(info.join(sizes, "label").select("rid", "node", "label", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "size"), "placed")

    # only texts of classes that others were found for are moved
    may = sieve(placed.select("rid"))
    wanted = sifted(rows.select("rid", "text"), "rid", may).join(placed, "rid").select("text", "node", "label", "blocks", "block", "size")
    wanted = write_table(wanted, "sets")
    dealt = wanted.select("label", F.explode(F.expr("transform(sequence(0, blocks - 1), x -> struct(least(x, block) as i, greatest(x, block) as j))")).alias("p"), "block", "node", "size", "text")
    dealt = dealt.select("label", "p.i", "p.j", "block", "node", "size", "text").repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "label", "i", "j").sortWithinPartitions("label", "i", "j", "node")

    def verify(batches):
        held: list[tuple] = []
        at = None
        for batch in batches:
            for *row, t in zip(*(values(batch.column(i)) for i in range(7))):
                row = tuple(row)
                if row[:3] != at:
                    if len(held) > 1:
                        yield from _verified(held, num, den)
                    at, held = row[:3], []
                if not held or held[-1][4] != row[4]:  # equal rows count once
                    s = ngram_set(t, n)
                    head, _, level = head_of(s)
                    held.append((*row, level, head.tobytes(), s.tobytes()))
        if len(held) > 1:
            yield from _verified(held, num, den)

    forest = write_table(dealt.mapInArrow(verify, "a long, b long, links long"), "forest")
    sent.destroy()
    late.destroy()
    del freq
    trim()
    final = components(forest.select("a", "b"))
    for t in (groups, sizes, placed, wanted):
        drop_table(t)
    ends = classes.join(final.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("cls", "node", "least", "size", F.coalesce("label", "node").alias("label"))
    least = ends.groupBy("label").agg(F.min("least").alias("component_id"))
    links = forest.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    result = ends.join(least, "label").join(links, "node", "left").select("cls", "label", "component_id", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"))
    result = write_table(result, "linked")
    for t in (final, forest, classes):
        drop_table(t)
    out = members.join(result, "cls", "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "rid", "label")
    out.scratch = [surveyed, result]
    return out


def _together(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two of the sets share."""
    n = np.array([len(s) for s in sets])
    doc = np.repeat(np.arange(len(sets)), n)
    gram = np.concatenate(sets)
    order = np.argsort(gram, kind="stable")
    gram, doc = gram[order], doc[order]
    new = np.ones(len(gram), bool)
    new[1:] = gram[1:] != gram[:-1]
    which = np.cumsum(new) - 1
    often = np.bincount(which, minlength=1)
    keep = often[which] > 1
    which, doc = which[keep], doc[keep]
    which = np.searchsorted(np.unique(which), which)
    shared = np.zeros((len(sets), len(sets)), np.float32)
    step = max(256, (1 << 22) // len(sets))  # columns at a time: 16 MB
    for lo in range(0, int(which[-1]) + 1 if len(which) else 0, step):
        a, b = np.searchsorted(which, (lo, lo + step))
        part = np.zeros((len(sets), step), np.float32)
        part[doc[a:b], which[a:b] - lo] = 1
        shared += part @ part.T
    return shared.astype(np.int64)


def _verified(rows: list[tuple], num: int, den: int):
    """Exact links between two blocks (or within one): for each class a smaller linked root and its number of links.

    Pairs that share as many prefix n-grams as the smaller L of the two, and whose sizes allow a link, are verified.
    """
    block, node, size, level = (np.array([r[k] for r in rows]) for k in (3, 4, 5, 6))
    n = np.array([len(r[8]) // 8 for r in rows])
    may = _together([np.frombuffer(r[7], np.uint64) for r in rows]) >= np.minimum(level[:, None], level[None, :])
    may &= den * np.minimum(n[:, None], n[None, :]) >= num * np.maximum(n[:, None], n[None, :])
    np.fill_diagonal(may, False)
    if rows[0][1] != rows[0][2]:
        may &= block[:, None] != block[None, :]
    some = np.flatnonzero(may.any(1))
    if not len(some):
        return
    block, node, size, n, may = block[some], node[some], size[some], n[some], may[np.ix_(some, some)]
    sets = [np.frombuffer(rows[i][8], np.uint64) for i in some]
    if may.sum() > 8 * len(some):
        both = _together(sets)
    else:  # few pairs: one by one
        both = np.zeros((len(some), len(some)), np.int64)
        for i, j in zip(*np.nonzero(np.triu(may))):
            both[i, j] = both[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
    linked = may & (den * both >= num * (n[:, None] + n[None, :] - both))
    links = linked.astype(np.int64) @ size
    root = np.arange(len(some))
    linked |= np.eye(len(some), dtype=bool)
    while True:
        low = np.where(linked, root[None, :], len(some)).min(1)
        low = low[low]
        if (low == root).all():
            break
        root = low
    have = np.nonzero(links)[0]
    if len(have):
        yield pa.RecordBatch.from_arrays([pa.array(node[have]), pa.array(node[root[have]]), pa.array(links[have])], names=["a", "b", "links"])
