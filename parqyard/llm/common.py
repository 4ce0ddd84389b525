"""Helpers shared by the corpus operators: scratch tables, Arrow maps, keyed hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Odd multipliers of the splitmix64 finaliser (fixed values).
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
#: Bytes of a text that are hashed at once.
STRETCH = 1 << 20
_BASE = 0x9E3779B97F4A7C15
#: Odd multipliers that combine word hashes to shingle hashes (fixed values).
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of the cluster, from spark.checkpoint.dir; where that is unset, a local one if Spark is local,
    else an error, as each executor would write to a disk of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file:/tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def write_table(df: DataFrame, label: str) -> DataFrame:
    """Writes df to a new folder in the shared scratch space and reads it back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_table(df: DataFrame) -> None:
    """Deletes a table that write_table made, once nothing reads it any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def small_batches(spark: SparkSession) -> None:
    """Whole texts reach Python in batches of 2000 rows, to bound a worker's memory, unless the session says otherwise."""
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "2000")


def identity(*columns: str | Column) -> Column:
    """128 bits of a hash of the columns as 32 hex digits: two 64-bit ones that begin differently.

    A null, which the hash passes over, counts by its place.
    """
    nulls = F.concat(*[F.when((F.col(c) if isinstance(c, str) else c).isNull(), "1").otherwise("0") for c in columns])
    return F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), nulls, *columns)), 16, "0") for seed in ("first", "second")])


_PIECE = 17  # a bitmap travels in pieces of 2**17 bits


def bitmap(places: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, eight in a byte, with those set whose numbers the long column of places has: as large whatever the data.

    One job fetches all pieces, each at most twice: a job for each partition in turn takes as long as there are partitions.
    """

    def pack(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            at = batch.column(0).to_numpy()
            for piece in np.unique(at >> _PIECE).tolist():
                flags = held.setdefault(piece, np.zeros(1 << _PIECE, bool))
                flags[at[at >> _PIECE == piece] & ((1 << _PIECE) - 1)] = True
            for piece in [k for k in held if len(held) > 64]:  # bounds what is held; the driver joins pieces
                yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "flags": [np.packbits(held.pop(piece)).tobytes()]})
        for piece, flags in held.items():
            yield pa.RecordBatch.from_pydict({"piece": pa.array([piece], pa.int32()), "flags": [np.packbits(flags).tobytes()]})

    at = places.columns[0]
    dealt = places.repartition(F.shiftright(at, _PIECE)).sortWithinPartitions(at)
    out = np.zeros(1 << (bits - 3), np.uint8)
    for r in dealt.mapInArrow(pack, "piece int, flags binary").collect():
        lo = r["piece"] << (_PIECE - 3)
        out[lo : lo + (1 << (_PIECE - 3))] |= np.frombuffer(r["flags"], np.uint8)
    return out


def is_set(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the numbered bits of a bitmap are set."""
    return (flags[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def sieve(keys: DataFrame, bits: int = 25) -> Callable[[np.ndarray], np.ndarray]:
    """Says of xxhash64() of keys which may be in the only column of keys: all that are, and few others. It is of fixed
    size: with far more keys than 2**bits / 10 it lets more through, and loses nothing."""
    h = F.xxhash64(keys.columns[0])
    mask = (1 << bits) - 1
    both = F.explode(F.array(F.shiftrightunsigned(h, 64 - bits), h.bitwiseAND(mask))).alias("at")
    sent = keys.sparkSession.sparkContext.broadcast(bitmap(keys.select(both), bits))

    def passes(h: np.ndarray) -> np.ndarray:
        return is_set(sent.value, h >> (64 - bits) & mask) & is_set(sent.value, h & mask)

    return passes


def sifted(df: DataFrame, key: str, passes: Callable[[np.ndarray], np.ndarray], keep: bool = True) -> DataFrame:
    """The rows of df whose key passes a sieve, or the others, so that a join need not move them all."""

    def run(batches):
        for batch in batches:
            ok = passes(batch.column(batch.num_columns - 1).to_numpy())
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(ok if keep else ~ok))

    small_batches(df.sparkSession)
    return df.select("*", F.xxhash64(key).alias("sieve_hash")).mapInArrow(run, df.schema)


def rest(df: DataFrame, *names: str) -> list[str]:
    """The columns of df but those named as one of names, in whatever case, as Spark compares them."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def values(column: pa.Array) -> list:
    """A column as a Python list; in strings, invalid UTF-8 becomes U+FFFD."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            raw = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
            return [None if x is None else x.decode("utf-8", "replace") for x in raw.to_pylist()]
        raise


def map_batches(df: DataFrame, fn: Callable[[dict], dict | None], schema: str, owner: str = "texts") -> DataFrame:
    """mapInArrow with columns as Python lists on the way in, and lists, NumPy or Arrow arrays on the way out.

    Input batches are cut to pieces of about 4 MB, so that Python's copies of very long texts stay few.
    """
    small_batches(df.sparkSession)
    names = df.columns
    arrow = pa.schema([(f.name, _arrow(f.dataType)) for f in df.sparkSession.createDataFrame([], schema).schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(owner)
        for batch in batches:
            pa.default_memory_pool().release_unused()
            step = max(1, min(batch.num_rows, int(batch.num_rows * 4e6 / max(1, batch.nbytes))))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                out = fn({n: values(part.column(i)) for i, n in enumerate(names)})
                if out:
                    columns = [out[f.name] if isinstance(out[f.name], pa.Array) else pa.array(out[f.name], f.type, from_pandas=False) for f in arrow]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return df.mapInArrow(run, schema)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(MIX[0])
    x ^= x >> np.uint64(27)
    x *= np.uint64(MIX[1])
    x ^= x >> np.uint64(31)
    return x


_OWNERS: dict[str, Callable[[], None]] = {}
_owner = ""


def claim(owner: str, forget: Callable[[], None] | None = None) -> None:
    """Says who uses a Python worker from now on; what any other operator has cached in it is forgotten."""
    global _owner
    if forget:
        _OWNERS[owner] = forget
    if _owner != owner:
        for name, clear in _OWNERS.items():
            if name != owner:
                clear()
        _owner = owner
        trim()


def trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def ascii_words(text: str | None) -> list[bytes]:
    """Maximal runs of other characters than space and U+0009 to U+000D: what bytes.split() cuts at."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            m = max(n, 4096)
            base, back = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
            self.up = np.concatenate(([np.uint64(1)], np.cumprod(np.full(m, base))))
            self.down = np.concatenate(([np.uint64(1)], np.cumprod(np.full(m, back))))
        return self.up[:n], self.down[:n]


POWERS = _Powers()


def _is_space(b: np.ndarray) -> np.ndarray:
    return (b == 32) | ((b >= 9) & (b <= 13))


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each of ascii_words(text), with A-Z lower-cased if asked, in order.

    Words are hashed all at once, as polynomials of their bytes from running sums; words of 64 bytes or more, for which
    polynomials modulo 2**64 can be made to collide, one by one by xxh3.
    """
    if not text:
        return np.zeros(0, np.uint64)
    raw = text.encode("utf-8", "surrogatepass")
    raw = raw.lower() if lower else raw
    if len(raw) <= STRETCH:
        return _stretch(raw)
    out, at = [], 0
    while at < len(raw):  # cut between words
        end = min(at + STRETCH, len(raw))
        while end < len(raw) and raw[end] not in b" \t\n\v\f\r":
            end += 1
        out.append(_stretch(raw[at:end]))
        at = end
    return np.concatenate(out)


def _stretch(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    outside = np.ones(len(b) + 2, bool)
    outside[1:-1] = _is_space(b)
    edges = np.flatnonzero(outside[1:] != outside[:-1])
    first, last = edges[::2], edges[1::2]
    up, down = POWERS.of(len(b) + 1)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b + np.uint64(1)) * up[: len(b)], out=total[1:])
    size = last - first
    out = mix((total[last] - total[first]) * down[first] + size.astype(np.uint64) * _ODD[1])
    for i in np.flatnonzero(size >= 64):
        out[i] = xxhash.xxh3_64_intdigest(raw[first[i] : last[i]])
    return out


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k word hashes, or one of the whole when there are fewer; none without words."""
    n = len(h)
    if not n:
        return h
    k = min(k, n)
    out = np.full(n - k + 1, np.uint64(k))
    for i in range(k):
        out = mix(out * _ODD[0] + h[i : n - k + 1 + i] * _ODD[1])
    return out
