"""Order MinHash: fingerprints of texts whose likeness falls with their edit distance.

A text is a sequence of tokens (runs of other characters than white space, cut at 16; letters of scripts without spaces
one by one), its k-mers are runs of `k` of
them, numbered by occurrence, so that the second "a b c" of a text differs from the first. One hash of (k-mer,
occurrence) deals them to `sketches` bins; in each bin the two least ones are selected, put in text order and hashed
as a tuple. A fingerprint is the list of these tuples' hashes; likeness is the share of bins that agree among those
that either fingerprint fills. Everything is Spark SQL inside one row; nothing is exploded or shuffled.

With `dense`, a bin of fewer than two k-mers takes those that follow it in the order of hashes, from the last bin on to
the first. So each sketch has the first two k-mers from its bin's start on, whatever the length of the text, and short
texts keep the order of their k-mers too. A bin of two or more gives the same either way.

Edge cases: null counts as empty. Texts without tokens have empty bins only: likeness 1 to another such text, 0 to any
other. Texts of fewer than k tokens have one k-mer, the whole. A bin with one k-mer hashes that alone,
unless `dense` finds it a second one. Very long texts
work whole, up to 2**24 k-mers in order; beyond, positions wrap around.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of scripts that put no spaces between words (Thai to Khmer, kana, Han, Hangul), each a token of its own.
_ALONE = r"\x{0E00}-\x{0EFF}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{AC00}-\x{D7AF}\x{20000}-\x{3FFFF}"
_TOKEN = rf"[{_ALONE}]|[^\x20\x09-\x0D{_ALONE}]{{1,16}}"
_LOW = (1 << 24) - 1  # positions; the 40 bits above hold a hash, with the sign bit clear after one shift


def _packed(x: Column, at: Column) -> Column:
    """39 bits of a hash above 24 bits of a position: a positive long that sorts by the hash."""
    return x.bitwiseAND(F.lit((1 << 63) - 1 - _LOW)).bitwiseOR(at)


def _hash(p: Column) -> Column:
    return F.shiftright(p, 24)


def fingerprint(df: DataFrame, texts: dict[str, str], k: int = 3, sketches: int = 64, dense: bool = False) -> DataFrame:
    """df plus, for each column of texts, an array<int> fingerprint under the name that texts gives it."""
    bits = sketches.bit_length() - 1
    if 1 << bits != sketches:
        raise ValueError("sketches must be a power of two")
    for source, out in texts.items():
        t, s, m, two = (f"_{x}_{out}" for x in "tsm2")
        df = df.withColumn(t, F.regexp_extract_all(F.coalesce(F.col(source), F.lit("")), F.lit(_TOKEN), F.lit(0)))
        token = F.col(t)

        def kmer(i: Column) -> Column:
            return F.xxhash64(*[F.get(F.col(t), i + j) for j in range(k)])  # noqa: B023

        last = F.greatest(F.size(token) - k, F.lit(0))
        every = F.when(F.size(token) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        df = df.withColumn(s, F.sort_array(F.transform(every, lambda i: _packed(kmer(i), i))))
        # sorted by k-mer, then position: the occurrence is the distance to the first equal one, found by halving steps
        sorted_ = F.col(s)

        def occurrence(x: Column, p: Column) -> Column:
            def step(off: Column, width: Column) -> Column:
                far = p - off - width
                return F.when((far >= 0) & (_hash(F.get(F.col(s), far)) == _hash(x)), off + width).otherwise(off)  # noqa: B023

            halving = F.array(*[F.lit(1 << b) for b in range(23, -1, -1)])
            return F.aggregate(halving, F.lit(0), step)

        def numbered(x: Column, p: Column) -> Column:
            """A first occurrence keeps its hash, so that the array stays nearly sorted."""
            again = (p > 0) & (_hash(F.get(F.col(s), p - 1)) == _hash(x))  # noqa: B023
            return F.when(again, _packed(F.xxhash64(_hash(x), occurrence(x, p)), x.bitwiseAND(F.lit(_LOW)))).otherwise(x)

        def bin_of(x: Column) -> Column:
            return F.shiftright(x, 63 - bits)

        def place(x: Column) -> Column:
            return x.bitwiseAND(F.lit(_LOW))

        df = df.withColumn(m, F.sort_array(F.transform(sorted_, numbered)))
        df = df.withColumn(two, F.filter(F.col(m), lambda x, p: (p < 2) | (bin_of(F.get(F.col(m), p - 2)) != bin_of(x))))  # noqa: B023

        if dense:

            def from_here(x: Column, p: Column) -> Column:
                """The tuple of x and what follows it, once for each bin that starts after the k-mer before x."""
                y = F.coalesce(F.get(F.col(two), p + 1), F.get(F.col(two), F.lit(0)))  # noqa: B023
                alone = F.size(F.col(two)) == 1  # noqa: B023
                swapped = ~alone & (place(y) < place(x))
                h = F.xxhash64(F.when(swapped, _hash(y)).otherwise(_hash(x)), F.when(alone, F.lit(-1).cast("long")).when(swapped, _hash(x)).otherwise(_hash(y)))
                starts = bin_of(x) - F.when(p > 0, bin_of(F.get(F.col(two), p - 1))).otherwise(F.lit(-1))  # noqa: B023
                return F.array_repeat(F.shiftrightunsigned(h, 40).cast("int"), starts.cast("int"))

            df = df.withColumn(f"_b_{out}", F.flatten(F.transform(F.col(two), from_here)))
            filled = F.col(f"_b_{out}")
            rest = F.array_repeat(F.get(filled, F.lit(0)), F.lit(sketches) - F.size(filled))  # null if there are no k-mers
            df = df.withColumn(out, F.concat(filled, rest)).drop(t, s, m, two, f"_b_{out}")
            continue

        def tuple_hash(x: Column, p: Column) -> Column:
            """Of the two in x's bin, if x is the first of them, in text order."""
            y = F.get(F.col(two), p + 1)  # noqa: B023
            pair = y.isNotNull() & (bin_of(y) == bin_of(x))
            swapped = pair & (place(y) < place(x))
            a = F.when(swapped, _hash(y)).otherwise(_hash(x))
            b = F.when(swapped, _hash(x)).when(pair, _hash(y))
            first = (p == 0) | (bin_of(F.get(F.col(two), p - 1)) != bin_of(x))  # noqa: B023
            return F.struct(bin_of(x).cast("int").alias("bin"), F.xxhash64(a, F.coalesce(b, F.lit(-1))).alias("h"), first.alias("first"))

        tuples = F.filter(F.transform(F.col(two), tuple_hash), lambda x: x["first"])
        by_bin = F.map_from_entries(F.transform(tuples, lambda x: F.struct(x["bin"], F.shiftrightunsigned(x["h"], 40).cast("int"))))
        df = df.withColumn(f"_b_{out}", by_bin)
        # two references to the map, or the optimizer would build it anew for every bin
        df = df.withColumn(out, F.transform(F.sequence(F.lit(0), F.lit(sketches - 1)), lambda i: F.when(F.size(F.col(f"_b_{out}")) > 0, F.element_at(F.col(f"_b_{out}"), i))))  # noqa: B023
        df = df.drop(t, s, m, two, f"_b_{out}")
    return df


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins among the bins that either fills; 1 for two empty fingerprints."""
    both = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), None).otherwise(F.coalesce(x == y, F.lit(False))))
    filled = F.filter(both, lambda x: x.isNotNull())
    return F.when(F.size(filled) == 0, F.lit(1.0)).otherwise(F.size(F.filter(filled, lambda x: x)) / F.size(filled))


def as_text(fp: Column) -> Column:
    """Six hex digits for each bin, dots for an empty one."""
    return F.array_join(F.transform(fp, lambda x: F.coalesce(F.lpad(F.lower(F.hex(x.cast("long"))), 6, "0"), F.lit("......"))), "")
