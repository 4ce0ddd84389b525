"""Typed access to columns and assembly of lists, maps and structs, as Spark expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types as P
from ..schema import string_keys

#: What each physical kind may be decoded as.
DECODED = {P.INT32: T.IntegerType(), P.INT64: T.LongType(), P.FLOAT: T.FloatType(), P.DOUBLE: T.DoubleType(), P.BYTE_ARRAY: T.BinaryType(), P.BOOLEAN: T.BooleanType(), "STRING": T.StringType()}


def typed(df: DataFrame, name: str, kind: type[T.DataType] | str, keep: Sequence[str] = ()) -> DataFrame:
    """The column `name` behind those of `keep`, if it has exactly that type (TypeError otherwise); nothing is converted."""
    want = DECODED[kind] if isinstance(kind, str) else kind()
    if name not in df.columns:
        raise KeyError(f"no column {name!r}")
    have = df.schema[name].dataType
    if have != want:
        raise TypeError(f"{name} is {have.simpleString()}, not {want.simpleString()}")
    return _beside(df, keep, F.col(f"`{name}`").alias(name))


def _beside(df: DataFrame, keep: Sequence[str], column: Column) -> DataFrame:
    return df.select(*[F.col(f"`{k}`") for k in keep], column)


def decode_int32(df: DataFrame, name: str, keep: Sequence[str] = ()) -> DataFrame:
    return typed(df, name, P.INT32, keep)


def decode_int64(df: DataFrame, name: str, keep: Sequence[str] = ()) -> DataFrame:
    return typed(df, name, P.INT64, keep)


def decode_float(df: DataFrame, name: str, keep: Sequence[str] = ()) -> DataFrame:
    return typed(df, name, P.FLOAT, keep)


def decode_double(df: DataFrame, name: str, keep: Sequence[str] = ()) -> DataFrame:
    return typed(df, name, P.DOUBLE, keep)


def decode_boolean(df: DataFrame, name: str, keep: Sequence[str] = ()) -> DataFrame:
    return typed(df, name, P.BOOLEAN, keep)


def decode_bytes(df: DataFrame, name: str, keep: Sequence[str] = ()) -> DataFrame:
    """The raw bytes of a byte-array column, which the physical view shows as a string."""
    if name in df.columns and isinstance(df.schema[name].dataType, T.StringType):
        return _beside(df, keep, F.col(f"`{name}`").cast("binary").alias(name))
    return typed(df, name, P.BYTE_ARRAY, keep)


def decode_string(df: DataFrame, name: str, keep: Sequence[str] = ()) -> DataFrame:
    """UTF-8 text; bytes that are none become the replacement character."""
    if name in df.columns and isinstance(df.schema[name].dataType, T.BinaryType):
        return _beside(df, keep, utf8(F.col(f"`{name}`")).alias(name))
    return typed(df, name, "STRING", keep)


def utf8(c: Column) -> Column:
    return F.make_valid_utf8(c.cast("string"))


def decode_list(df: DataFrame, name: str, element: Callable[[Column], Column] = lambda x: x, keep: Sequence[str] = ()) -> DataFrame:
    """A list column with `element` applied to each: null lists, empty ones and null elements stay apart."""
    if name not in df.columns or not isinstance(df.schema[name].dataType, T.ArrayType):
        raise TypeError(f"{name} is no list")
    return _beside(df, keep, F.transform(F.col(f"`{name}`"), element).alias(name))


def decode_map(df: DataFrame, name: str, key: Callable[[Column], Column] = lambda x: x, value: Callable[[Column], Column] = lambda x: x, keep: Sequence[str] = ()) -> DataFrame:
    """A map column with `key` and `value` applied to each entry; of keys that become equal the last counts."""
    if name not in df.columns or not isinstance(df.schema[name].dataType, T.MapType):
        raise TypeError(f"{name} is no map")
    entries = F.map_entries(F.col(f"`{name}`"))
    changed = F.transform(entries, lambda e: F.struct(key(e["key"]).alias("key"), value(e["value"]).alias("value")))
    return _beside(df, keep, F.map_from_entries(_last_of_key(changed)).alias(name))


def _last_of_key(entries: Column) -> Column:
    """Entries of which the last of each key is left, at the place of the first; the same entries if no keys are equal."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1))
    return F.when(F.size(keys) < F.size(entries), last).otherwise(entries)


def map_of(keys: Column, values: Column) -> Column:
    """A map from a list of keys and a list of as many values; null if either is. Keys become strings, the last wins."""
    entries = F.zip_with(keys.cast("array<string>"), values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    checked = F.when(keys.isNull() | values.isNull() | (F.size(keys) == F.size(values)), entries).otherwise(F.raise_error(F.lit("as many values as keys are needed")))
    return F.map_from_entries(_last_of_key(checked))


def struct_of(columns: Sequence[Column | str], names: Sequence[str]) -> Column:
    """A struct with the given columns under the given names."""
    if len(columns) != len(names):
        raise ValueError("as many names as columns are needed")
    return F.struct(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for c, n in zip(columns, names)])


def leaves(df: DataFrame) -> DataFrame:
    """Structs as dotted columns, however deep; lists and maps whole."""
    out = []

    def walk(c: Column, t: T.DataType, label: str) -> None:
        if isinstance(t, T.StructType):
            for f in t.fields:
                walk(c.getField(f.name), f.dataType, f"{label}.{f.name}")
        else:
            out.append(c.alias(label))

    for f in df.schema.fields:
        walk(F.col(f"`{f.name}`"), f.dataType, f.name)
    return df.select(*out)


__all__ = ["DECODED", "decode_boolean", "decode_bytes", "decode_double", "decode_float", "decode_int32", "decode_int64", "decode_list", "decode_map", "decode_string", "leaves", "map_of", "string_keys", "struct_of", "typed", "utf8"]
