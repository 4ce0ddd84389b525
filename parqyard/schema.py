"""Schemas: the leaves of a file, the physical read schema, logical columns, and lookups in both."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import types as P


@dataclass(frozen=True)
class Leaf:
    """A physical column: where it is, what it holds, and how deep it is optional and repeated."""

    path: tuple[str, ...]
    kind: str
    max_def: int = 0
    max_rep: int = 0
    length: int = 0
    unsigned: bool = False

    @property
    def name(self) -> str:
        return ".".join(self.path)

    @property
    def repetition(self) -> str:
        return "REPEATED" if self.max_rep else "OPTIONAL" if self.max_def else "REQUIRED"

    def __str__(self) -> str:
        return f"{self.repetition.lower()} {self.kind.lower()} {self.name} (maxDef={self.max_def}, maxRep={self.max_rep})"


@dataclass(frozen=True)
class Logical:
    """A column as users see it, and its values' Spark type in the physical view."""

    name: str
    category: str
    data_type: T.DataType
    kind: str | None = None  # of a PRIMITIVE
    leaves: tuple[int, ...] = ()

    @property
    def key_kind(self) -> str | None:
        return P.kind_of(self.data_type.keyType) if isinstance(self.data_type, T.MapType) else None

    @property
    def value_kind(self) -> str | None:
        if isinstance(self.data_type, T.MapType):
            return P.kind_of(self.data_type.valueType)
        return P.kind_of(self.data_type.elementType) if isinstance(self.data_type, T.ArrayType) else None

    def column(self) -> Column:
        return F.col(f"`{self.name.replace('`', '``')}`")

    def __str__(self) -> str:
        if self.category == P.MAP:
            return f"{self.name}: MAP<{self.key_kind}, {self.value_kind}>"
        return f"{self.name}: {self.kind if self.category == P.PRIMITIVE else self.category}"


@dataclass(frozen=True)
class Schema:
    """The physical leaves and logical columns of a table, with lookups by place and by name."""

    name: str
    leaves: tuple[Leaf, ...]
    columns: tuple[Logical, ...]
    by_name: dict[str, int] = field(default_factory=dict, compare=False)

    def __post_init__(self):
        self.by_name.update({c.name: i for i, c in enumerate(self.columns)})  # the last of equal names

    def leaf(self, at: int) -> Leaf:
        return self.leaves[at] if at >= 0 else _out_of_range(at)

    def column(self, at: int | str) -> Logical | None:
        """By place (IndexError outside) or by exact name (None if there is none)."""
        if isinstance(at, int):
            return self.columns[at] if at >= 0 else _out_of_range(at)
        i = self.by_name.get(at)
        return None if i is None else self.columns[i]

    def column_of_leaf(self, at: int) -> Logical | None:
        return next((c for c in self.columns if at in c.leaves), None)

    def with_prefix(self, *path: str) -> list[int]:
        """Places of the leaves whose path starts with the given names."""
        return [i for i, x in enumerate(self.leaves) if x.path[: len(path)] == path]


def _out_of_range(at: int):
    raise IndexError(f"no column {at}")


def from_leaves(name: str, leaves: list[Leaf]) -> Schema:
    """One primitive logical column for each leaf."""
    return Schema(name, tuple(leaves), tuple(Logical(x.name, P.PRIMITIVE, P.SPARK.get(x.kind, T.StringType()), x.kind, (i,)) for i, x in enumerate(leaves)))


def map_column(name: str, key: str = P.BYTE_ARRAY, value: str = P.BYTE_ARRAY, optional: bool = True, optional_value: bool = True) -> tuple[T.StructField, list[Leaf]]:
    """A map column for a schema to be written, and the two leaves it has in a file."""
    base = 1 if optional else 0
    leaves = [Leaf((name, "key_value", "key"), key, base + 1, 1), Leaf((name, "key_value", "value"), value, base + 1 + optional_value, 1)]
    return T.StructField(name, T.MapType(P.SPARK[key], P.SPARK[value], optional_value), optional), leaves


def string_map_column(name: str) -> tuple[T.StructField, list[Leaf]]:
    return map_column(name)


def physical(inferred: T.StructType, leaves: list[Leaf], name: str = "schema") -> tuple[T.StructType, list[Column], Schema]:
    """The schema to read with, the projection to the physical view, and the view's columns.

    Spark's inferred schema and the file's leaves are walked side by side, in the same order. Structs become dotted
    leaves; lists and maps stay whole, with string keys; INT96 and fixed-length values are null, as they have no value
    in this view.
    """
    rest = list(enumerate(leaves))

    def read_type(t: T.DataType) -> tuple[T.DataType, list[Leaf]]:
        if isinstance(t, T.StructType):
            parts = [(f, *read_type(f.dataType)) for f in t.fields]
            return T.StructType([T.StructField(f.name, x, f.nullable) for f, x, _ in parts]), [y for _, _, ys in parts for y in ys]
        if isinstance(t, T.ArrayType):
            x, ys = read_type(t.elementType)
            return T.ArrayType(x, t.containsNull), ys
        if isinstance(t, T.MapType):
            k, ks = read_type(t.keyType)
            v, vs = read_type(t.valueType)
            return T.MapType(k, v, t.valueContainsNull), ks + vs
        leaf = rest.pop(0)[1] if rest else Leaf((), P.BYTE_ARRAY)
        if leaf.unsigned or leaf.kind in (P.INT96, P.FIXED):
            return t, [leaf]
        return P.SPARK[leaf.kind], [leaf]

    fields, columns, logical = [], [], []

    def add(f: T.StructField, t: T.DataType, own: list[Leaf], col: Column, label: str, first: int) -> None:
        if isinstance(t, T.StructType):
            at = first
            for sub in t.fields:
                n = _width(sub.dataType)
                add(sub, sub.dataType, own[at - first : at - first + n], col.getField(sub.name), f"{label}.{sub.name}", at)
                at += n
            return
        places = tuple(range(first, first + len(own)))
        if isinstance(t, T.MapType):
            value = P.kind_of(t.valueType)
            columns.append(string_keys(col).alias(label))
            logical.append(Logical(label, P.MAP, T.MapType(T.StringType(), t.valueType), value, places))
        elif isinstance(t, T.ArrayType):
            columns.append(col.alias(label))
            logical.append(Logical(label, P.LIST, t, None, places))
        else:
            leaf = own[0]
            if leaf.kind in (P.INT96, P.FIXED):
                kind, value = P.SPARK[P.BYTE_ARRAY], F.lit(None).cast("string")
            elif leaf.unsigned:
                bits = 32 if leaf.kind == P.INT32 else 64
                wide = col.cast("decimal(20,0)")
                kind, value = P.SPARK[leaf.kind], F.when(wide >= F.lit(Decimal(1 << bits - 1)), wide - F.lit(Decimal(1 << bits))).otherwise(wide).cast(P.SPARK[leaf.kind])
            else:
                kind, value = t, col
            columns.append(value.alias(label))
            logical.append(Logical(label, P.PRIMITIVE, kind, leaf.kind, places))

    at = 0
    for f in inferred.fields:
        t, own = read_type(f.dataType)
        fields.append(T.StructField(f.name, t, True))
        add(f, t, own, F.col(f"`{f.name.replace('`', '``')}`"), f.name, at)
        at += len(own)
    return T.StructType(fields), columns, Schema(name, tuple(leaves), tuple(logical))


def _width(t: T.DataType) -> int:
    if isinstance(t, T.StructType):
        return sum(_width(f.dataType) for f in t.fields)
    if isinstance(t, T.ArrayType):
        return _width(t.elementType)
    if isinstance(t, T.MapType):
        return _width(t.keyType) + _width(t.valueType)
    return 1


def logical_of(df_schema: T.StructType) -> Schema:
    """The columns of any DataFrame's schema, where there is no file behind it."""
    columns = []
    for i, f in enumerate(df_schema.fields):
        category = {T.MapType: P.MAP, T.ArrayType: P.LIST, T.StructType: P.STRUCT}.get(type(f.dataType), P.PRIMITIVE)
        columns.append(Logical(f.name, category, f.dataType, P.kind_of(f.dataType) if category == P.PRIMITIVE else None, (i,)))
    leaves = tuple(Leaf((f.name,), P.kind_of(f.dataType) or P.BYTE_ARRAY, int(f.nullable)) for f in df_schema.fields)
    return Schema("schema", leaves, tuple(columns))


def string_keys(m: Column) -> Column:
    """The map with its keys as strings; of equal keys the last value counts, at the place of the first."""
    entries = F.transform(F.map_entries(m), lambda e: F.struct(e["key"].cast("string").alias("key"), e["value"].alias("value")))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1))
    return F.map_from_entries(F.when(F.size(keys) < F.size(entries), last).otherwise(entries))
