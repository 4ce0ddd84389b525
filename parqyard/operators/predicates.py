"""The filter algebra: eleven operators on one column's value, All/Any sets, and their quantification over columns.

A predicate looks at a single column. `compile_any` asks whether some column of a row meets it; `compile_all` takes
several predicates, each of which some column must meet, not necessarily the same one. A set of predicates, in
contrast, is met by one column that meets all (or any) of its members. Everything compiles to one Spark Column made of
plain comparisons, so that Catalyst can push it into the scan; legs that a column's type rules out vanish beforehand.

Values have exact types: a literal meets columns of its own kind only. Null follows two-valued logic: it meets isNull
and `neq m` for any m but null, and nothing else.
"""

from __future__ import annotations

import operator
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types as P
from ..schema import Logical

#: What a predicate gives for one column: a Column, or True or False for every row alike.
Result = Column | bool
ORDERED = ("lt", "lte", "gt", "gte")
OPERATORS = ("eq", "neq", *ORDERED, "contains", "prefix", "suffix", "isNull", "isNotNull")


def both(parts: Iterable[Result]) -> Result:
    return _fold(list(parts), operator.and_, True)


def either(parts: Iterable[Result]) -> Result:
    return _fold(list(parts), operator.or_, False)


def _fold(parts: list[Result], join: Callable, unit: bool) -> Result:
    """A balanced tree of the parts that are not the unit; its opposite decides alone."""
    if any(p is (not unit) for p in parts):
        return not unit
    rest = [p for p in parts if p is not unit]
    while len(rest) > 1:
        rest = [join(*rest[i : i + 2]) if i + 1 < len(rest) else rest[i] for i in range(0, len(rest), 2)]
    return rest[0] if rest else unit


class Predicate:
    """Something that one column's value meets or does not."""

    def on(self, column: Logical) -> Result:
        raise NotImplementedError


@dataclass(frozen=True)
class Compare(Predicate):
    op: str
    value: Any = None

    def on(self, column: Logical) -> Result:
        c, m = column.column(), self.value
        if self.op == "isNull":
            return c.isNull()
        if self.op == "isNotNull":
            return c.isNotNull()
        if self.op == "neq":
            return self._differs(column, c, m)
        if m is None:
            return False
        if self.op == "eq":
            return _equal(column, c, m)
        if self.op == "contains" and column.category == P.LIST:
            if not isinstance(m, P.Literal) or m.kind != column.value_kind:
                return False
            return F.exists(c, lambda x: x.eqNullSafe(m.column()))
        if column.category != P.PRIMITIVE or not isinstance(m, P.Literal) or m.kind != _value_kind(column):
            return False
        if self.op in ORDERED:
            return {"lt": operator.lt, "lte": operator.le, "gt": operator.gt, "gte": operator.ge}[self.op](c, m.column())
        if m.kind != P.BYTE_ARRAY:
            return False
        return {"contains": c.contains, "prefix": c.startswith, "suffix": c.endswith}[self.op](m.value)

    def _differs(self, column: Logical, c: Column, m: Any) -> Result:
        if m is None:
            return c.isNotNull()
        if column.category == P.STRUCT:
            return c.isNull()
        same = _equal(column, c, m)
        if same is False:
            return True
        if column.category == P.PRIMITIVE:
            return ~c.eqNullSafe(m.column())
        return ~F.coalesce(same, F.lit(False))


def _value_kind(column: Logical) -> str | None:
    """The kind of the values that the view shows; INT96 and fixed-length columns show none."""
    return P.kind_of(column.data_type) if column.kind not in (P.INT96, P.FIXED) else None


def _equal(column: Logical, c: Column, m: Any) -> Result:
    if column.category == P.PRIMITIVE:
        return c == m.column() if isinstance(m, P.Literal) and m.kind == _value_kind(column) else False
    if column.category == P.LIST:
        if not isinstance(m, list):
            return False
        want = _array(m, column.data_type.elementType)
        return False if want is None else c == want
    if column.category == P.MAP:
        if not isinstance(m, dict):
            return False
        if any(k is None or k.kind != P.BYTE_ARRAY for k in m):
            return False
        values = _array(list(m.values()), column.data_type.valueType)
        if values is None:
            return False
        if not m:
            return F.size(c) == 0
        want = F.map_from_arrays(F.array(*[k.column() for k in m]), values)
        # maps have no order and no equality of their own: their sorted entries have
        return c.isNotNull() & F.array_sort(F.map_entries(c)).eqNullSafe(F.array_sort(F.map_entries(want)))
    return False


def _array(values: list, element: T.DataType) -> Column | None:
    """An array of literals for a column of such elements; None if one is of another kind."""
    kind = P.kind_of(element)
    if any(not isinstance(v, P.Literal) or v.kind != kind for v in values if v is not None):
        return None
    return F.array(*[F.lit(None).cast(element) if v is None else v.column() for v in values]).cast(T.ArrayType(element))


@dataclass(frozen=True)
class Set(Predicate):
    """One column's value meets all members (`All`) or any (`Any`); with no members, True or False."""

    join: str
    members: tuple[Predicate, ...]

    def on(self, column: Logical) -> Result:
        return (both if self.join == "All" else either)(p.on(column) for p in self.members)


@dataclass(frozen=True)
class Custom(Predicate):
    """A function of the column's description and its Spark Column."""

    fn: Callable[[Logical, Column], Result]

    def on(self, column: Logical) -> Result:
        return self.fn(column, column.column())


@dataclass(frozen=True)
class Named(Predicate):
    """Met by the column of that exact name only."""

    name: str
    inner: Predicate

    def on(self, column: Logical) -> Result:
        return self.inner.on(column) if column.name == self.name else False


def predicate(op: str, value: Any = None) -> Predicate:
    """The predicate of an operator's name; ValueError for an unknown one or a value it can't take."""
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op!r}")
    if op in ("isNull", "isNotNull"):
        return Compare(op)
    m = P.literal(value)
    if op in ORDERED and not isinstance(m, P.Literal):
        raise ValueError(f"{op} needs a value that has an order, not {value!r}")
    if op in ("prefix", "suffix") and not (isinstance(m, P.Literal) and m.kind == P.BYTE_ARRAY):
        raise ValueError(f"{op} needs a string, not {value!r}")
    return Compare(op, m)


def eq(value: Any) -> Predicate:
    return predicate("eq", value)


def neq(value: Any) -> Predicate:
    return predicate("neq", value)


def lt(value: Any) -> Predicate:
    return predicate("lt", value)


def lte(value: Any) -> Predicate:
    return predicate("lte", value)


def gt(value: Any) -> Predicate:
    return predicate("gt", value)


def gte(value: Any) -> Predicate:
    return predicate("gte", value)


def contains(value: Any) -> Predicate:
    return predicate("contains", value)


def prefix(value: Any) -> Predicate:
    return predicate("prefix", value)


def suffix(value: Any) -> Predicate:
    return predicate("suffix", value)


def is_null() -> Predicate:
    return predicate("isNull")


def is_not_null() -> Predicate:
    return predicate("isNotNull")


def all_of(*members: Predicate) -> Predicate:
    return Set("All", members)


def any_of(*members: Predicate) -> Predicate:
    return Set("Any", members)


def named(name: str, inner: Predicate) -> Predicate:
    return Named(name, inner)


def custom(fn: Callable[[Logical, Column], Result]) -> Predicate:
    return Custom(fn)


def compile_any(p: Predicate, columns: Sequence[Logical]) -> Result:
    """Whether some column of a row meets p."""
    return either(p.on(c) for c in columns)


def compile_all(ps: Sequence[Predicate] | None, columns: Sequence[Logical]) -> Result:
    """Whether each of ps is met by some column; none at all let every row through."""
    return both(compile_any(p, columns) for p in ps or ())
