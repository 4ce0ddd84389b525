"""The value model: physical column kinds, typed literals, and what each is in Spark.

A filter's literal has one exact type and meets only columns of the same kind, so Python's one int is not enough: use
I32 or I64. Plain str, bool and float stand for Str, Bool and F64.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Physical kinds, by their name in the format.
BOOLEAN, INT32, INT64, INT96 = "BOOLEAN", "INT32", "INT64", "INT96"
FLOAT, DOUBLE, BYTE_ARRAY, FIXED = "FLOAT", "DOUBLE", "BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY"
#: Logical kinds of a column.
PRIMITIVE, MAP, LIST, STRUCT = "PRIMITIVE", "MAP", "LIST", "STRUCT"

SPARK = {BOOLEAN: T.BooleanType(), INT32: T.IntegerType(), INT64: T.LongType(), FLOAT: T.FloatType(), DOUBLE: T.DoubleType(), BYTE_ARRAY: T.StringType()}
KIND = {T.BooleanType: BOOLEAN, T.IntegerType: INT32, T.ShortType: INT32, T.ByteType: INT32, T.LongType: INT64, T.FloatType: FLOAT, T.DoubleType: DOUBLE, T.StringType: BYTE_ARRAY}


def kind_of(data_type: T.DataType) -> str | None:
    """The physical kind whose values a Spark type holds as they are; None for all others."""
    return KIND.get(type(data_type))


@dataclass(frozen=True)
class Literal:
    kind: str
    value: Any

    def column(self) -> Column:
        return F.lit(self.value).cast(SPARK[self.kind])


def _int(kind: str, bits: int, value: int) -> Literal:
    if isinstance(value, bool) or not isinstance(value, int) or not -(1 << bits - 1) <= value < 1 << bits - 1:
        raise ValueError(f"not a {kind} value: {value!r}")
    return Literal(kind, value)


def I32(value: int) -> Literal:  # noqa: N802
    return _int(INT32, 32, value)


def I64(value: int) -> Literal:  # noqa: N802
    return _int(INT64, 64, value)


def F32(value: float) -> Literal:  # noqa: N802
    return Literal(FLOAT, float(value))


def F64(value: float) -> Literal:  # noqa: N802
    return Literal(DOUBLE, float(value))


def Str(value: str) -> Literal:  # noqa: N802
    return Literal(BYTE_ARRAY, str(value))


def Bool(value: bool) -> Literal:  # noqa: N802
    return Literal(BOOLEAN, bool(value))


def literal(value: Any) -> Any:
    """value as a Literal, or as a list or dict of them; None stays None."""
    if value is None or isinstance(value, Literal):
        return value
    if isinstance(value, bool):
        return Bool(value)
    if isinstance(value, float):
        return F64(value)
    if isinstance(value, str):
        return Str(value)
    if isinstance(value, (bytes, bytearray)):
        return Str(bytes(value).decode("utf-8", "replace"))
    if isinstance(value, (list, tuple)):
        return [literal(v) for v in value]
    if isinstance(value, dict):
        return {literal(k): literal(v) for k, v in value.items()}
    if isinstance(value, int):
        raise ValueError(f"{value} may be 32 or 64 bits: say I32({value}) or I64({value})")
    raise ValueError(f"no literal for {type(value).__name__}")
