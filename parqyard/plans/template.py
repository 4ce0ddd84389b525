"""A test of a table, written from what the table holds now: its rows, its columns and the first row's values."""

from __future__ import annotations

import math
import re
from typing import Any

from pyspark.sql import SparkSession

from ..operators.query import Table


def _literal(v: Any) -> str | None:
    """Python source that equals v, or None if v has no plain literal."""
    if isinstance(v, (bytes, bytearray)):
        return repr(bytes(v))
    if v is None or isinstance(v, (bool, int, str)) or (isinstance(v, float) and math.isfinite(v)):
        return repr(v)
    if type(v) is list:
        parts = [_literal(x) for x in v]
        return None if None in parts else f"[{', '.join(parts)}]"
    if type(v) is dict:
        parts = [(_literal(k), _literal(x)) for k, x in v.items()]
        return None if any(None in p for p in parts) else "{" + ", ".join(f"{k}: {x}" for k, x in parts) + "}"
    return None


def test_source(spark: SparkSession, path: str) -> str:
    """Source of a pytest function, with a `spark` fixture, that holds the table at path to its present state.

    Values without a plain literal (NaN, decimals, structs) are held to their repr. An empty table has no row to hold.
    """
    table = Table.open(spark, path, order=True)
    name = re.sub(r"\W+", "_", path.rstrip("/").rsplit("/", 1)[-1].removesuffix(".parquet")).strip("_").lower()
    lines = [
        "from parqyard import Table",
        "",
        "",
        f"def test_{name or 'table'}(spark):",
        f"    table = Table.open(spark, {path!r}, order=True)",
        f"    assert table.total_rows() == {table.total_rows()}",
        "    assert [str(c) for c in table.columns()] == [",
        *[f"        {str(c)!r}," for c in table.columns()],
        "    ]",
    ]
    first = next(table.limit(1).rows(), None)
    if first is not None:
        lines.append("    first = next(table.limit(1).rows())")
        for i, v in enumerate(first.values):
            text = _literal(v)
            lines.append(f"    assert repr(first[{i}]) == {repr(v)!r}" if text is None else f"    assert first[{i}] is {text}" if v is None or isinstance(v, bool) else f"    assert first[{i}] == {text}")
    return "\n".join(lines) + "\n"


test_source.__test__ = False  # not itself a test
