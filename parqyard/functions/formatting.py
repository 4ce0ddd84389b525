"""Values and statistics as text for reports and JSON."""

from __future__ import annotations

import struct
from typing import Any

#: How the format's plain numbers are unpacked.
_PLAIN = {"INT32": "<i", "INT64": "<q", "FLOAT": "<f", "DOUBLE": "<d"}


def _number(kind: str, raw: bytes) -> str | None:
    code = _PLAIN.get(kind)
    if code and len(raw) >= struct.calcsize(code):
        return str(struct.unpack_from(code, raw)[0])
    if kind == "BOOLEAN" and raw:
        return "true" if raw[0] else "false"
    return None


def hexed(raw: bytes, most: int) -> str:
    return "0x" + raw[:most].hex() + ("..." if len(raw) > most else "")


def statistic(raw: bytes | None, kind: str) -> str:
    """A recorded bound for reading: numbers, quoted text cut at 50, other bytes in hex, N/A for none."""
    if not raw:
        return "N/A"
    raw = bytes(raw)
    number = _number(kind, raw)
    if number is not None:
        return number
    if kind in ("BYTE_ARRAY", "FIXED_LEN_BYTE_ARRAY"):
        text = raw.decode("utf-8", "replace")
        if all(" " <= c < "\x7f" or c.isspace() for c in text):
            return f'"{text[:50]}..."' if len(text) > 50 else f'"{text}"'
    return hexed(raw, len(raw) if kind == "INT96" else 16)


def statistic_json(raw: bytes | None, kind: str) -> str | None:
    """A recorded bound in full: numbers and UTF-8 text, all else in hex."""
    if not raw:
        return None
    raw = bytes(raw)
    number = _number(kind, raw)
    return number if number is not None else raw.decode("utf-8", "replace") if kind == "BYTE_ARRAY" else "0x" + raw.hex()


def value(v: Any) -> str:
    """A value for reading: strings quoted and cut at 100, maps at 5 entries, lists at 10."""
    if v is None:
        return "NULL"
    if isinstance(v, (bytes, bytearray)):
        v = bytes(v).decode("utf-8", "replace")
    if isinstance(v, str):
        return f'"{v[:100]}..."' if len(v) > 100 else f'"{v}"'
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, dict):
        more = [f"... ({len(v) - 5} more)"] if len(v) > 5 else []
        return "{" + ", ".join([f"{value(k)}: {value(x)}" for k, x in list(v.items())[:5]] + more) + "}"
    if isinstance(v, (list, tuple)):
        more = [f"... ({len(v) - 10} more)"] if len(v) > 10 else []
        return "[" + ", ".join([value(x) for x in list(v)[:10]] + more) + "]"
    return str(v)
