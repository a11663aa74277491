"""Result rows as the dialect's console prints them: tab-joined, nested values as JSON, null as NULL."""

from __future__ import annotations

import datetime
import decimal
import json
import math

from pyspark.sql import Row


def _number(v: float) -> str:
    if math.isnan(v):
        return "NaN"
    if math.isinf(v):
        return "Infinity" if v > 0 else "-Infinity"
    return repr(v)


def _inner(v) -> str:
    """A value within an array, map or struct."""
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return _number(v)
    if isinstance(v, (int, decimal.Decimal)):
        return str(v)
    if isinstance(v, Row):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_inner(x)}" for k, x in v.asDict().items()) + "}"
    if isinstance(v, dict):
        return "{" + ",".join(f"{_key(k)}:{_inner(x)}" for k, x in sorted(v.items(), key=lambda e: str(e[0]))) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_inner, v)) + "]"
    return json.dumps(value(v), ensure_ascii=False)


def _key(k) -> str:
    return json.dumps(k, ensure_ascii=False) if isinstance(k, str) else _inner(k)


def value(v) -> str:
    """One column's value."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return _number(v)
    if isinstance(v, datetime.datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S") + (f".{v.microsecond:06d}".rstrip("0") if v.microsecond else "")
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).decode("utf-8", "replace")
    if isinstance(v, (list, tuple, dict, Row)):
        return _inner(v)
    return str(v)


def line(row: Row) -> str:
    """One result row."""
    return "\t".join(map(value, row))
