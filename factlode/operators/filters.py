"""Metadata and document filters with two-valued logic: a missing value is a value."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def where(conditions: dict[str, Any]) -> Column:
    """A metadata filter: {key: value}, {key: {$eq | $ne | $in | $nin: value}}, $and, $or.

    A missing value equals only null, so $ne and $nin hold for it; unknown operators hold always.
    """
    out = F.lit(True)
    for key, wanted in (conditions or {}).items():
        if key in ("$and", "$or"):
            parts = [where(c) for c in wanted]
            joined = F.lit(key == "$and")
            for p in parts:
                joined = (joined & p) if key == "$and" else (joined | p)
            out = out & joined
        elif isinstance(wanted, dict):
            for op, value in wanted.items():
                out = out & _compare(F.col(key), op, value)
        else:
            out = out & _compare(F.col(key), "$eq", wanted)
    return out


def _compare(column: Column, op: str, value: Any) -> Column:
    if op in ("$eq", "$ne"):
        same = column.eqNullSafe(F.lit(value))
        return same if op == "$eq" else ~same
    if op in ("$in", "$nin"):
        found = F.coalesce(column.isin([v for v in value if v is not None]), F.lit(None in value))
        return found if op == "$in" else ~found
    return F.lit(True)


def where_document(text: Column, conditions: dict[str, Any]) -> Column:
    """A text filter of $contains, $not_contains, $and, $or; case-sensitive, null counts as empty."""
    body, out = F.coalesce(text, F.lit("")), F.lit(True)
    for op, value in (conditions or {}).items():
        if op == "$contains":
            out = out & body.contains(str(value))
        elif op == "$not_contains":
            out = out & ~body.contains(str(value))
        elif op in ("$and", "$or"):
            joined = F.lit(op == "$and")
            for c in value:
                joined = (joined & where_document(text, c)) if op == "$and" else (joined | where_document(text, c))
            out = out & joined
    return out


def contains_nocase(column: Column, needle: str) -> Column:
    """Substring test without regard to ASCII case; nothing in the needle is a wildcard."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(column, upper, upper.lower()).contains(needle.translate(str.maketrans(upper, upper.lower())))


def excluded(path: Column, entries: list[str]) -> Column:
    """The path is an entry or lies under one."""
    out = F.lit(False)
    for e in entries:
        out = out | (path == e) | path.startswith(e.rstrip("/") + "/")
    return out


def glob_pattern(pattern: str) -> str:
    """A shell pattern (*, ?, [..]) as an anchored regular expression."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] == "!" else body) + "]"
            i = end
        else:
            out += c if c.isalnum() or c == "_" else "\\" + c
        i += 1
    return f"(?s)^{out}$"


def matches_glob(path: Column, pattern: str) -> Column:
    """Case-insensitive shell pattern over the path or its last part."""
    low = F.lower(path)
    rx = glob_pattern(pattern.lower())
    return low.rlike(rx) | F.regexp_extract(low, "([^/]*)$", 1).rlike(rx)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, most: int = 500) -> DataFrame:
    """One page under a total order; limit and offset are clamped."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, most)))
