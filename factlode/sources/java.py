"""Java files as segments: types, constructors and methods with their lines, found by braces; else line windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

SCHEMA = "path string, segment_key string, segment_type string, symbol string, package string, annotations array<string>, invokes array<string>, start_line int, end_line int, content string"
_BLANKED = re.compile(r'/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', re.S)
_TYPE = re.compile(r"\b(class|interface|enum|record|@interface)\s+([A-Za-z_$][\w$]*)")
_METHOD = re.compile(r"([A-Za-z_$][\w$]*)\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?:throws\s+[\w.,\s]+)?$")
_CONTROL = frozenset("if for while switch catch synchronized try do else return new".split())


def blanked(text: str) -> str:
    """The text with comments and literals as spaces; lines and offsets stay."""
    return _BLANKED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def segments(path: str, text: str) -> list[dict]:
    """Types and their methods, the outer ones first. Keys repeat with the line, then a number."""
    plain = blanked(text)
    package = re.search(r"(?m)^\s*package\s+([\w.]+)\s*;", plain)
    stack: list[dict | None] = []
    out: list[dict] = []
    start = 0
    for m in re.finditer(r"[{};]", plain):
        head = plain[start : m.start()]
        if m[0] == "{":
            found, header = None, re.sub(r"@\w+(?:\.\w+)*(?:\s*\([^()]*(?:\([^()]*\)[^()]*)*\))?", " ", head).strip()
            outer = next((s for s in reversed(stack) if s and s["segment_type"] == "type"), None)
            inside_code = bool(stack) and (stack[-1] is None or stack[-1]["segment_type"] != "type")
            kind = _TYPE.search(header)
            method = None if kind or inside_code or outer is None else _METHOD.search(header)
            names = re.findall(r"@(\w+)", head)
            at = start + len(head) - len(head.lstrip())
            if kind:
                found = {"segment_type": "type", "symbol": f"{outer['symbol']}.{kind[2]}" if outer else kind[2]}
            elif method and method[1] not in _CONTROL:
                own = outer["symbol"].rsplit(".", 1)[-1] == method[1]
                found = {"segment_type": "constructor" if own else "method", "symbol": f"{outer['symbol']}.{method[1]}"}
            if found:
                found |= {"annotations": names, "from": at}
                out.append(found)
            stack.append(found)
        elif m[0] == "}" and stack:
            closed = stack.pop()
            if closed:
                closed["to"] = m.end()
        start = m.end()
    rows, used = [], set()
    for s in out:
        end = s.get("to", len(text))
        first, last = text.count("\n", 0, s["from"]) + 1, text.count("\n", 0, end) + 1
        key = s["symbol"]
        if key in used:
            key = f"{s['symbol']}@{first}"
        while key in used:
            key += "#"
        used.add(key)
        calls = [] if s["segment_type"] == "type" else sorted({c for c in re.findall(r"([A-Za-z_$][\w$]*)\s*\(", plain[s["from"] : end]) if c not in _CONTROL and c != s["symbol"].rsplit(".", 1)[-1]})
        rows.append({
            "path": path, "segment_key": key, "segment_type": s["segment_type"], "symbol": s["symbol"], "package": package[1] if package else "", "annotations": s["annotations"], "invokes": calls,
            "start_line": first, "end_line": last, "content": text[s["from"] : end],
        })
    return rows


def parse(files: DataFrame) -> DataFrame:
    """Segments of Java files (path, text); a file without any gives its line windows as segments of type 'file'."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, t in zip(batch["path"], batch["text"], strict=True) for r in segments(p, t or "")]
            yield pd.DataFrame(rows, columns=names).astype({"start_line": "int32", "end_line": "int32"})

    found = files.select("path", "text").mapInPandas(run, SCHEMA)
    bare = files.join(found.select("path").distinct(), "path", "left_anti")
    w = bare.select("path", F.explode(tx.line_windows(F.col("text"))).alias("w"))
    none = F.array().cast("array<string>")
    windows = w.select("path", F.concat(F.lit("lines:"), F.col("w.start_line").cast("string")).alias("segment_key"), F.lit("file").alias("segment_type"), F.lit("").alias("symbol"), F.lit("").alias("package"), none.alias("annotations"), none.alias("invokes"), "w.start_line", "w.end_line", "w.content")
    return found.unionByName(windows)
