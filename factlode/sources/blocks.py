"""Blocks of documents: the builder that parsers write to, and how parsers run over files."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks of one document at most, and characters of one block; what is over makes the document partial.
MAX_BLOCKS = 20_000
MAX_CHARS = 200_000

SCHEMA = (
    "path string, status string, ordinal int, block_key string, block_type string, level int, parent_key string, heading_path array<string>, "
    "start_line int, end_line int, locator string, content string, content_hash string, warning string"
)


@dataclass
class Builder:
    """Collects a document's blocks, with unique keys and the stack of headings above each."""

    rows: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    stack: list[tuple[int, str, str]] = field(default_factory=list)
    used: dict[str, int] = field(default_factory=dict)
    status: str = "parsed"

    def warn(self, message: str, partial: bool = False) -> None:
        """Note a warning; a partial one shows in the status."""
        self.warnings.append(message)
        if partial:
            self.status = "partial"

    def key(self, kind: str, content: str) -> str:
        """A key from the type and the content's first words, numbered where it repeats."""
        words = "".join(c if c.isalnum() else "-" for c in content[:40].lower()).strip("-")
        base = f"{kind}:{'-'.join(filter(None, words.split('-')))[:40]}"
        n = self.used[base] = self.used.get(base, 0) + 1
        return base if n == 1 else f"{base}#{n}"

    def add(self, kind: str, content: str, start: int = 0, end: int = 0, level: int = 0, locator: str = "") -> None:
        """Add a block. A heading closes the headings of its level and below."""
        if len(self.rows) >= MAX_BLOCKS:
            if self.status != "partial":
                self.warn(f"more than {MAX_BLOCKS} blocks", partial=True)
            return
        if len(content) > MAX_CHARS:
            self.warn(f"a block was cut to {MAX_CHARS} characters", partial=True)
            content = content[:MAX_CHARS]
        if kind == "heading":
            while self.stack and self.stack[-1][0] >= level:
                self.stack.pop()
        key = self.key(kind, content)
        self.rows.append({
            "ordinal": len(self.rows), "block_key": key, "block_type": kind, "level": level, "parent_key": self.stack[-1][2] if self.stack else None,
            "heading_path": [t for _, t, _ in self.stack], "start_line": start, "end_line": end, "locator": locator or (f"lines:{start}-{end}" if start else ""),
            "content": content, "content_hash": hashlib.sha256(content.encode("utf-8", "surrogatepass")).hexdigest(),
        })
        if kind == "heading":
            self.stack.append((level, content, key))


def document(path: str, text: str | None, read: Callable[[str, Builder], None]) -> list[dict]:
    """Rows of one document: its blocks, or one row without a block. A parser's exception gives status 'failed'."""
    out = Builder()
    try:
        read(text or "", out)
    except Exception as e:  # noqa: BLE001 one bad document must not stop the others
        out = Builder(status="failed", warnings=[f"{type(e).__name__}: {e}"[:300]])
    warning = "; ".join(out.warnings) or None
    empty = dict.fromkeys(("ordinal", "block_key", "block_type", "level", "parent_key", "heading_path", "start_line", "end_line", "locator", "content", "content_hash"))
    return [{"path": path, "status": out.status, "warning": warning} | r for r in out.rows or [empty]]


def run(files: DataFrame, read: Callable[[str, Builder], None], parser: str) -> DataFrame:
    """Parse files (path, text) one by one, in batches of the partition that holds them."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first in range(0, len(batch), 64):
                part = batch.iloc[first : first + 64]
                rows = [r for p, t in zip(part["path"], part["text"], strict=True) for r in document(p, t, read)]
                frame = pd.DataFrame(rows, columns=names)
                for c in ("ordinal", "level", "start_line", "end_line"):
                    frame[c] = frame[c].astype("Int32")
                yield frame

    return files.select("path", "text").mapInPandas(parse, SCHEMA).withColumn("parser", F.lit(parser))


def structure_hash(blocks: DataFrame) -> DataFrame:
    """(path, structure_hash): SHA-256 of parser and status, then key, type, ordinal, parent and content hash of each block in order."""
    us, rs = "\x1f", "\x1e"
    one = F.struct("ordinal", F.concat_ws(us, "block_key", "block_type", F.col("ordinal").cast("string"), F.coalesce("parent_key", F.lit("")), "content_hash").alias("s"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("ordinal").isNotNull(), one))), lambda x: x["s"]), rs)
    return blocks.groupBy("path").agg(F.sha2(F.concat_ws(rs, F.concat_ws(us, F.first("parser"), F.first("status")), body).cast("binary"), 256).alias("structure_hash"))
