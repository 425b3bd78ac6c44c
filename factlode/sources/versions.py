"""Two versions of files: line ranges that differ, and what kind of content a version is."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def line_ranges(pairs: DataFrame) -> DataFrame:
    """Ranges of lines that differ between before and after (path, before, after): (path, side, start, count); sides of no lines are left out."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, before, after in zip(batch["path"], batch["before"], batch["after"], strict=True):
                old, new = (before or "").splitlines(), (after or "").splitlines()
                for tag, a1, a2, b1, b2 in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
                    if tag != "equal":
                        rows += [(path, side, lo + 1, hi - lo) for side, lo, hi in (("before", a1, a2), ("after", b1, b2)) if hi > lo]
            yield pd.DataFrame(rows, columns=["path", "side", "start", "count"]).astype({"start": "int32", "count": "int32"})

    return pairs.select("path", "before", "after").mapInPandas(run, "path string, side string, start int, count int")


def content_kind(content: Column) -> Column:
    """'pointer' for a large-file pointer, 'binary' for a NUL in the first 8 KiB, else 'text'."""
    head = F.decode(F.substring(content, 1, 8192), "ISO-8859-1")
    return F.when(head.startswith("version https://git-lfs.github.com/spec/"), "pointer").when(F.locate("\x00", head) > 0, "binary").otherwise("text")


def raw_changes(raw: DataFrame) -> DataFrame:
    """File changes of raw diff lines (line): old and new mode and blob, change, similarity, paths."""
    p = r"^:(\d{6}) (\d{6}) ([0-9a-f]+) ([0-9a-f]+) ([ACDMRTUX])(\d{0,3})\t([^\t]+)(?:\t(.+))?$"
    part = lambda i: F.nullif(F.regexp_extract("line", p, i), F.lit(""))
    names = F.create_map(*[F.lit(x) for kv in {"A": "added", "C": "copied", "D": "deleted", "M": "modified", "R": "renamed", "T": "type-changed", "U": "unmerged", "X": "unknown"}.items() for x in kv])
    out = raw.filter(F.col("line").rlike(p)).select(
        part(1).alias("old_mode"), part(2).alias("new_mode"), part(3).alias("old_blob"), part(4).alias("new_blob"), names[part(5)].alias("change"), part(6).cast("int").alias("similarity"), part(7).alias("first"), part(8).alias("second")
    )
    return out.select("old_mode", "new_mode", "old_blob", "new_blob", "change", "similarity", F.when(F.col("change") != "added", F.col("first")).alias("path_before"), F.when(F.col("change") != "deleted", F.coalesce("second", "first")).alias("path_after"))


def head(files: DataFrame) -> DataFrame:
    """(branch, commit) of a repository from its files below .git (path, text): HEAD and the loose or packed refs."""
    at = files.filter("path = 'HEAD'").select(strip(F.col("text")).alias("h"))
    at = at.select(F.regexp_extract("h", r"^ref: (\S+)$", 1).alias("ref"), F.regexp_extract("h", "^([0-9a-f]{40,64})$", 1).alias("own"))
    loose = files.select(F.col("path").alias("name"), strip(F.col("text")).alias("sha")).filter(F.col("sha").rlike("^[0-9a-f]{40,64}$")).withColumn("n", F.lit(0))
    packed = files.filter("path = 'packed-refs'").select(F.explode(F.split("text", "\n")).alias("l")).filter(F.col("l").rlike("^[0-9a-f]{40,64} "))
    packed = packed.select(F.split("l", " ")[1].alias("name"), F.split("l", " ")[0].alias("sha"), F.lit(1).alias("n"))
    refs = loose.unionByName(packed).groupBy("name").agg(F.min_by("sha", "n").alias("sha"))
    j = at.join(refs, F.col("ref") == F.col("name"), "left")
    return j.select(F.nullif(F.regexp_replace("ref", "^refs/heads/", ""), F.lit("")).alias("branch"), F.coalesce(F.nullif("own", F.lit("")), "sha").alias("commit"))
