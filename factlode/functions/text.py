"""Lines, hashes, ids and excerpts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode(content: Column) -> Column:
    """Bytes as strict UTF-8, else as Latin-1; null gives the empty string."""
    return F.coalesce(F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1")), F.lit(""))


def sha1_text(text: Column) -> Column:
    """Change-detection key of a text."""
    return F.sha1(F.coalesce(text, F.lit("")).cast("binary"))


def sha256_text(text: Column) -> Column:
    """Identity of a text's bytes."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def chunk_id(path: Column, symbol: Column, index: Column, prefix: str = "c_") -> Column:
    """Content-derived id of a chunk."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", path, symbol, index.cast("string")).cast("binary")), 1, 18))


def lines(text: Column) -> Column:
    """Lines between line feeds, trailing empty ones kept."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_windows(text: Column, width: int = 220, overlap: int = 20) -> Column:
    """(start_line, end_line, content) windows of so many lines; the first that reaches the end is the last."""
    def windows(ls: Column) -> Column:
        stride = width - overlap
        last = F.ceil(F.greatest(F.size(ls) - width, F.lit(0)) / stride).cast("int")
        return F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.struct(
                (i * stride + 1).alias("start_line"),
                F.least(i * stride + width, F.size(ls)).alias("end_line"),
                F.array_join(F.slice(ls, i * stride + 1, width), "\n").alias("content"),
            ),
        )

    return F.transform(F.array(lines(text)), windows)[0]


def slice_lines(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end, from 1, inclusive, clamped to the text; empty if nothing is left."""
    def of(ls: Column) -> Column:
        first, last = F.greatest(start, F.lit(1)), F.least(end, F.size(ls))
        return F.when(first <= last, F.array_join(F.slice(ls, first, last - first + 1), "\n")).otherwise("")

    return F.transform(F.array(lines(text)), of)[0]


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def excerpt(text: Column, most: int = 400) -> Column:
    """Without leading comment header lines, trimmed, cut."""
    return F.substring(strip(F.regexp_replace(F.coalesce(text, F.lit("")), r"^(// [^\n]*\n)+", "")), 1, most)


def collapse(text: Column) -> Column:
    """White space collapsed, trimmed and lower-cased."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")))


def slug(text: Column, most: int = 60) -> Column:
    """Key-safe form of a heading."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def relative(path: Column, root: str) -> Column:
    """The path below root, with forward slashes."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    root = root.replace("\\", "/").rstrip("/")
    cut = F.when(plain.startswith(root + "/"), F.substring(plain, F.lit(len(root) + 2), F.length(plain))).otherwise(plain) if root else plain
    return F.regexp_replace(cut, r"^(\./)+", "")


def directory(path: Column) -> Column:
    """Directory of a path, '.' at the top."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(".")


def extension(path: Column) -> Column:
    """Lower-case extension with its dot, or empty."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def basename(path: Column) -> Column:
    """Last part of a path."""
    return F.regexp_extract(F.replace(path, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1)


def token_estimate(text: Column) -> Column:
    """Characters / 4, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.char_length(F.coalesce(text, F.lit(""))) / 4)).cast("long")
