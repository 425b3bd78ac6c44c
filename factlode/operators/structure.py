"""Structure of source files: definitions, imports, calls, entry points, and the graphs between files.

Each file is scanned once into rows (path, row, name, kind, line); everything else is joins and counts over these rows.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..sources import languages
from . import rollups

_CALL = re.compile(r"\b([A-Za-z_]\w*)\s*\(")
SCHEMA = "path string, row string, name string, kind string, line int"


def code_lines(text: str, lang: languages.Language) -> list[tuple[int, str]]:
    """(line number, code) of the lines that hold code; comments are blanked, block comments across lines too."""
    out, inside = [], False
    opening, closing = lang.block or ("", "")
    for number, line in enumerate(text.splitlines(), 1):
        code, rest = "", line
        while rest:
            if inside:
                _, found, rest = rest.partition(closing)
                inside = not found
                continue
            marks = [(rest.find(m), m) for m in (*lang.line_comments, *([opening] if opening else [])) if m in rest]
            at, mark = min(marks, default=(-1, ""))
            if at < 0:
                code, rest = code + rest, ""
            elif mark == opening:
                code, rest, inside = code + rest[:at] + " ", rest[at + len(opening) :], True
            else:
                code, rest = code + rest[:at], ""
        if code.strip():
            out.append((number, code))
    return out


def _python_imports(path: str, text: str) -> list[str]:
    """Absolute module names that a Python file imports; relative ones are resolved against its package."""
    package = posixpath.dirname(path).split("/") if posixpath.dirname(path) else []
    out = []
    for m in re.finditer(r"(?ms)^[ \t]*from[ \t]+(\.*)([\w.]*)[ \t]+import[ \t]*(\([^)]*\)|[^(\n]+)|^[ \t]*import[ \t]+([^\n#]+)", text):
        dots, module, names, plain = m.groups()
        if plain is not None:
            out += [re.split(r"\s+as\s+", p.strip())[0].strip() for p in plain.split(",") if p.strip()]
            continue
        base = package[: len(package) - len(dots) + 1] if dots else []
        full = ".".join([*base, *([module] if module else [])])
        for n in re.sub(r"#[^\n]*", "", names).strip("() \n").split(","):
            n = re.split(r"\s+as\s+", n.strip())[0].strip()
            if n:
                out.append(f"{full}.{n}" if dots and not module and full else full or n)
    return list(dict.fromkeys(out))


def scan_file(path: str, text: str) -> list[tuple]:
    """Rows of one file: file, definition, import, entry, call, package."""
    lang = languages.language_of(path)
    count = text.count("\n") + (1 if text and not text.endswith("\n") else 0)
    ext = posixpath.splitext(path)[1].lstrip(".").lower()
    rows: list[tuple] = [(path, "file", lang.name if lang else ext or "text", lang.style if lang else None, count)]
    if lang is None:
        return rows
    defined, called = set(), set()
    code = code_lines(text, lang)
    for number, line in code:
        found = lang.definition(line)
        if found:
            rows.append((path, "definition", *found, number))
            defined.add(number)
        rows += [(path, "entry", kind, kind, number) for kind in lang.entered(line)]
        rows += [(path, "import", name, lang.style, number) for name in lang.imported(line)]
        if number not in defined:
            called |= {n for n in _CALL.findall(line) if n not in languages.NOT_CALLS}
    if lang.name == "Python":
        rows += [(path, "import", name, lang.style, 0) for name in _python_imports(path, text)]
    package = re.search(r"(?m)^[ \t]*(?:package|namespace)[ \t]+([\w.]+)", text) if lang.style == "dotted" else None
    if package:
        rows.append((path, "package", package[1], lang.style, 0))
    return rows + [(path, "call", n, None, 0) for n in sorted(called)]


def scan(files: DataFrame) -> DataFrame:
    """Rows of files (path, text); null text counts as empty."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for p, t in zip(batch["path"], batch["text"], strict=True) for r in scan_file(p, t or "")]
            yield pd.DataFrame(rows, columns=["path", "row", "name", "kind", "line"]).astype({"line": "int32"})

    return files.select("path", "text").mapInPandas(run, SCHEMA)


def scan_changed(files: DataFrame, previous: DataFrame) -> DataFrame:
    """Rows of files (path, text, content_hash), those of unchanged files taken from previous (SCHEMA and content_hash)."""
    known = previous.select("path", "content_hash").distinct()
    fresh = files.join(known, ["path", "content_hash"], "left_anti")
    same = files.select("path", "content_hash").join(known, ["path", "content_hash"], "left_semi")
    new = scan(fresh).join(fresh.select("path", "content_hash"), "path")
    kept = previous.join(same, ["path", "content_hash"], "left_semi")
    return new.select("path", "row", "name", "kind", "line", "content_hash").unionByName(kept.select("path", "row", "name", "kind", "line", "content_hash"))


def definitions(rows: DataFrame) -> DataFrame:
    """(symbol, path, kind, line)."""
    return rows.filter("row = 'definition'").select(F.col("name").alias("symbol"), "path", "kind", "line")


def entry_points(rows: DataFrame) -> DataFrame:
    """Entry points, main ones first, then by path and line."""
    return rows.filter("row = 'entry'").select("path", "kind", "line").orderBy(F.col("kind") != "main", "path", "line")


def files(rows: DataFrame) -> DataFrame:
    """(path, language, lines)."""
    return rows.filter("row = 'file'").select("path", F.col("name").alias("language"), F.col("line").alias("lines"))


def call_edges(rows: DataFrame, cap: int = 120) -> DataFrame:
    """Calls between files by name; see rollups.call_graph."""
    return rollups.call_graph(rows.filter("row = 'call'").select("path", F.col("name").alias("symbol")), definitions(rows), cap)


def imports(rows: DataFrame) -> DataFrame:
    """(path, target, to_path, internal): imports resolved by the language's style.

    dotted: a package and its class, a Python module, or a package inside the project without a file; relative: the path
    with the usual extensions or an index file, internal if it begins with a dot; include: a path beside the file;
    colons: crate, self and super are internal; others external.
    """
    imp = rows.filter("row = 'import'").select("path", F.col("name").alias("target"), F.col("kind").alias("style")).distinct()
    paths = rows.filter("row = 'file'").select(F.col("path").alias("to_path"))
    stem = F.regexp_replace(tx.basename(F.col("path")), r"\.[^.]*$", "")
    named = rows.filter("row = 'package'").select(F.concat_ws(".", "name", stem).alias("module"), F.col("path").alias("to_path"))
    python = paths.filter(F.col("to_path").endswith(".py")).select(F.replace(F.regexp_replace("to_path", r"(/__init__)?\.py$", ""), F.lit("/"), F.lit(".")).alias("module"), "to_path")
    modules = named.unionByName(python).groupBy("module").agg(F.min("to_path").alias("to_path"))
    every = F.transform(F.sequence(F.lit(1), F.size(F.split("module", r"\."))), lambda i: F.array_join(F.slice(F.split("module", r"\."), 1, i), "."))
    inside = modules.select(F.explode(every).alias("module")).distinct()
    ends = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]

    @F.pandas_udf(T.StringType())
    def beside(paths: pd.Series, targets: pd.Series) -> pd.Series:
        return pd.Series([posixpath.normpath(posixpath.join(posixpath.dirname(p), t)) for p, t in zip(paths, targets, strict=True)])

    base = F.regexp_replace("target", r"\.\*$", "")
    # a name imported from a module resolves to the module
    parent = F.regexp_replace("target", r"\.[^.]+$", "")
    tried = imp.withColumn("candidates", F.when(F.col("style") == "dotted", F.array("target", parent)).when(
        (F.col("style") == "relative") & F.col("target").startswith("."), F.array(beside("path", "target"), *[F.concat(beside("path", "target"), F.lit(x)) for x in [*ends, ".rb", *("/index" + e for e in ends)]])
    ).when(F.col("style") == "include", F.array(beside("path", "target"))).otherwise(F.array().cast("array<string>")))
    spread = tried.select("path", "target", "style", F.posexplode("candidates").alias("n", "candidate"))
    dotted = spread.filter("style = 'dotted'").join(modules, F.col("candidate") == F.col("module")).select("path", "target", "n", "to_path")
    by_path = spread.filter("style <> 'dotted'").join(paths, F.col("candidate") == F.col("to_path")).select("path", "target", "n", "to_path")
    best = dotted.unionByName(by_path).groupBy("path", "target").agg(F.min_by("to_path", "n").alias("to_path"))
    out = imp.join(best, ["path", "target"], "left").withColumn("__base", base)
    out = out.join(inside.select(F.col("module").alias("__base"), F.lit(True).alias("__in")), "__base", "left")
    internal = F.col("to_path").isNotNull() | ((F.col("style") == "dotted") & F.coalesce("__in", F.lit(False))) | ((F.col("style") == "relative") & F.col("target").startswith(".")) | ((F.col("style") == "colons") & F.col("target").rlike("^(crate|self|super)(::|$)"))
    return out.select("path", "target", "to_path", internal.alias("internal"))


def dependency_edges(resolved: DataFrame) -> DataFrame:
    """(from_path, to_path) between files, once."""
    return resolved.filter("to_path is not null and to_path <> path").select(F.col("path").alias("from_path"), "to_path").distinct()


def external(resolved: DataFrame, limit: int = 50) -> DataFrame:
    """External modules by the number of imports, ties by name."""
    return rollups.top_counts(resolved.filter("not internal"), "target", limit)


def module_graph(rows: DataFrame) -> DataFrame:
    """Edges between directories, counted over imports and calls."""
    edges = dependency_edges(imports(rows)).unionByName(call_edges(rows).select("from_path", "to_path"))
    return rollups.module_edges(edges)


def term_usage(rows: DataFrame, term: str, caps: tuple[int, int, int] = (25, 50, 20)) -> DataFrame:
    """One row: definitions, calling files and modules of a term, capped lists under a fixed order."""
    low = term.lower()
    d = rows.filter((F.col("row") == "definition") & (F.lower("name") == low)).agg(F.slice(F.sort_array(F.collect_set(F.concat_ws(":", "path", F.col("line").cast("string")))), 1, caps[0]).alias("definitions"))
    c = rows.filter((F.col("row") == "call") & F.lower("name").contains(low)).agg(F.slice(F.sort_array(F.collect_set("path")), 1, caps[1]).alias("callers"), F.slice(F.sort_array(F.collect_set(tx.directory(F.col("path")))), 1, caps[2]).alias("modules"))
    return d.withColumn("__k", F.lit(1)).join(c.withColumn("__k", F.lit(1)), "__k").drop("__k")


def layers(rows: DataFrame, roles: DataFrame) -> DataFrame:
    """Files by role (roles: path, role), as sorted lists."""
    return roles.groupBy("role").agg(F.count("*").alias("files"), F.sort_array(F.collect_set("path")).alias("paths"))


def assign_roles(files: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(path, role, via) by the first rule (role, via, pattern) that fits; via 'annotation' tests the text, 'name' the last part, 'path' the path."""
    subject = {"annotation": F.col("text"), "name": tx.basename(F.col("path")), "path": F.col("path")}
    out = F.lit(None).cast("struct<role:string,via:string>")
    for role, via, pattern in reversed(rules):
        out = F.when(subject[via].rlike(pattern), F.struct(F.lit(role).alias("role"), F.lit(via).alias("via"))).otherwise(out)
    return files.select("path", out.alias("r")).filter("r is not null").select("path", "r.*")


def facets(files: DataFrame, rules: list[tuple[str, str]], cap: int = 500) -> DataFrame:
    """Facts of facets (facet, pattern): (facet, path, line, value), at most cap of each, and whether there are more."""
    lines = files.select("path", F.posexplode(tx.lines(F.col("text"))).alias("n", "content"))
    out = None
    for facet, pattern in rules:
        found = lines.select(F.lit(facet).alias("facet"), "path", (F.col("n") + 1).alias("line"), F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("value"))
        out = found if out is None else out.unionByName(found)
    ranked = out.withColumn("__n", F.row_number().over(Window.partitionBy("facet").orderBy("path", "line", "value")))
    sizes = out.groupBy("facet").agg((F.count("*") > cap).alias("truncated"))
    return ranked.filter(F.col("__n") <= cap).drop("__n").join(sizes, "facet")
