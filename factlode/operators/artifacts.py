"""Artifacts made of structure: architecture, flows, directory graphs, overviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import graph, rollups, structure


def architecture(rows: DataFrame, roles: DataFrame, responsibilities: int = 8, modules: int = 200) -> DataFrame:
    """Modules that hold definitions, by path: files, their first definitions by file and line, and files by role."""
    d = structure.definitions(rows).withColumn("module", tx.directory(F.col("path")))
    ranked = d.withColumn("__n", F.row_number().over(Window.partitionBy("module").orderBy("path", "line", "symbol"))).filter(F.col("__n") <= responsibilities)
    first = ranked.groupBy("module").agg(F.transform(F.sort_array(F.collect_list(F.struct("__n", "symbol"))), lambda x: x["symbol"]).alias("responsibilities"))
    files = structure.files(rows).withColumn("module", tx.directory(F.col("path"))).join(roles, "path", "left")
    by_role = files.filter("role is not null").groupBy("module", "role").agg(F.count("*").alias("n")).groupBy("module").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("role", "n"))), lambda x: F.concat_ws("=", x["role"], x["n"].cast("string"))), ",").alias("roles"))
    count = files.groupBy("module").agg(F.count("*").alias("files"))
    return first.join(count, "module").join(by_role, "module", "left").orderBy("module").limit(modules)


def flows(rows: DataFrame, most: int = 6, steps: int = 30, depth: int = 3) -> DataFrame:
    """What entry points reach over calls: (entry, path, depth), the first entries and at most so many files of each."""
    entries = structure.entry_points(rows).select("path", "kind").distinct().orderBy(F.col("kind") != "main", "path").limit(most).select(F.col("path").alias("entry")).distinct()
    calls = structure.call_edges(rows).select("from_path", "to_path").distinct()
    seen = entries.select("entry", F.col("entry").alias("path"), F.lit(0).alias("depth"))
    frontier = seen
    for level in range(1, depth + 1):
        reached = frontier.join(calls, F.col("path") == F.col("from_path")).select("entry", F.col("to_path").alias("path")).distinct()
        frontier = reached.join(seen, ["entry", "path"], "left_anti").withColumn("depth", F.lit(level))
        seen = seen.unionByName(frontier)
    ranked = seen.withColumn("__n", F.row_number().over(Window.partitionBy("entry").orderBy("depth", "path")))
    return ranked.filter(F.col("__n") <= steps).drop("__n")


def directory_graph(rows: DataFrame, focus: str = "") -> tuple[DataFrame, DataFrame]:
    """One level below a directory: nodes (node, files, lines, definitions) and edges (source, target, weight, ambiguous)."""
    prefix = focus.rstrip("/") + "/" if focus else ""

    def node(column: str):
        rest = F.substring(F.col(column), F.lit(len(prefix) + 1), F.length(column))
        return F.when(F.col(column).startswith(prefix) if prefix else F.lit(True), F.concat(F.lit(prefix), F.split(rest, "/")[0]))

    files = structure.files(rows).withColumn("node", node("path")).filter("node is not null")
    defs = structure.definitions(rows).withColumn("node", node("path")).groupBy("node").agg(F.count("*").alias("definitions"))
    nodes = files.groupBy("node").agg(F.count("*").alias("files"), F.sum("lines").alias("lines")).join(defs, "node", "left").fillna(0, ["definitions"])
    links = structure.call_edges(rows).select("from_path", "to_path", "ambiguous").unionByName(structure.dependency_edges(structure.imports(rows)).withColumn("ambiguous", F.lit(False)))
    edges = links.select(node("from_path").alias("source"), node("to_path").alias("target"), "ambiguous").filter("source <> target")
    return nodes, edges.groupBy("source", "target").agg(F.count("*").alias("weight"), F.max("ambiguous").alias("ambiguous"))


def auto_focus(rows: DataFrame, deepest: int = 6) -> str:
    """The directory below which a tree first branches, at most so many levels down."""
    parts = structure.files(rows).select(F.split("path", "/").alias("p"))
    focus: list[str] = []
    for _ in range(deepest):
        n = len(focus)
        names = parts.select(F.get("p", F.lit(n)).alias("name"), (F.size("p") > n + 1).alias("dir")).distinct().limit(2).collect()
        if len(names) != 1 or not names[0]["dir"]:
            break
        focus.append(names[0]["name"])
    return "/".join(focus)


def overview(rows: DataFrame, entries: int = 50, modules: int = 25) -> tuple[DataFrame, DataFrame]:
    """The first entry points, and the modules with the most files, ties by path."""
    m = rollups.module_rollup(structure.files(rows))
    return structure.entry_points(rows).limit(entries), m.orderBy(F.desc("files"), "module").limit(modules)


def callees(edges: DataFrame, path: str, offset: int = 0, limit: int = 20) -> DataFrame:
    """A page of the files that a file calls, those that call most themselves first, with their number in all."""
    out = edges.groupBy("from_path").agg(F.count_distinct("to_path").alias("fan_out"))
    mine = edges.filter(F.col("from_path") == path).select(F.col("to_path").alias("path")).distinct()
    j = mine.join(out, F.col("path") == F.col("from_path"), "left").select("path", F.coalesce("fan_out", F.lit(0)).alias("fan_out"))
    total = j.count()
    return j.orderBy(F.desc("fan_out"), "path").offset(offset).limit(limit).withColumns({"total": F.lit(total), "has_more": F.lit(offset + limit < total)})


def diagram(rows: DataFrame, cap: int = 40) -> DataFrame:
    """A flowchart of the files with the most calls and imports."""
    links = structure.call_edges(rows).select("from_path", "to_path").unionByName(structure.dependency_edges(structure.imports(rows))).distinct()
    nodes, edges = graph.hubs(links.select(F.concat_ws(">", "from_path", "to_path").alias("id"), F.col("from_path").alias("source"), F.col("to_path").alias("target")), cap)
    return graph.mermaid(nodes.select("id"), edges)
