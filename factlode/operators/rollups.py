"""Counts, sums and profiles by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def status_counts(rows: DataFrame, status: str) -> DataFrame:
    """Rows by status."""
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def flag_counts(rows: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """One row: total and a count for each named condition; null conditions don't count."""
    return rows.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in flags.items()])


def usage_totals(rows: DataFrame, sums: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Requests and sums; the sum of nothing but nulls stays null."""
    return rows.groupBy(*by).agg(F.count("*").alias("requests"), *[F.sum(c).alias(c) for c in sums])


def share(rows: DataFrame, key: str, weight: str | None = None) -> DataFrame:
    """Groups with their number, weight and share of all rows, to three places."""
    g = rows.groupBy(key).agg(F.count("*").alias("files"), F.sum(F.col(weight) if weight else F.lit(1)).alias("lines"))
    return g.withColumn("share", F.bround(F.col("files") / F.sum("files").over(Window.partitionBy()), 3))


def module_rollup(files: DataFrame, path: str = "path", language: str = "language", lines: str = "lines") -> DataFrame:
    """Directories: files, lines and files by language, as a sorted list of language=count."""
    each = files.select(tx.directory(F.col(path)).alias("module"), F.col(language).alias("language"), F.col(lines).alias("lines"))
    by = each.groupBy("module", "language").agg(F.count("*").alias("n"), F.sum("lines").alias("lines"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("language", "n"))), lambda x: F.concat_ws("=", x["language"], x["n"].cast("string"))), ",")
    return by.groupBy("module").agg(F.sum("n").alias("files"), F.sum("lines").alias("lines"), listed.alias("languages"))


def module_edges(edges: DataFrame, source: str = "from_path", target: str = "to_path") -> DataFrame:
    """Edges between different directories, counted."""
    e = edges.select(tx.directory(F.col(source)).alias("from_module"), tx.directory(F.col(target)).alias("to_module")).filter("from_module <> to_module")
    return e.groupBy("from_module", "to_module").agg(F.count("*").alias("weight"))


def call_graph(calls: DataFrame, definitions: DataFrame, cap: int = 120) -> DataFrame:
    """Calls (path, symbol) joined by name to files that define the symbol: (from_path, to_path, symbol, ambiguous).

    ambiguous: several files define it. A file's own definitions give no edge. At most cap edges of a file, by symbol
    and target.
    """
    owners = definitions.select(F.col("symbol"), F.col("path").alias("to_path")).distinct()
    many = owners.groupBy("symbol").agg((F.count("*") > 1).alias("ambiguous"))
    j = calls.select(F.col("path").alias("from_path"), "symbol").distinct().join(owners, "symbol").join(many, "symbol").filter("from_path <> to_path")
    ranked = j.withColumn("__n", F.row_number().over(Window.partitionBy("from_path").orderBy("symbol", "to_path")))
    return ranked.filter(F.col("__n") <= cap).select("from_path", "to_path", "symbol", "ambiguous")


def top_counts(rows: DataFrame, key: str, limit: int = 50) -> DataFrame:
    """The most frequent keys, ties by key."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(limit)


def score_rules(items: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """Scores of targets by rules (target, pattern, points) whose pattern is part of an item's text: (key, target, score, hits).

    rules are a broadcast table of a few hand-written rows, so the theta join is bounded by the number of items.
    """
    j = items.select(F.col(key), F.lower(F.col(text)).alias("__t")).join(F.broadcast(rules), F.col("__t").contains(F.lower(F.col("pattern"))))
    return j.groupBy(key, "target").agg(F.sum("points").alias("score"), F.count("*").alias("hits"))


def best_target(scored: DataFrame, key: str, floor: int = 3) -> DataFrame:
    """The target of the highest score of at least floor; ties go to the first by name."""
    ok = scored.filter(F.col("score") >= floor)
    return ok.groupBy(key).agg(F.max(F.struct("score")).alias("m")).select(key, F.col("m.score").alias("score")).join(ok, [key, "score"]).groupBy(key, "score").agg(F.min("target").alias("target"))


def integrity(rows: DataFrame, key: str, parents: DataFrame, foreign: str, parent_key: str) -> DataFrame:
    """Findings of a table: (check, findings): repeated keys, null keys, rows without a parent."""
    repeated = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("findings")).select(F.lit("duplicate-key").alias("check"), "findings")
    nulls = rows.agg(F.count_if(F.col(key).isNull()).alias("findings")).select(F.lit("null-key").alias("check"), "findings")
    lost = rows.filter(F.col(foreign).isNotNull()).join(parents.select(F.col(parent_key).alias(foreign)).distinct(), foreign, "left_anti").agg(F.count("*").alias("findings")).select(F.lit("missing-parent").alias("check"), "findings")
    return repeated.unionByName(nulls).unionByName(lost)
