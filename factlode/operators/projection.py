"""The knowledge graph projected from structure, its text for search, mentions, and stack detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from . import structure
from .filters import matches_glob

# Patterns of mentions in prose by kind.
MENTIONS = {
    "file": r"[A-Za-z0-9_./-]+\.(?:java|kt|py|ts|tsx|js|go|rs|cs|rb|php|sql|yml|yaml|xml|md)\b",
    "requirement": r"\b(?:REQ|FR|NFR|SRS|UC)-[A-Z0-9]+(?:-[A-Z0-9]+)*\b",
    "code-id": r"\b[A-Z][A-Z0-9]+-[0-9]+\b",
    "endpoint": r"\b(?:GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS)\s+/[A-Za-z0-9_\-./{}]*",
    "config": r"\b[a-z][a-z0-9_-]*(?:\.[a-z0-9_-]+){1,}\b",
    "symbol": r"\b(?:[A-Z][a-z0-9]+){2,}\b|\b[a-z]+(?:[A-Z][a-z0-9]+)+\b",
    "table": r"(?i)\b(?:table|from|into|join)\s+[a-z_][a-z0-9_]*\b",
}


def mentions(segments: DataFrame, cap: int = 40) -> DataFrame:
    """(segment_id, kind, mention) in segments (segment_id, content), distinct, at most cap of a segment and kind, the least first."""
    found = None
    for kind, pattern in MENTIONS.items():
        one = segments.select("segment_id", F.lit(kind).alias("kind"), F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(pattern), F.lit(0)))).alias("mention"))
        found = one if found is None else found.unionByName(one)
    ranked = found.withColumn("__n", F.row_number().over(Window.partitionBy("segment_id", "kind").orderBy("mention")))
    return ranked.filter(F.col("__n") <= cap).drop("__n")


def classify_code_id(code: Column) -> Column:
    """requirement, error-code or ticket."""
    return F.when(code.rlike("^(REQ|FR|NFR|SRS|UC)-"), "requirement").when(code.rlike("^(E|ERR|ERROR|EX)[A-Z]*-?[0-9]+$"), "error-code").otherwise("ticket")


def candidates(found: DataFrame, index: DataFrame) -> DataFrame:
    """Mentions joined to what a workspace has (kind, name, target): (segment_id, target, kind, confidence), the best confidence once.

    An equal name is high, an equal last path part or another case medium.
    """
    m = found.select("segment_id", "kind", "mention", F.lower(tx.basename(F.col("mention"))).alias("__k"))
    i = index.select("kind", "name", "target", F.lower(tx.basename(F.col("name"))).alias("__k")).distinct()
    j = m.join(i, ["kind", "__k"])
    rank = F.when(F.col("mention") == F.col("name"), 2).otherwise(1)
    best = j.groupBy("segment_id", "target", "kind").agg(F.max(rank).alias("r"))
    return best.select("segment_id", "target", "kind", F.when(F.col("r") == 2, "high").otherwise("medium").alias("confidence"))


def graph_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entities and relations that structure rows speak for: components, symbols, imports, calls.

    Calls are inferred with medium confidence, low if a symbol is ambiguous.
    """
    comp = structure.files(rows).filter("language is not null").select(F.concat(F.lit("component:"), "path").alias("canonical_key"), F.lit("code-component").alias("entity_type"), F.col("path").alias("display_name"))
    syms = structure.definitions(rows).groupBy("symbol", "path").agg(F.min_by("kind", "line").alias("kind")).select(F.concat(F.lit("symbol:"), "path", F.lit("#"), "symbol").alias("canonical_key"), F.lit("code-symbol").alias("entity_type"), F.col("symbol").alias("display_name"))
    key = lambda c: F.concat(F.lit("component:"), F.col(c))
    holds = structure.definitions(rows).select(key("path").alias("source"), F.concat(F.lit("symbol:"), "path", F.lit("#"), "symbol").alias("target")).distinct().select("source", "target", F.lit("contains").alias("type"), F.lit("explicit").alias("state"), F.lit("high").alias("confidence"), F.array().cast("array<string>").alias("symbols"))
    deps = structure.dependency_edges(structure.imports(rows)).select(key("from_path").alias("source"), key("to_path").alias("target"), F.lit("imports").alias("type"), F.lit("explicit").alias("state"), F.lit("high").alias("confidence"), F.array().cast("array<string>").alias("symbols"))
    calls = structure.call_edges(rows).groupBy("from_path", "to_path").agg(F.sort_array(F.collect_set("symbol")).alias("symbols"), F.max("ambiguous").alias("a"))
    calls = calls.select(key("from_path").alias("source"), key("to_path").alias("target"), F.lit("calls").alias("type"), F.lit("inferred").alias("state"), F.when(F.col("a"), "low").otherwise("medium").alias("confidence"), "symbols")
    return comp.unionByName(syms), holds.unionByName(deps).unionByName(calls)


def entity_text(entities: DataFrame, aliases: DataFrame, claims: DataFrame, most: int = 2000) -> DataFrame:
    """Searchable text of entities: key, name, aliases and the first three claims, cut."""
    a = aliases.groupBy("entity_id").agg(F.array_join(F.sort_array(F.collect_set("alias")), ", ").alias("aliases"))
    c = claims.groupBy("entity_id").agg(F.array_join(F.slice(F.sort_array(F.collect_set("statement")), 1, 3), "\n").alias("claims"))
    out = entities.join(a, "entity_id", "left").join(c, "entity_id", "left")
    return out.select("entity_id", F.substring(F.concat_ws("\n", "canonical_key", "display_name", "aliases", "claims"), 1, most).alias("text"))


def refresh_projection(active: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts (id, text) to embed anew and ids to delete, against stored ones (id, text_hash)."""
    now = active.withColumn("text_hash", tx.sha256_text(F.col("text")))
    todo = now.join(stored.select("id", "text_hash"), ["id", "text_hash"], "left_anti")
    return todo, stored.select("id").join(active.select("id"), "id", "left_anti")


def score_templates(templates: list[dict], dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """Scores of project templates (name, dependencies, languages, markers, floor): (template, score), best first, ties by name.

    3 for a dependency pattern, 2 for the main language, 1 for another one, 2 for a marker file; below the floor (3) none.
    """
    spark = files.sparkSession
    rules = [(t["name"], kind, p, t.get("floor", 3)) for t in templates for kind in ("dependencies", "languages", "markers") for p in t.get(kind, [])]
    table = spark.createDataFrame(rules, "template string, kind string, pattern string, floor int")
    langs = files.groupBy("language").agg(F.count("*").alias("n")).withColumn("main", F.row_number().over(Window.orderBy(F.desc("n"), "language")) == 1)
    by_dep = F.broadcast(table.filter("kind = 'dependencies'"))  # hand-written rules, some dozens
    deps = dependencies.select(F.lower("dependency").alias("d")).distinct().join(by_dep, F.col("d").contains(F.lower(F.col("pattern")))).select("template", "pattern", "floor").distinct().withColumn("points", F.lit(3))
    spoken = table.filter("kind = 'languages'").join(langs, F.lower("pattern") == F.lower("language")).select("template", "pattern", "floor", F.when(F.col("main"), 2).otherwise(1).alias("points"))
    hits = deps.unionByName(spoken)
    for name, kind, pattern, floor in rules:
        if kind == "markers":
            one = files.filter(matches_glob(F.col("path"), pattern)).limit(1).select(F.lit(name).alias("template"), F.lit(pattern).alias("pattern"), F.lit(floor).alias("floor"), F.lit(2).alias("points"))
            hits = hits.unionByName(one)
    return hits.groupBy("template", "floor").agg(F.sum("points").alias("score")).filter("score >= floor").select("template", "score").orderBy(F.desc("score"), "template")


def stale_cases(cases: DataFrame, current: DataFrame) -> DataFrame:
    """Saved cases (case_id, refs: array of path, hash) with whether a referenced file changed or is gone."""
    refs = cases.select("case_id", F.explode_outer("refs").alias("r")).select("case_id", "r.path", "r.hash")
    j = refs.join(current.select("path", F.col("content_hash").alias("__now")), "path", "left")
    old = F.col("path").isNotNull() & ~F.col("hash").eqNullSafe(F.col("__now"))
    return j.groupBy("case_id").agg(F.max(old).alias("stale"), F.sort_array(F.collect_set(F.when(old, F.col("path")))).alias("changed"))


def refresh_plan(last: DataFrame, revision: int, policy: str, engine: str) -> DataFrame:
    """What a refresh must do after the latest run (revision, policy, engine, finished_at): (plan): noop, full or incremental."""
    latest = last.agg(F.max_by(F.struct("revision", "policy", "engine"), "finished_at").alias("r"))
    plan = F.when(F.col("r").isNull() | (F.col("r.policy") != policy) | (F.col("r.engine") != engine), "full").when(F.col("r.revision") == revision, "noop").otherwise("incremental")
    return latest.select(plan.alias("plan"))


def lens_coverage(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """How much of a corpus roles (role, pattern) match: (role, assets, share, overlapping)."""
    hits = None
    for role, pattern in rules:
        one = files.filter(F.col("path").rlike(pattern)).select(F.lit(role).alias("role"), "path")
        hits = one if hits is None else hits.unionByName(one)
    many = hits.groupBy("path").agg(F.count_distinct("role").alias("n"))
    total = files.agg(F.count("*").alias("total"))
    out = hits.distinct().join(many, "path").groupBy("role").agg(F.count("*").alias("assets"), F.count_if(F.col("n") > 1).alias("overlapping"))
    return out.join(F.broadcast(total)).select("role", "assets", F.bround(F.col("assets") / F.col("total"), 3).alias("share"), "overlapping")


def safe_pattern(pattern: str, most: int = 200) -> str | None:
    """Why a user's pattern is refused, none if it is safe: empty, long, with an address, look-behind, back-reference, condition or recursion, or broken."""
    import re

    if not pattern.strip():
        return "empty"
    if len(pattern) > most:
        return "too long"
    if "://" in pattern:
        return "holds an address"
    if re.search(r"\(\?<[=!]|\\[1-9]|\(\?P=|\(\?\(|\(\?R\)|\(\?[0-9]", pattern):
        return "look-behind, back-reference, condition or recursion"
    try:
        re.compile(pattern)
    except re.error:
        return "doesn't compile"
    return None
