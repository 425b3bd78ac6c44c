"""Evidence: nodes by id, exact text behind a locator, context for a question, answers from the glossary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

# Kinds of nodes in the order in which an id is looked up.
NODE_KINDS = ("entity", "claim", "asset", "revision", "segment", "evidence")


def resolve(ids: DataFrame, nodes: dict[str, DataFrame]) -> DataFrame:
    """(id, kind) of ids by the first kind that has them, null where none has. nodes: frames with an id column by kind."""
    every = None
    for n, kind in enumerate(NODE_KINDS):
        if kind in nodes:
            one = nodes[kind].select("id", F.lit(n).alias("n"), F.lit(kind).alias("kind")).distinct()
            every = one if every is None else every.unionByName(one)
    best = every.groupBy("id").agg(F.min_by("kind", "n").alias("kind"))
    return ids.select("id").distinct().join(best, "id", "left")


def recover(evidence: DataFrame, revisions: DataFrame, blobs: DataFrame, most: int = 4000) -> DataFrame:
    """The exact text of evidence (evidence_id, revision_id, start_line, end_line, content_hash) from stored blobs.

    revisions: (revision_id, blob_hash, current); blobs: (blob_hash, text). Adds excerpt (cut), intact (the hash still holds)
    and source_status: current, superseded, or missing.
    """
    j = evidence.join(revisions, "revision_id", "left").join(blobs, "blob_hash", "left")
    exact = F.when(F.col("text").isNotNull(), tx.slice_lines(F.col("text"), F.col("start_line"), F.col("end_line")))
    out = j.withColumn("__exact", exact)
    status = F.when(F.col("text").isNull(), "missing").when(F.col("current"), "current").otherwise("superseded")
    return out.select("evidence_id", "revision_id", F.substring("__exact", 1, most).alias("excerpt"), F.coalesce(tx.sha256_text(F.col("__exact")) == F.col("content_hash"), F.lit(False)).alias("intact"), status.alias("source_status"))


def verdict(evidence: Column) -> Column:
    """Of an array of evidence states: current if any is, else stale if any is, else missing."""
    return F.when(F.array_contains(evidence, "current"), "current").when(F.array_contains(evidence, "stale"), "stale").otherwise("missing")


def context(targets: DataFrame, segments: DataFrame, glossary: DataFrame, budget: int) -> DataFrame:
    """Text for each target (target_id): its segments (target_id, ordinal, segment_id, content) in order within a budget of characters, with the terms that it holds.

    The first segment over the budget, and all after it, stay out; truncated tells. Terms are matched as whole tokens.
    """
    w = Window.partitionBy("target_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    marked = segments.withColumn("__sum", F.sum(F.char_length("content")).over(w))
    kept = marked.filter(F.col("__sum") <= budget)
    words = kept.select("target_id", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit("[A-Za-z0-9_]+"), F.lit(0)))).alias("term")).distinct()
    terms = words.join(glossary.select("term", "definition"), "term").groupBy("target_id").agg(F.sort_array(F.collect_list(F.concat_ws(": ", "term", "definition"))).alias("terms"))
    body = kept.groupBy("target_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", "content"))), lambda x: x["content"]), "\n").alias("text"), F.sort_array(F.collect_set("segment_id")).alias("segments"))
    more = marked.groupBy("target_id").agg(F.max(F.col("__sum") > budget).alias("truncated"))
    return targets.join(body, "target_id", "left").join(terms, "target_id", "left").join(more, "target_id", "left")


def answer(asked: DataFrame, looked_up: DataFrame) -> DataFrame:
    """Answers to term questions (question_id, term) from a lookup (hit, definition, source_file, line_number, found), verbatim with the source, or that nothing is known."""
    j = asked.select("question_id", "term").join(looked_up.drop("term"), "question_id", "left")
    cited = F.concat_ws("", "hit", F.lit(": "), "definition", F.lit(" ("), "source_file", F.lit(":"), F.col("line_number").cast("string"), F.lit(")"))
    return j.select("question_id", F.when(F.col("found"), cited).otherwise(F.concat(F.lit("No definition of "), "term", F.lit(" was found."))).alias("answer"), F.coalesce("found", F.lit(False)).alias("grounded"))


def scoped(rows: DataFrame, workspaces: list[str] | None, column: str = "workspace_id") -> DataFrame:
    """Rows of the named workspaces, or of all; a filter that partition pruning can use."""
    return rows if workspaces is None else rows.filter(F.col(column).isin(workspaces))


def active_only(hits: DataFrame, assets: DataFrame) -> DataFrame:
    """Hits (asset_id) whose asset is active and indexed."""
    return hits.join(assets.filter("state = 'active' and indexed").select("asset_id").distinct(), "asset_id", "left_semi")
