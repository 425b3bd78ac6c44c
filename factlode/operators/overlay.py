"""Before and after: changed ranges, segment classes, overlays on a base, impact and risk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Risk levels in ascending order.
LEVELS = ("info", "low", "medium", "high", "critical")
HUNK = r"(?m)^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def hunk_ranges(patches: DataFrame) -> DataFrame:
    """Ranges of unified diffs (file, patch): (file, side, start, count). Sides of no lines are left out; a patch with a malformed header gives one row of side 'error'."""
    groups = [F.regexp_extract_all("patch", F.lit(HUNK), F.lit(i)) for i in range(1, 5)]
    broken = F.size(F.regexp_extract_all("patch", F.lit(r"(?m)^@@.*$"), F.lit(0))) != F.size(groups[0])
    number = lambda a, i: F.coalesce(F.try_element_at(a, i + 1).try_cast("int"), F.lit(1))
    sides = F.flatten(F.transform(groups[0], lambda _, i: F.array(
        F.struct(F.lit("before").alias("side"), number(groups[0], i).alias("start"), number(groups[1], i).alias("count")),
        F.struct(F.lit("after").alias("side"), number(groups[2], i).alias("start"), number(groups[3], i).alias("count")),
    )))
    bad = F.array(F.struct(F.lit("error").alias("side"), F.lit(0).alias("start"), F.lit(0).alias("count")))
    out = patches.select("file", F.explode(F.when(broken, bad).otherwise(sides)).alias("r")).select("file", "r.*")
    return out.filter((F.col("count") > 0) | (F.col("side") == "error"))


def segment_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], ranges: DataFrame | None = None, asset: str = "asset") -> DataFrame:
    """Class of each segment: deleted, added, modified, moved, context-changed, unchanged.

    Segments have keys, path, start_line, end_line and hash. ranges (asset, start, count) are changed lines of the
    after side; a segment with the same hash that one touches is context-changed.
    """
    b, a = before.alias("b"), after.alias("a")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"b.{k}") == F.col(f"a.{k}"))
    j = b.join(a, same, "full_outer").select(
        *[F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in keys], F.col("b.hash").alias("bh"), F.col("a.hash").alias("ah"), F.col("b.path").alias("bp"), F.col("a.path").alias("ap"),
        F.col("a.start_line").alias("s"), F.col("a.end_line").alias("e"),
    )
    touched = F.lit(False)
    if ranges is not None:
        listed = ranges.groupBy(F.col(asset).alias("__asset")).agg(F.collect_list(F.struct("start", "count")).alias("__ranges"))
        j = j.join(listed, F.col(asset) == F.col("__asset"), "left")
        touched = F.coalesce(F.exists("__ranges", lambda r: (r["count"] > 0) & (r["start"] <= F.col("e")) & (r["start"] + r["count"] - 1 >= F.col("s"))), F.lit(False))
    change = (
        F.when(F.col("ah").isNull(), "deleted").when(F.col("bh").isNull(), "added").when(F.col("bh") != F.col("ah"), "modified")
        .when(F.col("bp") != F.col("ap"), "moved").when(touched, "context-changed").otherwise("unchanged")
    )
    return j.select(*keys, F.col("bp").alias("path_before"), F.col("ap").alias("path_after"), change.alias("change"))


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files (path, digest) of two snapshots: (path_before, path_after, change): added, deleted, modified, renamed, unchanged.

    A deleted and an added file of one digest are a rename, paired in order of path.
    """
    b, a = before.alias("b"), after.alias("a")
    j = b.join(a, F.col("b.path") == F.col("a.path"), "full_outer").select(F.col("b.path").alias("path_before"), F.col("a.path").alias("path_after"), F.col("b.digest").alias("bd"), F.col("a.digest").alias("ad"))
    from pyspark.sql import Window

    gone = j.filter("path_after is null").withColumn("n", F.row_number().over(Window.partitionBy("bd").orderBy("path_before")))
    new = j.filter("path_before is null").withColumn("n", F.row_number().over(Window.partitionBy("ad").orderBy("path_after")))
    pairs = gone.alias("g").join(new.alias("w"), (F.col("g.bd") == F.col("w.ad")) & (F.col("g.n") == F.col("w.n")), "full_outer")
    moved = pairs.select(F.col("g.path_before").alias("path_before"), F.col("w.path_after").alias("path_after"), F.when(F.col("g.bd").isNull(), "added").when(F.col("w.ad").isNull(), "deleted").otherwise("renamed").alias("change"))
    stayed = j.filter("path_before is not null and path_after is not null").select("path_before", "path_after", F.when(F.col("bd") == F.col("ad"), "unchanged").otherwise("modified").alias("change"))
    return stayed.unionByName(moved)


def masked_paths(changes: DataFrame) -> DataFrame:
    """Paths whose base content an overlay hides: both of changed files, the old one of renames."""
    each = F.when(F.col("change").isin("deleted", "modified", "type-changed"), F.array("path_before", "path_after")).when(F.col("change").isin("renamed", "copied"), F.array("path_before")).otherwise(F.array().cast("array<string>"))
    return changes.select(F.explode(each).alias("path")).filter("path is not null").distinct()


def merge_overlay(base: DataFrame, deltas: DataFrame, key: str) -> DataFrame:
    """Base rows with an overlay on top: removed ones gone, modified ones replaced, added ones there. deltas: base columns and delta."""
    hidden = deltas.select(key).distinct()
    kept = base.join(hidden, key, "left_anti")
    return kept.unionByName(deltas.filter("delta <> 'removed'").select(*base.columns))


def level_rank(level: Column) -> Column:
    """Rank of a level, from 0; null for an unknown one."""
    out = None
    for i, name in enumerate(LEVELS):
        out = F.when(level == name, i) if out is None else out.when(level == name, i)
    return out


def max_level(rows: DataFrame, scope: Sequence[str], level: str) -> DataFrame:
    """The highest level of each scope."""
    top = rows.groupBy(*scope).agg(F.max(level_rank(F.col(level))).alias("__r"))
    return top.select(*scope, F.get(F.array(*[F.lit(x) for x in LEVELS]), F.col("__r")).alias(level))


def risk_of(deltas: DataFrame) -> DataFrame:
    """Risk factors of overlay deltas (entity_type, delta, similarity): adds level.

    A removed requirement is critical; a removed symbol, component, interface or test high; other changes of these and of
    configuration and data models medium; a pure rename low; documents alone info.
    """
    t, d = F.col("entity_type"), F.col("delta")
    code = t.isin("symbol", "component", "interface", "test-case")
    level = (
        F.when((d == "removed") & (t == "requirement"), "critical").when((d == "removed") & code, "high")
        .when((d == "renamed") & (F.col("similarity") == 100), "low")
        .when((d == "modified") & (code | t.isin("requirement", "configuration", "data-model")), "medium")
        .when(t == "document", "info").otherwise("low")
    )
    return deltas.withColumn("level", level)


def impacted(deltas: DataFrame, upstream: DataFrame) -> DataFrame:
    """Requirements and tests that changed entities (entity_id, delta) reach: upstream (start_id, node_id, stage, depth)."""
    return deltas.join(upstream, F.col("entity_id") == F.col("start_id")).groupBy("node_id", "stage").agg(F.min("depth").alias("distance"), F.sort_array(F.collect_set("entity_id")).alias("because"))


def conflict_impact(before: DataFrame, after: DataFrame) -> DataFrame:
    """Conflicts (dedup_key) of two sides: introduced, resolved or persisting."""
    j = before.select(F.col("dedup_key").alias("b")).distinct().join(after.select(F.col("dedup_key").alias("a")).distinct(), F.col("a") == F.col("b"), "full_outer")
    return j.select(F.coalesce("a", "b").alias("dedup_key"), F.when(F.col("b").isNull(), "introduced").when(F.col("a").isNull(), "resolved").otherwise("persisting").alias("impact"))


def ancestors(commits: DataFrame, heads: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(head, commit) of all commits (commit, parent) that lead to the heads (head), themselves included.

    The reach doubles each round, so a history of n commits in a row takes about log2(n) rounds.
    """
    from ..session import cut

    links = commits.filter("parent is not null").select("commit", "parent").distinct()
    seen = heads.select("head", F.col("head").alias("commit")).distinct()
    steps = links.select(F.col("commit").alias("a"), F.col("parent").alias("b"))
    count = seen.count()
    for _ in range(max_rounds):
        seen = cut(seen.unionByName(seen.join(steps, F.col("commit") == F.col("a")).select("head", F.col("b").alias("commit"))).distinct())
        now = seen.count()
        if now == count:
            return seen
        count = now
        longer = steps.alias("x").join(steps.alias("y"), F.col("x.b") == F.col("y.a")).select(F.col("x.a").alias("a"), F.col("y.b").alias("b"))
        steps = cut(steps.unionByName(longer).distinct())
    raise RuntimeError(f"no end after {max_rounds} rounds")


def reconcile(overlays: DataFrame, commits: DataFrame) -> DataFrame:
    """Overlays (overlay_id, head, target, clean) with their state: merged if the head is among the target's ancestors and the tree is clean, else ready."""
    reach = ancestors(commits, overlays.select(F.col("target").alias("head")).distinct())
    hit = reach.select(F.col("head").alias("target"), F.col("commit").alias("head")).withColumn("__in", F.lit(True))
    j = overlays.join(hit, ["target", "head"], "left")
    return j.select("overlay_id", F.when(F.col("__in") & F.col("clean"), "merged").otherwise("ready").alias("state"))
