"""Property graph as two DataFrames: entities (id, ...) and relations (id, source, target, type, ...).

Expansions run level by level with a fixed bound. A level is one join of the frontier with the relations and one
anti join with what has been seen; the lineage is cut every second level. Caps apply under a total order, and
a cut is told.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def usable(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations that aren't rejected and whose two ends are active entities."""
    live = entities.filter("lifecycle = 'active'").select(F.col("id").alias("__live"))
    r = relations.filter("lifecycle <> 'rejected'")
    for end in ("source", "target"):
        r = r.join(live, F.col(end) == F.col("__live"), "left_semi")
    return r


def directed(relations: DataFrame, direction: str = "both", types: Sequence[str] | None = None) -> DataFrame:
    """Steps (from_id, to_id, type, relation_id, direction) along relations."""
    r = relations.filter(F.col("type").isin(list(types))) if types else relations
    out = r.select(F.col("source").alias("from_id"), F.col("target").alias("to_id"), "type", F.col("id").alias("relation_id"), F.lit("outgoing").alias("direction"))
    back = r.select(F.col("target").alias("from_id"), F.col("source").alias("to_id"), "type", F.col("id").alias("relation_id"), F.lit("incoming").alias("direction"))
    return out if direction == "outgoing" else back if direction == "incoming" else out.unionByName(back)


def neighbors(seeds: DataFrame, relations: DataFrame, direction: str = "both", types: Sequence[str] | None = None) -> DataFrame:
    """Steps that leave the seeds (id)."""
    steps = directed(relations, direction, types)
    return steps.join(seeds.select(F.col("id").alias("from_id")).distinct(), "from_id", "left_semi")


def expand(seeds: DataFrame, relations: DataFrame, depth: int = 2, max_nodes: int = 1000, max_edges: int = 3000, direction: str = "both", types: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Breadth-first expansion: nodes (id, depth, truncated) and edges (from_id, to_id, type, relation_id, depth).

    At most max_nodes nodes, the nearest and then the least ids first, and max_edges edges between them, by depth, type, ends and id. truncated
    tells that more nodes were within reach.
    """
    if not 1 <= depth <= 6:
        raise ValueError("depth is 1 to 6")
    steps = directed(relations, direction, types)
    seen = seeds.select("id").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for level in range(1, depth + 1):
        near = steps.join(frontier.select(F.col("id").alias("from_id")), "from_id").select(F.col("to_id").alias("id")).distinct()
        frontier = near.join(seen, "id", "left_anti").withColumn("depth", F.lit(level))
        # one row more than may stay shows that there was more
        frontier = frontier.orderBy("id").limit(max_nodes + 1)
        if level % 2 == 0:
            frontier = cut(frontier)
        seen = seen.unionByName(frontier)
    ranked = seen.orderBy("depth", "id").limit(max_nodes + 1).withColumn("__n", F.row_number().over(Window.orderBy("depth", "id")))
    nodes = cut(ranked.withColumn("truncated", F.max("__n").over(Window.partitionBy()) > max_nodes).filter(F.col("__n") <= max_nodes).drop("__n"))
    inside = directed(relations, "outgoing", types).drop("direction")
    for end, name in (("from_id", "__a"), ("to_id", "__b")):
        inside = inside.join(nodes.select(F.col("id").alias(end), F.col("depth").alias(name)), end)
    edges = inside.withColumn("depth", F.least("__a", "__b")).drop("__a", "__b")
    return nodes, edges.orderBy("depth", "type", "from_id", "to_id", "relation_id").limit(max_edges)


def shortest_paths(relations: DataFrame, source: str, target: str, depth: int = 6, max_paths: int = 5, max_visited: int = 2000, direction: str = "both", types: Sequence[str] | None = None) -> DataFrame:
    """At most max_paths shortest paths: (path, hops, status), status 'found', or one row 'no-path' or 'truncated'.

    Each level keeps the nodes first reached there, with all their predecessors; paths are then read back level by
    level. Nodes beyond max_visited are left out, the least ids first in, and the search is truncated.
    """
    spark = relations.sparkSession
    steps = directed(relations, direction, types).select("from_id", "to_id").distinct()
    kind = relations.schema["source"].dataType
    start = spark.createDataFrame([(source,)], "id string").select(F.col("id").cast(kind).alias("id"))
    if source == target:
        return start.select(F.array("id").alias("path"), F.lit(0).alias("hops"), F.lit("found").alias("status"))
    seen, frontier, levels, visited, truncated = start, start, [], 1, False
    for level in range(1, depth + 1):
        reached = steps.join(frontier.select(F.col("id").alias("from_id")), "from_id").join(seen.select(F.col("id").alias("to_id")), "to_id", "left_anti")
        levels.append(cut(reached))
        fresh = levels[-1].select(F.col("to_id").alias("id")).distinct()
        if levels[-1].filter(F.col("to_id") == F.lit(target).cast(kind)).limit(1).count():
            return _read_back(levels, source, target, kind, max_paths)
        found = fresh.count()
        if not found:
            break
        if visited + found > max_visited:
            truncated = True
            fresh = fresh.orderBy("id").limit(max(0, max_visited - visited))
        visited += found
        frontier = fresh
        seen = cut(seen.unionByName(fresh))
        if truncated and visited > max_visited + found:
            break
        truncated = truncated or level == depth
    status = "truncated" if truncated else "no-path"
    return start.select(F.array().cast(f"array<{kind.simpleString()}>").alias("path"), F.lit(None).cast("int").alias("hops"), F.lit(status).alias("status"))


def _read_back(levels, source, target, kind, max_paths):
    paths = levels[-1].filter(F.col("to_id") == F.lit(target).cast(kind)).select(F.array("from_id", "to_id").alias("path"))
    for step in reversed(levels[:-1]):
        # equally long paths from one node have the same beginnings, so only its max_paths least can be among the least of all
        least = Window.partitionBy(F.element_at("path", 1)).orderBy("path")
        paths = paths.distinct().withColumn("__n", F.row_number().over(least)).filter(F.col("__n") <= max_paths).drop("__n")
        paths = paths.join(step, F.element_at("path", 1) == F.col("to_id")).select(F.concat(F.array("from_id"), "path").alias("path"))
    return paths.distinct().orderBy("path").limit(max_paths).select("path", F.lit(len(levels)).alias("hops"), F.lit("found").alias("status"))


def induced(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations between the nodes (id)."""
    keys = nodes.select("id").distinct()
    out = relations
    for end in ("source", "target"):
        out = out.join(keys.select(F.col("id").alias(end)), end, "left_semi")
    return out


def degrees(relations: DataFrame) -> DataFrame:
    """(id, degree, fan_out, fan_in): relations at each node, and distinct targets and sources. Two partial aggregations, no join."""
    ends = relations.select(F.col("source").alias("id"), F.lit("out").alias("side"), F.col("target").alias("other")).unionByName(relations.select(F.col("target").alias("id"), F.lit("in").alias("side"), F.col("source").alias("other")))
    pairs = ends.groupBy("id", "side", "other").agg(F.count("*").alias("n"))
    return pairs.groupBy("id").agg(F.sum("n").alias("degree"), F.count_if(F.col("side") == "out").alias("fan_out"), F.count_if(F.col("side") == "in").alias("fan_in"))


def hubs(relations: DataFrame, cap: int) -> tuple[DataFrame, DataFrame]:
    """The nodes of highest degree, ties by id, and the relations between them."""
    top = degrees(relations).orderBy(F.desc("degree"), "id").limit(cap)
    return top, induced(top, relations)


def merge_entities(relations: DataFrame, mapping: DataFrame) -> DataFrame:
    """Relations after entities were merged (mapping: old_id, new_id): ends moved, loops dropped, equals kept once, by least id."""
    m = mapping.select("old_id", "new_id")
    r = relations
    for end in ("source", "target"):
        r = r.join(m.select(F.col("old_id").alias(end), F.col("new_id").alias("__new")), end, "left").withColumn(end, F.coalesce("__new", end)).drop("__new")
    others = [c for c in relations.columns if c not in ("source", "target", "type", "id")]
    r = r.filter(F.col("source") != F.col("target"))
    kept = r.groupBy("source", "target", "type").agg(F.min_by(F.struct("id", *others), "id").alias("k"))
    return kept.select("k.id", "source", "target", "type", *[f"k.{c}" for c in others])


def split_entity(relations: DataFrame, entity: str, new_id: str, moved: DataFrame) -> DataFrame:
    """Relations after some of an entity's (moved: relation_id) went to a new one. A listed relation that isn't the entity's is an error."""
    listed = moved.select(F.col("relation_id").alias("id")).distinct()
    touching = relations.filter((F.col("source") == entity) | (F.col("target") == entity))
    if listed.join(touching, "id", "left_anti").limit(1).count():
        raise ValueError("every listed relation must belong to the entity")
    marked = relations.join(listed.withColumn("__moved", F.lit(True)), "id", "left")
    for end in ("source", "target"):
        marked = marked.withColumn(end, F.when(F.col("__moved") & (F.col(end) == entity), F.lit(new_id)).otherwise(F.col(end)))
    return marked.drop("__moved").select(*relations.columns)


def projection_diff(desired: DataFrame, existing: DataFrame, key: str, digest: str, state: str = "state") -> DataFrame:
    """What a projection must do: (key, action), create, update, revive, stale; unchanged keys are left out.

    desired: (key, digest); existing: (key, digest, state), state 'active' or 'stale'.
    """
    d = desired.select(F.col(key).alias("dk"), F.col(digest).alias("dh"))
    e = existing.select(F.col(key).alias("ek"), F.col(digest).alias("eh"), F.col(state).alias("es"))
    j = d.join(e, F.col("dk") == F.col("ek"), "full_outer")
    action = (
        F.when(F.col("ek").isNull(), "create")
        .when(F.col("dk").isNull() & (F.col("es") == "active"), "stale")
        .when(F.col("dk").isNull(), None)
        .when(F.col("es") == "stale", "revive")
        .when(~F.col("dh").eqNullSafe(F.col("eh")), "update")
    )
    return j.select(F.coalesce("dk", "ek").alias(key), action.alias("action")).filter("action is not null")


def mermaid(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A one-row Mermaid flowchart of bounded nodes (id) and edges (source, target)."""
    lines = nodes.select(F.concat(F.lit("  "), F.regexp_replace("id", "[^A-Za-z0-9]", "_"), F.lit('["'), F.replace("id", F.lit('"'), F.lit("'")), F.lit('"]')).alias("line"), F.lit(0).alias("part"))
    arrows = edges.select(F.concat(F.lit("  "), F.regexp_replace("source", "[^A-Za-z0-9]", "_"), F.lit(" --> "), F.regexp_replace("target", "[^A-Za-z0-9]", "_")).alias("line"), F.lit(1).alias("part")).distinct()
    every = lines.unionByName(arrows)
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "line"))), lambda x: x["line"]), "\n")
    return every.agg(F.concat(F.lit("flowchart LR\n"), body).alias("diagram"))
