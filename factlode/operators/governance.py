"""Changes to the knowledge graph as rows: requested states, validated inserts, promotion, and the ledger of decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Closed vocabularies of the graph.
LIFECYCLE = ("active", "stale", "superseded", "withdrawn", "merged")
AUTHORITY = ("unknown", "informational", "authoritative", "non-authoritative")
RELATION_TYPES = (
    "contains supersedes refines implements partially-implements configures calls reads writes publishes consumes verifies evidenced-by "
    "contradicts affected-by derived-from possibly-related"
).split()
# What a decision may do to a lifecycle state.
STATES = {
    "supersede": {"active": "superseded", "stale": "superseded"},
    "withdraw": {"active": "withdrawn", "stale": "withdrawn"},
    "reject-relation": {"active": "rejected", "stale": "rejected"},
    "restore-relation": {"rejected": "active"},
    "confirm": {"unreviewed": "confirmed", "rejected": "confirmed"},
    "reject": {"unreviewed": "rejected", "confirmed": "rejected"},
    "reset": {"confirmed": "unreviewed", "rejected": "unreviewed"},
}


def entity_key(entity_type: Column, name: Column) -> Column:
    """Canonical key: the type and the collapsed name; an identifier keeps its case."""
    shaped = name.rlike(r"^[A-Z][A-Z0-9]*(-[A-Z0-9]+)+$")
    return F.concat_ws(":", entity_type, F.when(shaped, name).otherwise(F.regexp_replace(tx.collapse(name), " ", "-")))


def statement_hash(statement: Column) -> Column:
    """Identity of a statement whatever its white space and case."""
    return F.sha2(tx.collapse(statement).cast("binary"), 256)


def decide(objects: DataFrame, decisions: DataFrame, revision: int, key: str = "id", state: str = "lifecycle") -> tuple[DataFrame, DataFrame]:
    """Objects after decisions (key, decision, actor, note), and the ledger rows of all decisions.

    A decision that the object's state doesn't allow, or without an object, is refused: it stands in the ledger and changes
    nothing. Of several decisions on one object the one that comes first by name counts, the others are refused.
    """
    table = F.create_map(*[x for d, moves in STATES.items() for a, b in moves.items() for x in (F.lit(f"{d}>{a}"), F.lit(b))])
    counted = decisions.groupBy(F.col(key).alias("__k")).agg(F.min("decision").alias("__first"))
    j = decisions.join(objects.select(F.col(key).alias("__k"), F.col(state).alias("before")), F.col(key) == F.col("__k"), "left").drop("__k")
    j = j.join(counted, F.col(key) == F.col("__k"), "left").drop("__k")
    after = F.when(F.col("decision") == F.col("__first"), F.try_element_at(table, F.concat_ws(">", "decision", "before")))
    ledger = j.withColumn("after", F.when(F.col("before").isNotNull(), after)).drop("__first")
    ledger = ledger.withColumns({"accepted": F.col("after").isNotNull(), "knowledge_revision": F.lit(revision).cast("long")})
    moved = ledger.filter("accepted").select(F.col(key).alias("__k"), F.col("after").alias("__after"))
    out = objects.join(moved, F.col(key) == F.col("__k"), "left").withColumn(state, F.coalesce("__after", state)).drop("__k", "__after")
    return out, ledger


def set_authority(entities: DataFrame, requests: DataFrame) -> DataFrame:
    """Entities with requested authority (id, authority); values outside the vocabulary change nothing."""
    r = requests.filter(F.col("authority").isin(list(AUTHORITY))).select(F.col("id").alias("__k"), F.col("authority").alias("__a"))
    return entities.join(r, F.col("id") == F.col("__k"), "left").withColumn("authority", F.coalesce("__a", "authority")).drop("__k", "__a")


def validate_relations(wanted: DataFrame, entities: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds reasons that keep wanted relations (source, target, type, evidence_ids) out; an empty list lets them in."""
    live = entities.filter("lifecycle = 'active'").select(F.col("id").alias("__e")).distinct()
    j = wanted.join(live.withColumn("__s", F.lit(True)), F.col("source") == F.col("__e"), "left").drop("__e")
    j = j.join(live.withColumn("__t", F.lit(True)), F.col("target") == F.col("__e"), "left").drop("__e")
    j = j.join(existing.select("source", "target", "type").distinct().withColumn("__x", F.lit(True)), ["source", "target", "type"], "left")
    reasons = F.array(
        F.when(F.col("__s").isNull(), "unknown-source"), F.when(F.col("__t").isNull(), "unknown-target"), F.when(F.col("source") == F.col("target"), "self-relation"),
        F.when(~F.coalesce(F.col("type").isin(RELATION_TYPES), F.lit(False)), "unknown-type"), F.when(F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0, "no-evidence"), F.when(F.col("__x"), "already-there"),
    )
    return j.withColumn("reasons", F.array_compact(reasons)).drop("__s", "__t", "__x")


def alias_collisions(aliases: DataFrame) -> DataFrame:
    """Aliases (entity_id, alias) that name several entities: (normalized, entities)."""
    n = aliases.select("entity_id", tx.collapse(F.col("alias")).alias("normalized")).distinct()
    return n.groupBy("normalized").agg(F.sort_array(F.collect_set("entity_id")).alias("entities")).filter(F.size("entities") > 1)


def promote(candidates: DataFrame, entities: DataFrame, revision: int) -> tuple[DataFrame, DataFrame]:
    """Entities and claims that eligible candidates (candidate_id, kind, title, statement) become.

    A candidate whose canonical key exists adds its claim to that entity; of several new ones with one key the first makes
    the entity. Ids derive from content, so a second run makes the same rows.
    """
    c = candidates.withColumn("canonical_key", entity_key(F.col("kind"), F.col("title")))
    c = c.withColumn("entity_id", F.concat(F.lit("e_"), F.substring(F.sha1(F.col("canonical_key").cast("binary")), 1, 18)))
    known = entities.select("canonical_key", F.col("entity_id").alias("__own"))
    c = c.join(known, "canonical_key", "left")
    new = c.filter("__own is null").groupBy("entity_id", "canonical_key", F.col("kind").alias("entity_type")).agg(F.min_by("title", "candidate_id").alias("display_name"), F.min("candidate_id").alias("promoted_from"))
    claims = c.select(F.coalesce("__own", "entity_id").alias("entity_id"), "statement", "candidate_id").withColumn("statement_hash", statement_hash(F.col("statement")))
    claims = claims.groupBy("entity_id", "statement_hash").agg(F.min_by("statement", "candidate_id").alias("statement"), F.min("candidate_id").alias("promoted_from"))
    return new.withColumns({"lifecycle": F.lit("active"), "created_revision": F.lit(revision).cast("long")}), claims.withColumn("created_revision", F.lit(revision).cast("long"))


def promote_relations(candidates: DataFrame, promoted: DataFrame) -> DataFrame:
    """Relation candidates (source_candidate, target_candidate, type) whose ends were promoted (candidate_id, entity_id), as relations with derived ids."""
    s = promoted.select(F.col("candidate_id").alias("source_candidate"), F.col("entity_id").alias("source"))
    t = promoted.select(F.col("candidate_id").alias("target_candidate"), F.col("entity_id").alias("target"))
    out = candidates.join(s, "source_candidate").join(t, "target_candidate").filter("source <> target").select("source", "target", "type").distinct()
    return out.withColumn("id", F.concat(F.lit("r_"), F.substring(F.sha1(F.concat_ws("\x1f", "source", "target", "type").cast("binary")), 1, 18)))
