"""Conflicts between typed facts, and their reconciliation with stored ones.

facts: (fact_id, entity_id, subject, property, value_num, value_str, value_bool, unit, value_type, authority, source_kind).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import facts as fx

#: Pairs kept of one comparable key.
PAIRS = 50


def extract(statements: DataFrame) -> DataFrame:
    """Facts of statements (claim_id, entity_id, authority, source_kind, statement): one row each, the subject falling back to the entity."""
    f = statements.select("claim_id", "entity_id", "authority", "source_kind", F.posexplode(fx.facts(F.col("statement"))).alias("n", "f"))
    return f.select(F.concat_ws("#", "claim_id", F.col("n").cast("string")).alias("fact_id"), "entity_id", "authority", "source_kind", F.coalesce("f.subject", "entity_id").alias("subject"), *[f"f.{c}" for c in ("property", "value_num", "value_str", "value_bool", "unit", "value_type", "raw")])


def _value_key() -> Column:
    return F.concat_ws("|", "value_type", "unit", F.col("value_num").cast("string"), "value_str", F.col("value_bool").cast("string"))


def statement_pairs(facts: DataFrame, per_key: int = PAIRS) -> DataFrame:
    """Pairs of comparable facts of one subject and property that differ: (subject, property, a, b), a < b.

    Equal values of a key are represented by their least fact, so a hot key costs as many rows as it has values.
    At most per_key pairs of a key are kept, the least ids first.
    """
    rep = facts.groupBy("subject", "property", "value_type", "unit", "value_num", "value_str", "value_bool").agg(F.min("fact_id").alias("fact_id"))
    a, b = rep.alias("a"), rep.alias("b")
    pairs = a.join(b, (F.col("a.subject") == F.col("b.subject")) & (F.col("a.property") == F.col("b.property")) & (F.col("a.fact_id") < F.col("b.fact_id")))
    pairs = pairs.filter(fx.compare("a", "b") == "different").select(F.col("a.subject").alias("subject"), F.col("a.property").alias("property"), F.col("a.fact_id").alias("a"), F.col("b.fact_id").alias("b"))
    ranked = pairs.withColumn("__n", F.row_number().over(Window.partitionBy("subject", "property").orderBy("a", "b")))
    return ranked.filter(F.col("__n") <= per_key).drop("__n")


def sided_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Facts of one side that differ from those of the other under one key: documented against actual, authoritative against all."""
    a, b = left.alias("a"), right.alias("b")
    pairs = a.join(b, (F.col("a.subject") == F.col("b.subject")) & (F.col("a.property") == F.col("b.property")) & (F.col("a.fact_id") != F.col("b.fact_id")))
    return pairs.filter(fx.compare("a", "b") == "different").select(F.col("a.subject").alias("subject"), F.col("a.property").alias("property"), F.col("a.fact_id").alias("a"), F.col("b.fact_id").alias("b"))


def specification_code(facts: DataFrame) -> DataFrame:
    """Documented facts that differ from those of code or configuration."""
    return sided_pairs(facts.filter("source_kind = 'document'"), facts.filter("source_kind = 'code'"))


def authoritative(facts: DataFrame) -> DataFrame:
    """Authoritative facts that any other differs from."""
    return sided_pairs(facts.filter("authority = 'authoritative'"), facts)


def related(facts: DataFrame, relations: DataFrame, types: list[str]) -> DataFrame:
    """Facts of related entities (relations source -> target of the types) with one property that differ."""
    r = relations.filter(F.col("type").isin(types)).select("source", "target").distinct()
    a = facts.alias("a").join(r.alias("r"), F.col("a.entity_id") == F.col("r.source"))
    pairs = a.join(facts.alias("b"), (F.col("r.target") == F.col("b.entity_id")) & (F.col("a.property") == F.col("b.property")))
    return pairs.filter(fx.compare("a", "b") == "different").select(F.col("a.entity_id").alias("subject"), F.col("a.property").alias("property"), F.col("a.fact_id").alias("a"), F.col("b.fact_id").alias("b")).distinct()


def related_by_hops(facts: DataFrame, relations: DataFrame, hops: list[list[str]]) -> DataFrame:
    """As related(), over a chain of relations, each hop with its own types."""
    walked = None
    for types in hops:
        step = relations.filter(F.col("type").isin(types)).select("source", "target").distinct()
        walked = step if walked is None else walked.alias("w").join(step.alias("s"), F.col("w.target") == F.col("s.source")).select("w.source", "s.target").distinct()
    return related(facts, walked.withColumn("type", F.lit("path")), ["path"])


def interface_methods(facts: DataFrame) -> DataFrame:
    """Paths that are given with several methods: (subject, methods)."""
    m = facts.filter("property = 'http-method'").groupBy("subject").agg(F.sort_array(F.collect_set("value_str")).alias("methods"))
    return m.filter(F.size("methods") > 1)


def dedup_key(category: Column, subject: Column, prop: Column, ids: Column) -> Column:
    """Identity of a conflict: its category, subject, property and objects in any order."""
    return F.sha2(F.concat_ws("\x1e", category, subject, prop, F.array_join(F.array_sort(ids), "\x1e")).cast("binary"), 256)


def reconcile(detected: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """What a scan does to conflicts: (dedup_key, action).

    detected: (dedup_key, fingerprint, subject_key); stored: (dedup_key, fingerprint, subject_key, status, expires_at). subject_key names
    category, subject, property and detector. The same key and fingerprint: dismissed is suppressed, resolved and stale reopen, else
    observed. The same key with another fingerprint supersedes, as does a new key whose subject_key has a live conflict; any
    other is created. Stored and not detected: open and under-review become stale; accepted risk whose time is over
    reopens; the rest stays out.
    """
    d, s = detected.alias("d"), stored.alias("s")
    j = d.join(s, F.col("d.dedup_key") == F.col("s.dedup_key"), "full_outer")
    live = stored.filter(F.col("status").isin("open", "under-review", "accepted-risk", "stale")).select(F.col("subject_key").alias("__sk")).distinct().withColumn("__live", F.lit(True))
    j = j.join(live, F.col("d.subject_key") == F.col("__sk"), "left")
    both = F.col("d.dedup_key").isNotNull() & F.col("s.dedup_key").isNotNull()
    status = F.col("s.status")
    action = (
        F.when(both & (F.col("d.fingerprint") != F.col("s.fingerprint")), "supersede")
        .when(both & (status == "dismissed"), "suppress")
        .when(both & status.isin("resolved", "stale"), "reopen")
        .when(both, "observe")
        .when(F.col("s.dedup_key").isNull() & F.col("__live").isNotNull(), "supersede")
        .when(F.col("s.dedup_key").isNull(), "create")
        .when(status.isin("open", "under-review"), "stale")
        .when((status == "accepted-risk") & F.coalesce(F.col("s.expires_at") < now, F.lit(False)), "reopen")
    )
    return j.select(F.coalesce("d.dedup_key", "s.dedup_key").alias("dedup_key"), action.alias("action")).filter("action is not null")


# The states that a conflict may move to.
LIFECYCLE = {
    "open": ("under-review", "accepted-risk", "resolved", "dismissed"),
    "under-review": ("open", "accepted-risk", "resolved", "dismissed"),
    "accepted-risk": ("open", "resolved"),
    "resolved": ("open",),
    "dismissed": ("open",),
    "stale": ("open", "resolved", "dismissed"),
}


def transition(conflicts: DataFrame, requests: DataFrame) -> DataFrame:
    """Apply requested states (conflict_id, to): adds the new status and whether the request was accepted."""
    allowed = F.create_map(*[x for k, v in LIFECYCLE.items() for x in (F.lit(k), F.array(*[F.lit(s) for s in v]))])
    j = conflicts.join(requests.select("conflict_id", F.col("to").alias("__to")), "conflict_id", "left")
    ok = F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("status")), F.col("__to")), F.lit(False))
    return j.withColumn("accepted", F.when(F.col("__to").isNotNull(), ok)).withColumn("status", F.when(ok, F.col("__to")).otherwise(F.col("status"))).drop("__to")
