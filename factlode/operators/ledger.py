"""The append-only ledger: blobs, changes, revisions, tombstones and staleness."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def null_safe(a: str, b: str, keys: Sequence[str]) -> Column:
    """Equality of key columns of two aliases, null equal to null."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def dedup_blobs(rows: DataFrame, content: str, key: str) -> DataFrame:
    """One row for each content: sha256, first_key, copies, n_bytes. The map side already merges copies."""
    hashed = rows.select(F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256).alias("sha256"), F.col(key).alias("k"), F.octet_length(F.coalesce(F.col(content), F.lit(""))).cast("long").alias("n"))
    return hashed.groupBy("sha256").agg(F.min("k").alias("first_key"), F.count("*").alias("copies"), F.max("n").alias("n_bytes"))


def damaged_blobs(blobs: DataFrame) -> DataFrame:
    """Blobs (hash, content) whose bytes don't have their digest."""
    return blobs.filter(~F.sha2("content", 256).eqNullSafe(F.col("hash")))


def change_detection(previous: DataFrame, current: DataFrame, keys: Sequence[str], digest: str, state: str | None = None) -> DataFrame:
    """Class of each key: new, changed, unchanged, removed or reactivated.

    previous and current: keys and digest; previous may have a state column, whose 'removed' rows count as
    absent: they are reactivated if they come back, and stay out of the result if not.
    """
    p = previous.select(*keys, F.col(digest).alias("before"), (F.col(state) if state else F.lit("active")).alias("was"))
    c = current.select(*keys, F.col(digest).alias("after"))
    j = p.alias("p").join(c.alias("c"), null_safe("p", "c", keys), "full_outer")
    gone = F.col("p.was") == "removed"
    change = (
        F.when(F.col("p.was").isNull(), "new")
        .when(F.col("c.after").isNull() & gone, None)
        .when(F.col("c.after").isNull(), "removed")
        .when(gone, "reactivated")
        .when(F.col("p.before") == F.col("c.after"), "unchanged")
        .otherwise("changed")
    )
    return j.select(*[F.coalesce(F.col(f"p.{k}"), F.col(f"c.{k}")).alias(k) for k in keys], change.alias("change")).filter("change is not null")


def revision_sequence(observed: DataFrame, asset: str, order: Sequence[str], content: str) -> DataFrame:
    """Revisions of assets: one for each change of content, numbered from 1, with the one that it supersedes.

    A content that comes back after another one is a new revision. Adds sequence, revision_id and supersedes.
    """
    w = Window.partitionBy(asset).orderBy(*order)
    changed = observed.withColumn("__before", F.lag(F.struct(content)).over(w)).filter(F.col("__before").isNull() | ~F.col(f"__before.{content}").eqNullSafe(F.col(content))).drop("__before")
    numbered = changed.withColumn("sequence", F.row_number().over(w).cast("long"))
    numbered = numbered.withColumn("revision_id", F.concat_ws("@", F.col(asset).cast("string"), F.col("sequence").cast("string")))
    return numbered.withColumn("supersedes", F.lag("revision_id").over(w))


def current_revisions(revisions: DataFrame, asset: str) -> DataFrame:
    """The revision with the highest sequence of each asset; the partial maximum runs before the shuffle."""
    others = [c for c in revisions.columns if c != asset]
    top = revisions.groupBy(asset).agg(F.max_by(F.struct(*others), "sequence").alias("r"))
    return top.select(asset, "r.*")


def tombstones(known: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Known rows without a present one."""
    return known.alias("k").join(present.select(*keys).distinct().alias("p"), null_safe("k", "p", keys), "left_anti")


def upsert(existing: DataFrame, fresh: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fresh rows, and existing rows without a fresh one."""
    return fresh.unionByName(tombstones(existing, fresh, keys).select(*fresh.columns))


def staleness(bindings: DataFrame, claims: DataFrame, relations: DataFrame, entities: DataFrame, current: DataFrame) -> dict[str, DataFrame]:
    """Status of graph rows after sources moved on, in the order bindings, claims, relations, entities.

    bindings: (binding_id, entity_id, revision_id, status); claims: (claim_id, entity_id, revision_id, status); relations: (relation_id,
    source_id, target_id, revision_id, status); entities: (entity_id, status); current: (revision_id). 'active' rows whose
    revision isn't current become 'stale', 'stale' rows whose revision is current again revive; other states stay.
    A null revision is always current. Relations read the entities' status before the pass. An entity is stale if it
    has bindings and none is active.
    """
    now = current.select(F.col("revision_id").alias("__r")).distinct().withColumn("__now", F.lit(True))

    def judged(df: DataFrame) -> DataFrame:
        return df.join(now, F.col("revision_id") == F.col("__r"), "left").withColumn("__now", F.coalesce("__now", F.col("revision_id").isNull())).drop("__r")

    def moved(status: Column, fine: Column) -> Column:
        return F.when((status == "active") & ~fine, "stale").when((status == "stale") & fine, "active").otherwise(status)

    b = judged(bindings).withColumn("status", moved(F.col("status"), F.col("__now"))).drop("__now")
    c = judged(claims).withColumn("status", moved(F.col("status"), F.col("__now"))).drop("__now")
    live = entities.select(F.col("entity_id").alias("__e"), (F.col("status") == "active").alias("__live"))
    r = judged(relations)
    for end in ("source_id", "target_id"):
        r = r.join(live, F.col(end) == F.col("__e"), "left").withColumn("__now", F.col("__now") & F.coalesce("__live", F.lit(False))).drop("__e", "__live")
    r = r.withColumn("status", moved(F.col("status"), F.col("__now"))).drop("__now")
    held = b.groupBy(F.col("entity_id").alias("__e")).agg(F.max(F.col("status") == "active").alias("__any"))
    e = entities.join(held, F.col("entity_id") == F.col("__e"), "left")
    e = e.withColumn("status", moved(F.col("status"), F.coalesce("__any", F.lit(True)))).drop("__e", "__any")
    return {"bindings": b, "claims": c, "relations": r, "entities": e}


def import_decision(incoming: DataFrame, assets: DataFrame) -> DataFrame:
    """What becomes of incoming files (name, digest, key, default_key): duplicate, new_revision, new_asset or possible_revision.

    assets: (asset_key, digest) of current contents. Rules in order: the same bytes anywhere; an explicit key that
    exists; an explicit key that doesn't; the default key exists; else a new asset.
    """
    same = assets.groupBy("digest").agg(F.min("asset_key").alias("__dup"))
    keys = assets.select(F.col("asset_key")).distinct()
    out = incoming.join(same, "digest", "left")
    out = out.join(keys.select(F.col("asset_key").alias("__own")), F.col("key") == F.col("__own"), "left")
    out = out.join(keys.select(F.col("asset_key").alias("__by_name")), F.col("default_key") == F.col("__by_name"), "left")
    decision = (
        F.when(F.col("__dup").isNotNull(), "duplicate")
        .when(F.col("__own").isNotNull(), "new_revision")
        .when(F.col("key").isNotNull(), "new_asset")
        .when(F.col("__by_name").isNotNull(), "possible_revision")
        .otherwise("new_asset")
    )
    return out.withColumn("decision", decision).withColumn("asset_key", F.coalesce("__dup", "key", "default_key")).drop("__dup", "__own", "__by_name")
