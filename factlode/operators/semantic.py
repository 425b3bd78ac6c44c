"""The deterministic work around model calls: targets, caches, budgets, pairs, quotes, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx


def input_hash(task: Column, revision: Column, segment: Column) -> Column:
    """Identity of a unit of work."""
    return F.sha2(F.concat_ws("\x1f", task, revision, segment).cast("binary"), 256)


def plan(tasks: DataFrame, assets: DataFrame, segments: DataFrame, cache: DataFrame, cap: int = 5000) -> tuple[DataFrame, DataFrame]:
    """Targets of an analysis and what was left out.

    tasks: (task, asset_type, segment_type, tier); assets: (asset_id, asset_type, state, revision_id); segments: (revision_id,
    segment_id, segment_type, content); cache: (task, input_hash). Targets: (task, segment_id, input_hash, tokens, cached, tier);
    exclusions: (asset_id, reason). At most cap targets, by task and segment.
    """
    live = assets.filter("state = 'active'")
    wanted = live.join(tasks.select("asset_type").distinct(), "asset_type", "left_semi")
    reasons = assets.filter("state <> 'active' or state is null").select("asset_id", F.lit("inactive").alias("reason"))
    reasons = reasons.unionByName(live.join(tasks.select("asset_type").distinct(), "asset_type", "left_anti").select("asset_id", F.lit("no-task").alias("reason")))
    t = wanted.join(tasks, "asset_type").join(segments, ["revision_id", "segment_type"])
    t = t.select("task", "segment_id", "tier", input_hash(F.col("task"), F.col("revision_id").cast("string"), F.col("segment_id").cast("string")).alias("input_hash"), tx.token_estimate(F.col("content")).alias("tokens"))
    t = t.orderBy("task", "segment_id").limit(cap)
    hits = cache.select("task", "input_hash").distinct().withColumn("cached", F.lit(True))
    return t.join(hits, ["task", "input_hash"], "left").withColumn("cached", F.coalesce("cached", F.lit(False))), reasons


def plan_totals(targets: DataFrame) -> DataFrame:
    """Requests, tokens, strong requests and cache hits of a plan."""
    return targets.agg(
        F.count_if(~F.col("cached")).alias("requests"), F.coalesce(F.sum(F.when(~F.col("cached"), F.col("tokens"))), F.lit(0)).alias("tokens"),
        F.count_if(~F.col("cached") & (F.col("tier") == "strong")).alias("strong"), F.count_if("cached").alias("cache_hits"),
    )


def pending(targets: DataFrame, done: DataFrame) -> DataFrame:
    """Targets without a result: what a resumed run still has to do."""
    return targets.join(done.select("task", "input_hash").distinct(), ["task", "input_hash"], "left_anti")


def cost(tokens_in: Column, tokens_out: Column, cached: Column, rate_in: Column, rate_out: Column, rate_cached: Column) -> Column:
    """Estimated cost at rates per million tokens, to six places; null where a rate is unknown."""
    return F.bround((F.greatest(tokens_in - cached, F.lit(0)) * rate_in + tokens_out * rate_out + cached * rate_cached) / F.lit(1e6), 6)


def authorize(requests: DataFrame) -> DataFrame:
    """Adds reason, null where a request may leave: (classification, cap, remote, allow_remote, has_credential)."""
    order = F.create_map(F.lit("public"), F.lit(0), F.lit("internal"), F.lit(1), F.lit("confidential"), F.lit(2), F.lit("restricted"), F.lit(3))
    rank = lambda c: F.coalesce(F.try_element_at(order, F.col(c)), F.lit(3))
    reason = F.when(F.col("remote") & ~F.col("allow_remote"), "remote-not-allowed").when(rank("classification") > rank("cap"), "classification").when(F.col("remote") & ~F.col("has_credential"), "no-credential")
    return requests.withColumn("reason", reason)


def merge_budgets(defaults: DataFrame, policy: DataFrame, overrides: DataFrame) -> DataFrame:
    """Limits (name, value): the policy's over the defaults; an override counts only if it tightens. Adds refused."""
    j = defaults.alias("d").join(policy.alias("p"), "name", "left").join(overrides.alias("o"), "name", "left")
    base = F.coalesce(F.col("p.value"), F.col("d.value"))
    tighter = F.col("o.value") <= base
    return j.select("name", F.when(tighter, F.col("o.value")).otherwise(base).alias("value"), F.coalesce(~tighter, F.lit(False)).alias("refused"))


def pairs(rows: DataFrame, key: str, limit: int, per_key: int = 40) -> DataFrame:
    """Unordered pairs (a, b), a < b, of rows (id, key) with one key: the least `limit` of them.

    Only the least members of a key can be in the least pairs, so a hot key gives at most per_key members.
    """
    few = rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy("id"))).filter(F.col("__n") <= max(per_key, limit) + 1)
    a, b = few.alias("a"), few.alias("b")
    joined = a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}")) & (F.col("a.id") < F.col("b.id")))
    return joined.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct().orderBy("a", "b").limit(limit)


def verify_quotes(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Claims (claim_id, evidence_id, quote) against evidence (evidence_id, text): status by claim.

    verified if every quote stands in its evidence, white space and case aside; partial if some do; else failed.
    """
    j = claims.join(evidence.select("evidence_id", F.col("text").alias("__t")), "evidence_id", "left")
    found = F.coalesce((tx.collapse(F.col("quote")) != "") & tx.collapse(F.col("__t")).contains(tx.collapse(F.col("quote"))), F.lit(False))
    sums = j.withColumn("__ok", found).groupBy("claim_id").agg(F.count("*").alias("quotes"), F.count_if("__ok").alias("found"))
    return sums.withColumn("status", F.when(F.col("found") == F.col("quotes"), "verified").when(F.col("found") > 0, "partial").otherwise("failed"))


def find_quotes(quotes: DataFrame, docs: DataFrame, key: str, gram: int = 3) -> DataFrame:
    """Documents that hold each quote (quote_id, quote), white space and case aside: (quote_id, docs, first_doc, status).

    Candidates share the quote's rarest-looking run of whole words (its longest words in a row) and are then compared in full; a quote
    of fewer words than a run is compared by its first word's piece.
    """
    q = quotes.select("quote_id", tx.collapse(F.col("quote")).alias("q"))
    inner = F.filter(F.split("q", " "), lambda w: w != "")
    # the first and last word may be cut off in the text's words, so whole-word runs come from between them
    body = F.slice(inner, 2, F.greatest(F.size(inner) - 2, F.lit(0)))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(body) - gram, F.lit(0))), lambda i: F.array_join(F.slice(body, i + 1, gram), " "))
    q = q.withColumn("seed", F.when(F.size(body) >= gram, F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"]))
    d = docs.select(key, tx.collapse(F.col("text")).alias("t"))
    starts = F.slice("words", 1, F.greatest(F.size("words") - gram + 1, F.lit(0)))
    grams = F.transform(starts, lambda w, i: F.concat_ws(" ", w, *[F.get(F.col("words"), i + j) for j in range(1, gram)]))
    spread = d.select(key, F.split("t", " ").alias("words")).select(key, F.explode(F.array_distinct(grams)).alias("seed"))
    met = spread.join(q.filter("seed is not null").select("seed", "quote_id"), "seed").select(key, "quote_id").distinct()
    exact = met.join(d, key).join(q, "quote_id").filter(F.col("t").contains(F.col("q"))).select("quote_id", key)
    short = q.filter("seed is null and q <> ''")
    held = d.join(short, F.col("t").contains(F.col("q"))).select("quote_id", key)
    every = exact.unionByName(held).distinct().groupBy("quote_id").agg(F.count("*").alias("docs"), F.min(key).alias("first_doc"))
    out = quotes.select("quote_id").join(every, "quote_id", "left")
    return out.select("quote_id", F.coalesce("docs", F.lit(0)).cast("long").alias("docs"), "first_doc", F.when(F.col("docs") > 0, "verified").otherwise("missing").alias("status"))


def promotion_blocks(candidates: DataFrame, evidence: DataFrame, promoted: DataFrame, kinds: list[str]) -> DataFrame:
    """Every reason that keeps a candidate from promotion; an empty list means it may go.

    candidates: (candidate_id, review, lifecycle, verification, kind, revision_current, evidence_ids).
    """
    known = evidence.select(F.col("evidence_id").alias("__e")).distinct()
    each = candidates.select("candidate_id", F.explode_outer("evidence_ids").alias("__id"))
    lost = each.join(known, F.col("__id") == F.col("__e"), "left").groupBy("candidate_id").agg(F.max(F.col("__id").isNotNull() & F.col("__e").isNull()).alias("__lost"))
    done = promoted.select("candidate_id").distinct().withColumn("__done", F.lit(True))
    j = candidates.join(lost, "candidate_id", "left").join(done, "candidate_id", "left")
    reasons = F.array(
        F.when(~F.col("review").eqNullSafe("confirmed"), "not-confirmed"), F.when(~F.col("lifecycle").eqNullSafe("active"), "not-active"),
        F.when(~F.col("verification").eqNullSafe("verified"), "not-verified"), F.when(~F.coalesce(F.col("kind").isin(kinds), F.lit(False)), "unsupported-kind"),
        F.when(~F.coalesce("revision_current", F.lit(False)), "stale-source"), F.when(F.coalesce(F.size("evidence_ids"), F.lit(0)) <= 0, "no-evidence"),
        F.when(F.col("__lost"), "missing-evidence"), F.when(F.col("__done"), "already-promoted"),
    )
    return j.withColumn("blocked", F.array_compact(reasons)).drop("__lost", "__done")


def confidence(status: Column, key: Column, quote: Column) -> Column:
    """low unless fully verified; high for an identifier-shaped key or a normative quote; else medium."""
    shaped = key.rlike(r"^[A-Z][A-Z0-9]*(-[A-Z0-9]+)+$")
    normative = quote.rlike(r"(?i)\b(must|shall|required|mandatory)\b")
    return F.when(status != "verified", "low").when(shaped | normative, "high").otherwise("medium")
