"""Chunks, blobs, revisions, budgets, ranges and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import ledger, windows
from .search import table


def _windows(spark, sf_dir, width, overlap):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.line_windows(F.col("text"), width, overlap)).alias("w"))
    return docs.select("doc_id", "w.*")


def line_windows(spark, sf_dir):
    """Line windows of 40 lines with 5 shared: their borders and sizes."""
    return _windows(spark, sf_dir, 40, 5).select("doc_id", "start_line", "end_line", F.char_length("content").cast("long").alias("chars"))


def line_windows_default(spark, sf_dir):
    """Line windows of the default width: number by document."""
    return _windows(spark, sf_dir, 220, 20).groupBy("doc_id").agg(F.count("*").alias("windows"), F.max("end_line").alias("last_line"))


def segment_hash(spark, sf_dir):
    """SHA-256 of each line window."""
    return _windows(spark, sf_dir, 40, 5).select("doc_id", "start_line", tx.sha256_text(F.col("content")).alias("hash"))


def content_dedup(spark, sf_dir):
    """One row for each distinct text."""
    return ledger.dedup_blobs(table(spark, sf_dir, "documents"), "text", "doc_id")


def chunk_ids(spark, sf_dir):
    """Content-derived chunk ids of line windows."""
    w = _windows(spark, sf_dir, 40, 5)
    return w.select("doc_id", "start_line", tx.chunk_id(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")), F.lit("lines"), F.col("start_line")).alias("chunk_id"))


def _revisions(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return ledger.revision_sequence(events, "user_id", ["ts", "event_id"], "event_type")


def revision_sequence(spark, sf_dir):
    """Revisions of users (assets) by changes of event type (content)."""
    return _revisions(spark, sf_dir).select("user_id", "event_id", "event_type", "sequence", "revision_id", "supersedes")


def current_revision_listing(spark, sf_dir):
    """The latest revision of each user."""
    return ledger.current_revisions(_revisions(spark, sf_dir).select("user_id", "sequence", "revision_id", "event_type"), "user_id")


def change_detection(spark, sf_dir):
    """Changes between two made snapshots of orders: every 7th is missing before, every 11th after, every 5th differs, every 13th was removed before."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    before = o.filter("o_orderkey % 7 <> 0").withColumn("state", F.when(F.col("o_orderkey") % 13 == 0, "removed").otherwise("active"))
    after = o.filter("o_orderkey % 11 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 5 == 0, F.concat("o_orderstatus", F.lit("*"))).otherwise(F.col("o_orderstatus")))
    return ledger.change_detection(before, after, ["o_orderkey"], "o_orderstatus", "state")


def tombstone_prune(spark, sf_dir):
    """Orders without a line item of a made subset."""
    lines = table(spark, sf_dir, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return ledger.tombstones(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), lines, ["o_orderkey"])


def upsert_snapshot(spark, sf_dir):
    """Customers with fresh balances for one segment."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.lit("old").alias("version"))
    fresh = c.filter("c_mktsegment = 'BUILDING'").withColumn("version", F.lit("new"))
    return ledger.upsert(c, fresh, ["c_custkey"])


def staleness_pass(spark, sf_dir):
    """Status of relations (orders to customers) and entities (customers) when only open orders' revisions are current."""
    o = table(spark, sf_dir, "orders")
    state = F.when(F.col("o_orderkey") % 3 == 0, "stale").otherwise("active")
    bindings = o.select(F.col("o_orderkey").alias("binding_id"), F.col("o_custkey").alias("entity_id"), F.concat("o_orderstatus", F.lit("1")).alias("revision_id"), state.alias("status"))
    claims = bindings.withColumnRenamed("binding_id", "claim_id")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("entity_id"), F.when(F.col("c_custkey") % 4 == 0, "stale").otherwise("active").alias("status"))
    relations = o.select(F.col("o_orderkey").alias("relation_id"), F.col("o_custkey").alias("source_id"), F.col("o_custkey").alias("target_id"), F.concat("o_orderstatus", F.lit("1")).alias("revision_id"), state.alias("status"))
    current = spark.createDataFrame([("O1",), ("P1",)], "revision_id string")
    done = ledger.staleness(bindings, claims, relations, c, current)
    rel = done["relations"].select(F.lit("relation").alias("kind"), F.col("relation_id").alias("id"), "status")
    return rel.unionByName(done["entities"].select(F.lit("entity").alias("kind"), F.col("entity_id").alias("id"), "status"))


def running_budget(spark, sf_dir):
    """Events of each user until the sum of values passes 500 or their number 40."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", F.round(F.col("value") * 100).cast("long").alias("cents"), F.lit(1).alias("one"))
    return windows.running_budget(e, ["ts", "event_id"], {"cents": 50_000, "one": 40}, ["user_id"]).select("user_id", "event_id")


def capped_facets(spark, sf_dir):
    """The first five documents of each source and language, and whether there are more."""
    d = table(spark, sf_dir, "documents").select("source", "lang", "doc_id")
    return windows.capped(d, ["source", "lang"], [F.col("doc_id")], 5).withColumn("rank", F.col("rank").cast("long"))


def first_match_role(spark, sf_dir):
    """The first rule that each document meets: junk, long, then by language."""
    rules = [(1, "code", "(?i)(^|[^a-z])license"), (2, "table", "\\|"), (3, "prose", "\\.$"), (9, "other", "")]
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = [d.filter(F.col("text").rlike(rx)).select("doc_id", F.lit(n).alias("rule"), F.lit(role).alias("role")) for n, role, rx in rules]
    every = hits[0].unionByName(hits[1]).unionByName(hits[2]).unionByName(hits[3])
    return windows.first_match(every, ["doc_id"], [F.col("rule")])


def range_merge(spark, sf_dir):
    """Minutes of each user's events with five minutes after, merged where they touch."""
    minute = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 60).cast("long")
    e = table(spark, sf_dir, "events").select("user_id", minute.alias("start"), (minute + 5).alias("end"))
    return windows.merge_ranges(e, ["user_id"], "start", "end")


def range_intersection(spark, sf_dir):
    """Line items whose fortnight after shipping meets a fortnight after their order's date."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("f"), (F.col("o_orderdate") + F.expr("INTERVAL 14 DAYS")).alias("t"))
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", F.col("l_shipdate").alias("a"), (F.col("l_shipdate") + F.expr("INTERVAL 14 DAYS")).alias("b"))
    return windows.intersecting(items, o, ["k"], ("a", "b"), ("f", "t")).select("k", "l_linenumber")


def stratified_sample(spark, sf_dir):
    """Three documents of each language and source, 24 in all, the longest first."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return windows.stratified_sample(d, ["lang", "source"], [F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "lang", "source", F.col("rank").cast("long").alias("rank"))


def history_last_n(spark, sf_dir):
    """The last two turns of each conversation."""
    return windows.last_n(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id"], [F.desc("turn")], 2)


def context_pack(spark, sf_dir):
    """Turns of each conversation, the newest first, in 1000 characters."""
    packed = windows.context_pack(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn")], "text", 1000)
    return packed.select("conv_id", "turn", "used", tx.sha256_text(F.col("packed")).alias("packed_hash"))


def conversation_compaction(spark, sf_dir):
    """The newest turns of each conversation that fit 1500 characters together."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").cast("long").alias("chars"))
    return windows.compact_history(c, ["conv_id"], [F.desc("turn")], "chars", 1500)


QUERIES = {f.__name__: f for f in (
    line_windows, line_windows_default, segment_hash, content_dedup, chunk_ids, revision_sequence, current_revision_listing, change_detection,
    tombstone_prune, upsert_snapshot, staleness_pass, running_budget, capped_facets, first_match_role, range_merge, range_intersection,
    stratified_sample, history_last_n, context_pack, conversation_compaction,
)}


def _sql_windows(width, overlap):
    stride = width - overlap
    return f"""w AS (SELECT doc_id, l, unnest(range(0, CAST(ceil(greatest(len(l) - {width}, 0) / {stride}.0) AS BIGINT) + 1)) * {stride} AS s
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
    v AS (SELECT doc_id, CAST(s + 1 AS INTEGER) AS start_line, CAST(least(s + {width}, len(l)) AS INTEGER) AS end_line, array_to_string(l[s + 1 : s + {width}], chr(10)) AS content FROM w)"""


_REV = """c AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER o AS b, row_number() OVER o AS n FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
    r AS (SELECT user_id, ts, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM c WHERE n = 1 OR b IS DISTINCT FROM event_type),
    x AS (SELECT user_id, event_id, event_type, sequence, user_id || '@' || sequence AS revision_id, lag(user_id || '@' || sequence) OVER (PARTITION BY user_id ORDER BY sequence) AS supersedes FROM r)"""

ORACLES = {
    "line_windows": f"WITH {_sql_windows(40, 5)} SELECT doc_id, start_line, end_line, length(content) AS chars FROM v",
    "line_windows_default": f"WITH {_sql_windows(220, 20)} SELECT doc_id, count(*) AS windows, max(end_line) AS last_line FROM v GROUP BY 1",
    "segment_hash": f"WITH {_sql_windows(40, 5)} SELECT doc_id, start_line, sha256(content) AS hash FROM v",
    "content_dedup": "SELECT sha256(coalesce(text, '')) AS sha256, min(doc_id) AS first_key, count(*) AS copies, max(strlen(coalesce(text, ''))) AS n_bytes FROM documents GROUP BY 1",
    "chunk_ids": f"WITH {_sql_windows(40, 5)} SELECT doc_id, start_line, 'c_' || substr(sha1('doc/' || doc_id || '|lines|' || start_line), 1, 18) AS chunk_id FROM v",
    "revision_sequence": f"WITH {_REV} SELECT * FROM x",
    "current_revision_listing": f"WITH {_REV} SELECT user_id, sequence, revision_id, event_type FROM x QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY sequence DESC) = 1",
    "change_detection": """WITH p AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderkey % 13 = 0 AS gone FROM orders WHERE o_orderkey % 7 <> 0),
        c AS (SELECT o_orderkey AS k, o_orderstatus || CASE WHEN o_orderkey % 5 = 0 THEN '*' ELSE '' END AS s FROM orders WHERE o_orderkey % 11 <> 0)
        SELECT coalesce(p.k, c.k) AS o_orderkey, CASE WHEN p.k IS NULL THEN 'new' WHEN c.k IS NULL THEN 'removed' WHEN gone THEN 'reactivated' WHEN p.s = c.s THEN 'unchanged' ELSE 'changed' END AS change
        FROM p FULL JOIN c ON p.k = c.k WHERE NOT (c.k IS NULL AND gone)""",
    "tombstone_prune": "SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_quantity > 25)",
    "upsert_snapshot": "SELECT c_custkey, c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN 'new' ELSE 'old' END AS version FROM customer",
    "staleness_pass": """WITH e AS (SELECT c_custkey AS id, c_custkey % 4 = 0 AS stale FROM customer),
        r AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderkey % 3 = 0 AS stale, o_orderstatus IN ('O', 'P') AS now FROM orders),
        b AS (SELECT c, bool_or(now) AS any_active FROM r GROUP BY 1)
        SELECT 'relation' AS kind, r.id, CASE WHEN r.now AND NOT coalesce(e.stale, true) THEN 'active' ELSE 'stale' END AS status FROM r LEFT JOIN e ON r.c = e.id
        UNION ALL SELECT 'entity', e.id, CASE WHEN coalesce(any_active, true) THEN 'active' ELSE 'stale' END FROM e LEFT JOIN b ON e.id = b.c""",
    "running_budget": """WITH s AS (SELECT user_id, event_id, ts, sum(CAST(round(value * 100) AS BIGINT)) OVER w AS c, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
        t AS (SELECT *, bool_or(c > 50000 OR n > 40) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS over_ FROM s) SELECT user_id, event_id FROM t WHERE NOT over_""",
    "capped_facets": "SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rank, count(*) OVER (PARTITION BY source, lang) AS group_size, count(*) OVER (PARTITION BY source, lang) > 5 AS truncated FROM documents QUALIFY rank <= 5",
    "first_match_role": r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)(^|[^a-z])license') THEN 1 WHEN regexp_matches(text, '\|') THEN 2 WHEN regexp_matches(text, '\.$') THEN 3 ELSE 9 END AS rule,
        CASE rule WHEN 1 THEN 'code' WHEN 2 THEN 'table' WHEN 3 THEN 'prose' ELSE 'other' END AS role FROM documents""",
    "range_merge": """WITH e AS (SELECT user_id, CAST(floor(epoch(ts) / 60) AS BIGINT) AS s FROM events), m AS (SELECT user_id, s, s + 5 AS t FROM e),
        i AS (SELECT *, CASE WHEN s > max(t) OVER (PARTITION BY user_id ORDER BY s, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS o FROM m),
        g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY s, t ROWS UNBOUNDED PRECEDING) AS island FROM i)
        SELECT user_id, min(s) AS start, max(t) AS end, count(*) AS merged FROM g GROUP BY user_id, island""",
    "range_intersection": """SELECT l_orderkey AS k, l_linenumber FROM lineitem l WHERE EXISTS (SELECT 1 FROM orders o WHERE o_orderkey = l_orderkey
        AND l_shipdate <= o_orderdate + INTERVAL 14 DAY AND l_shipdate + INTERVAL 14 DAY >= o_orderdate)""",
    "stratified_sample": """WITH r AS (SELECT doc_id, lang, source, n_chars, row_number() OVER (PARTITION BY lang, source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 3)
        SELECT doc_id, lang, source, rank FROM r ORDER BY rank, n_chars DESC, doc_id LIMIT 24""",
    "history_last_n": "SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2",
    "context_pack": """WITH p AS (SELECT conv_id, turn, text, length(text) AS n, 1000 - coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM conversations)
        SELECT conv_id, turn, CAST(least(n, l) AS BIGINT) AS used, sha256(substr(text, 1, CAST(least(n, l) AS BIGINT))) AS packed_hash FROM p WHERE l > 0 AND n > 0""",
    "conversation_compaction": "SELECT conv_id, turn, length(text) AS chars FROM conversations QUALIFY sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) <= 1500",
}
