"""Facts, conflicts, pairs, quotes and interval diffs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import conflicts, overlay, semantic
from .search import table

STATEMENTS = [
    ("c1", "e1", "authoritative", "document", "The timeout is 2 s for the gateway."),
    ("c2", "e1", "unknown", "code", "timeout 5 seconds"),
    ("c3", "e1", "unknown", "document", "The time-out of 2000 ms applies."),
    ("c4", "e1", "unknown", "document", "threshold 9999"),
    ("c5", "e2", "authoritative", "document", "Max retries: 3, and each call is retried five times"),
    ("c6", "e2", "unknown", "code", "payment.retry.enabled = true; payment.pool.size=20"),
    ("c7", "e2", "unknown", "document", "GET /orders//{id}/ and POST /orders/{id}"),
    ("c8", "e3", "unknown", "document", "column total has type numeric(10,2); caching is disabled; this is mandatory"),
    ("c9", "e3", "unknown", "document", "A sentence without any fact in it."),
]


def _facts(spark):
    return conflicts.extract(spark.createDataFrame(STATEMENTS, "claim_id string, entity_id string, authority string, source_kind string, statement string"))


def fact_extract(spark, sf_dir):
    """Facts of literal statements."""
    return _facts(spark).select("fact_id", "subject", "property", "value_num", "value_str", "value_bool", "unit", "value_type")


def conflict_statements(spark, sf_dir):
    """Differing facts of literal statements, by detector."""
    f = _facts(spark)
    out = conflicts.statement_pairs(f).withColumn("detector", F.lit("statement"))
    out = out.unionByName(conflicts.specification_code(f).withColumn("detector", F.lit("specification-code")))
    return out.unionByName(conflicts.authoritative(f).withColumn("detector", F.lit("authoritative"))).select("detector", "subject", "property", "a", "b")


def _part_facts(spark, sf_dir):
    none = lambda t: F.lit(None).cast(t)
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("p"), F.lpad(F.col("p_partkey").cast("string"), 8, "0")).alias("fact_id"), F.col("p_name").alias("subject"), F.lit("type").alias("property"), none("double").alias("value_num"),
        F.col("p_type").alias("value_str"), none("boolean").alias("value_bool"), F.lit("").alias("unit"), F.lit("identifier").alias("value_type"), F.when(F.col("p_size") > 45, "authoritative").otherwise("unknown").alias("authority"),
    )


def conflict_pairs(spark, sf_dir):
    """Parts of one name whose type differs, by least part of each type."""
    return conflicts.statement_pairs(_part_facts(spark, sf_dir)).select("subject", "a", "b")


def conflict_authoritative(spark, sf_dir):
    """Authoritative parts that another part of their name differs from, and by how many."""
    return conflicts.authoritative(_part_facts(spark, sf_dir)).groupBy("subject", "a").agg(F.count("*").alias("others"))


def conflict_reconcile(spark, sf_dir):
    """Actions of a scan on literal conflicts."""
    detected = [("k1", "f1", "s1"), ("k2", "f2x", "s2"), ("k3", "f3", "s3"), ("k4", "f4", "s4"), ("k5", "f5", "s9"), ("k6", "f6", "s6"), ("k10", "f", "s10")]
    stored = [("k1", "f1", "s1", "open", None), ("k2", "f2", "s2", "open", None), ("k3", "f3", "s3", "dismissed", None), ("k4", "f4", "s4", "resolved", None), ("k7", "f7", "s7", "open", None),
              ("k8", "f8", "s8", "accepted-risk", "2020-01-01"), ("k9", "f9", "s9", "open", None), ("k11", "f", "s11", "accepted-risk", "2999-01-01")]
    d = spark.createDataFrame(detected, "dedup_key string, fingerprint string, subject_key string")
    s = spark.createDataFrame(stored, "dedup_key string, fingerprint string, subject_key string, status string, expires_at string")
    return conflicts.reconcile(d, s, F.lit("2024-01-01"))


def _segments(spark, sf_dir, after):
    t = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tx.lines(F.col("text"))).alias("n", "line"))
    if after:
        t = t.filter("n % 9 <> 4").withColumn("line", F.when(F.col("n") % 7 == 3, F.upper("line")).otherwise(F.col("line")))
    else:
        t = t.filter("n % 11 <> 6")
    moved = F.when((F.col("doc_id") % 10 == 1) & F.lit(after), F.lit("new/")).otherwise(F.lit("old/"))
    return t.select(F.col("doc_id").alias("asset"), F.col("n").alias("segment_key"), F.concat(moved, F.col("doc_id").cast("string")).alias("path"), (F.col("n") + 1).alias("start_line"), (F.col("n") + 1).alias("end_line"), tx.sha256_text(F.col("line")).alias("hash"))


def segment_diff(spark, sf_dir):
    """Classes of line segments between two made versions of documents, counted."""
    ranges = table(spark, sf_dir, "documents").filter("doc_id % 10 = 2").select(F.col("doc_id").alias("asset"), F.lit(1).alias("start"), F.lit(3).alias("count"))
    d = overlay.segment_diff(_segments(spark, sf_dir, False), _segments(spark, sf_dir, True), ["asset", "segment_key"], ranges)
    return d.groupBy("asset", "change").agg(F.count("*").alias("segments"))


def risk_max(spark, sf_dir):
    """The highest risk of each user's events under a made ranking of event types."""
    level = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "high").when(F.col("event_type") == "signup", "medium").otherwise("low")
    return overlay.max_level(table(spark, sf_dir, "events").select("user_id", level.alias("level")), ["user_id"], "level")


def pair_generation(spark, sf_dir):
    """Unordered pairs of documents with one text, 40 at most."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), tx.sha256_text(F.col("text")).alias("key"))
    return semantic.pairs(d, "key", 40)


def quote_verify(spark, sf_dir):
    """Benchmark texts as quotes: how many documents hold each, white space and case aside."""
    quotes = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return semantic.find_quotes(quotes, table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


QUERIES = {f.__name__: f for f in (
    fact_extract, conflict_statements, conflict_pairs, conflict_authoritative, conflict_reconcile, segment_diff, risk_max, pair_generation, quote_verify,
)}

_PF = "f AS (SELECT 'p' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') AS id, p_name AS subject, p_type AS v, p_size > 45 AS auth FROM part)"
ORACLES = {
    "fact_extract": """SELECT * FROM (VALUES
        ('c1#0', 'e1', 'timeout', 2000.0::DOUBLE, NULL, NULL, 'ms', 'duration'), ('c2#0', 'e1', 'timeout', 5000.0, NULL, NULL, 'ms', 'duration'), ('c3#0', 'e1', 'timeout', 2000.0, NULL, NULL, 'ms', 'duration'),
        ('c4#0', 'e1', 'latency', 9999.0, NULL, NULL, '', 'integer'), ('c5#0', 'e2', 'retries', 3.0, NULL, NULL, '', 'count'), ('c5#1', 'e2', 'retries', 5.0, NULL, NULL, '', 'count'),
        ('c6#0', 'payment.retry.enabled', 'configuration-value', NULL, NULL, true, '', 'boolean'), ('c6#1', 'payment.pool.size', 'configuration-value', 20.0, NULL, NULL, '', 'integer'),
        ('c7#0', '/orders/{id}', 'http-method', NULL, 'GET', NULL, '', 'http-method'), ('c7#1', '/orders/{id}', 'http-method', NULL, 'POST', NULL, '', 'http-method'),
        ('c8#0', 'total', 'data-type', NULL, 'decimal(10,2)', NULL, '', 'data-type'), ('c8#1', 'caching', 'boolean-obligation', NULL, NULL, false, '', 'boolean'))
        v(fact_id, subject, property, value_num, value_str, value_bool, unit, value_type)""",
    "conflict_statements": """SELECT * FROM (VALUES ('statement', 'e1', 'timeout', 'c1#0', 'c2#0'), ('statement', 'e2', 'retries', 'c5#0', 'c5#1'), ('statement', '/orders/{id}', 'http-method', 'c7#0', 'c7#1'),
        ('specification-code', 'e1', 'timeout', 'c1#0', 'c2#0'), ('specification-code', 'e1', 'timeout', 'c3#0', 'c2#0'), ('authoritative', 'e1', 'timeout', 'c1#0', 'c2#0'),
        ('authoritative', 'e2', 'retries', 'c5#0', 'c5#1'), ('authoritative', 'e2', 'retries', 'c5#1', 'c5#0')) v(detector, subject, property, a, b)""",
    "conflict_pairs": f"""WITH {_PF}, r AS (SELECT subject, v, min(id) AS id FROM f GROUP BY 1, 2)
        SELECT a.subject, a.id AS a, b.id AS b FROM r a JOIN r b ON a.subject = b.subject AND a.id < b.id AND a.v <> b.v QUALIFY row_number() OVER (PARTITION BY a.subject ORDER BY a.id, b.id) <= 50""",
    "conflict_authoritative": f"WITH {_PF} SELECT a.subject, a.id AS a, count(*) AS others FROM f a JOIN f b ON a.subject = b.subject AND a.v <> b.v WHERE a.auth GROUP BY 1, 2",
    "conflict_reconcile": """SELECT * FROM (VALUES ('k1', 'observe'), ('k2', 'supersede'), ('k3', 'suppress'), ('k4', 'reopen'), ('k5', 'supersede'), ('k6', 'create'), ('k10', 'create'), ('k7', 'stale'), ('k8', 'reopen'), ('k9', 'stale')) v(dedup_key, action)""",
    "segment_diff": """WITH t AS (SELECT doc_id, unnest(range(len(l))) AS n, l FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
        b AS (SELECT doc_id, n, sha256(l[n + 1]) AS h FROM t WHERE n % 11 <> 6), a AS (SELECT doc_id, n, sha256(CASE WHEN n % 7 = 3 THEN upper(l[n + 1]) ELSE l[n + 1] END) AS h FROM t WHERE n % 9 <> 4),
        c AS (SELECT coalesce(a.doc_id, b.doc_id) AS asset, CASE WHEN a.n IS NULL THEN 'deleted' WHEN b.n IS NULL THEN 'added' WHEN a.h <> b.h THEN 'modified' WHEN a.doc_id % 10 = 1 THEN 'moved'
          WHEN a.doc_id % 10 = 2 AND a.n < 3 THEN 'context-changed' ELSE 'unchanged' END AS change FROM b FULL JOIN a ON a.doc_id = b.doc_id AND a.n = b.n) SELECT asset, change, count(*) AS segments FROM c GROUP BY 1, 2""",
    "risk_max": """SELECT user_id, ['low', 'medium', 'high', 'critical'][max(CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END)] AS level FROM events GROUP BY 1""",
    "pair_generation": "SELECT a.doc_id AS a, b.doc_id AS b FROM documents a JOIN documents b ON a.text IS NOT DISTINCT FROM b.text AND a.doc_id < b.doc_id ORDER BY a, b LIMIT 40",
    "quote_verify": r"""WITH q AS (SELECT item_id AS quote_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM benchmark), d AS (SELECT doc_id, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS t FROM documents)
        SELECT q.quote_id, count(d.doc_id) AS docs, min(d.doc_id) AS first_doc, CASE WHEN count(d.doc_id) > 0 THEN 'verified' ELSE 'missing' END AS status FROM q LEFT JOIN d ON contains(d.t, q.t) GROUP BY 1""",
}
