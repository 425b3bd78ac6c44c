"""Rollups over documents, events, orders, pages and suppliers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import rollups, trace, windows
from ..sources import html as html_source
from .search import table


def asset_stats(spark, sf_dir):
    """Documents: all, with a label, of quality, toxic, long, empty."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(labels, "doc_id", "left")
    return rollups.flag_counts(d, {"labelled": F.col("quality").isNotNull(), "good": F.col("quality") == 1, "toxic": F.col("toxic") == 1, "long": F.col("n_chars") > 10000, "empty": F.col("n_chars") == 0})


def status_groups(spark, sf_dir):
    """Orders by status."""
    return rollups.status_counts(table(spark, sf_dir, "orders"), "o_orderstatus")


def usage_totals(spark, sf_dir):
    """Events and cents by type; a type whose values are all null (made) keeps null."""
    e = table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_type") != "error", F.round(F.col("value") * 100).cast("long")).alias("cents"))
    return rollups.usage_totals(e, ["cents"], ["event_type"])


def daily_usage(spark, sf_dir):
    """Events and cents by day and type."""
    e = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type", F.round(F.col("value") * 100).cast("long").alias("cents"))
    return rollups.usage_totals(e, ["cents"], ["day", "event_type"])


def language_share(spark, sf_dir):
    """Documents, characters and share by language."""
    return rollups.share(table(spark, sf_dir, "documents"), "lang", "n_chars")


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^https?://", "").alias("path"), F.length("html").cast("long").alias("lines"), (F.col("page_id") % 3).cast("string").alias("language"))


def module_rollup(spark, sf_dir):
    """Pages by directory of their address, with a made language."""
    return rollups.module_rollup(_pages(spark, sf_dir))


def module_edge_weights(spark, sf_dir):
    """Supplies between regions: nations as files of a region's directory."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("/", "r_name", "n_name").alias("p"))
    s = table(spark, sf_dir, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("p").alias("from_path"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("p").alias("to_path"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    edges = items.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    return rollups.module_edges(edges)


def call_graph_ambiguous(spark, sf_dir):
    """Large parts of a brand as files that define their type, all other parts as callers of a name."""
    p = table(spark, sf_dir, "part")
    calls = p.filter("p_size <= 25").select(F.col("p_brand").alias("path"), F.col("p_type").alias("symbol"))
    definitions = p.filter("p_size > 25").select(F.concat(F.lit("def/"), F.col("p_brand")).alias("path"), F.col("p_type").alias("symbol"))
    return rollups.call_graph(calls, definitions)


def external_top(spark, sf_dir):
    """The most frequent part names."""
    return rollups.top_counts(table(spark, sf_dir, "part"), "p_name")


def template_score(spark, sf_dir):
    """The template that the words in part names and types speak for most."""
    rules = spark.createDataFrame([("metal", "steel", 3), ("metal", "tin", 2), ("paint", "red", 3), ("paint", "blue", 3), ("wood", "oak", 1), ("paint", "economy", 1), ("metal", "standard", 1)], "target string, pattern string, points int")
    items = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return rollups.best_target(rollups.score_rules(items, rules, "p_partkey", "text"), "p_partkey", 3)


def coverage_ratios(spark, sf_dir):
    """Orders with a shipped line by status, as a percentage; null where there are none."""
    shipped = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(True))
    o = table(spark, sf_dir, "orders").join(shipped, "o_orderkey", "left")
    g = o.groupBy("o_orderpriority").agg(F.count_if("hit").alias("numerator"), F.count_if(F.col("o_orderstatus") != "O").alias("denominator"))
    g = g.withColumn("denominator", F.when(F.col("o_orderpriority").startswith("5"), 0).otherwise(F.col("denominator")))
    return g.withColumn("percentage", trace.ratio(F.col("numerator"), F.col("denominator")))


def gap_missing_stage(spark, sf_dir):
    """Customers without an order, and orders without a line item of a made subset, as gaps with a severity rank."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    first = c.join(o.select(F.col("o_custkey").alias("k")).distinct(), "k", "left_anti").select("k", F.lit("missing-design").alias("gap_type"), F.lit(1).alias("severity_rank"))
    lines = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")).distinct()
    second = o.join(lines, "k", "left_anti").select("k", F.lit("missing-implementation").alias("gap_type"), F.lit(0).alias("severity_rank"))
    return first.unionByName(second)


def json_props(spark, sf_dir):
    """Sums of the one property of events, read as a variant."""
    e = table(spark, sf_dir, "events").select("event_type", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("total"), F.max("k").alias("most"))


def integrity_check(spark, sf_dir):
    """Findings on orders, whose made parent table lacks every ninth customer."""
    return rollups.integrity(table(spark, sf_dir, "orders"), "o_orderkey", table(spark, sf_dir, "customer").filter("c_custkey % 9 <> 0"), "o_custkey", "c_custkey")


def glossary_winner(spark, sf_dir):
    """The entry of highest authority of each term, of literal ones."""
    rows = [("ISR", "in-sync replicas", 3, 2, "src/a.java", 4), ("ISR", "In-Sync Replicas", 1, 0, "docs/b.md", 9), ("ISR", "in sync replica set", 1, 0, "docs/a.md", 12),
            ("DLQ", "dead letter queue", 2, 2, "notes.md", 1), ("DLQ", "Dead-Letter Queue", 0, 1, "docs/glossary.md", 3), ("TTL", "time to live", 2, 2, "x.md", 7), ("TTL", "time to live", 2, 2, "x.md", 5)]
    e = spark.createDataFrame(rows, "term string, definition string, file_rank int, kind_rank int, path string, line int")
    return windows.first_match(e, ["term"], [F.col(c) for c in ("file_rank", "kind_rank", "path", "line")]).select("term", "definition", "path", "line")


def html_blocks(spark, sf_dir):
    """Blocks of all pages by type."""
    blocks = html_source.parse(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("path"), F.col("html").alias("text")))
    return blocks.groupBy("block_type").agg(F.count("*").alias("blocks"), F.sum(F.char_length("content")).alias("chars"))


def content_hash_groups(spark, sf_dir):
    """Sources by the number of documents whose text another source has too."""
    d = table(spark, sf_dir, "documents").select("source", tx.sha256_text(F.col("text")).alias("h"))
    shared = d.groupBy("h").agg(F.count_distinct("source").alias("n")).filter("n > 1").select("h")
    return d.join(shared, "h", "left_semi").groupBy("source").agg(F.count("*").alias("shared"))


QUERIES = {f.__name__: f for f in (
    asset_stats, status_groups, usage_totals, daily_usage, language_share, module_rollup, module_edge_weights, call_graph_ambiguous, external_top,
    template_score, coverage_ratios, gap_missing_stage, json_props, integrity_check, glossary_winner, html_blocks, content_hash_groups,
)}

ORACLES = {
    "asset_stats": """SELECT count(*) AS total, count(quality) AS labelled, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (n_chars > 10000) AS long, count(*) FILTER (n_chars = 0) AS empty
        FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id)""",
    "status_groups": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
    "usage_totals": "SELECT event_type, count(*) AS requests, CAST(sum(CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) END) AS BIGINT) AS cents FROM events GROUP BY 1",
    "daily_usage": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS requests, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2",
    "language_share": "SELECT lang, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS lines, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 3) AS share FROM documents GROUP BY 1",
    "module_rollup": r"""WITH p AS (SELECT regexp_replace(url, '^https?://', '') AS path, length(html) AS lines, CAST(page_id % 3 AS VARCHAR) AS language FROM pages),
        m AS (SELECT CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END AS module, language, count(*) AS n, sum(lines) AS l FROM p GROUP BY 1, 2)
        SELECT module, CAST(sum(n) AS BIGINT) AS files, CAST(sum(l) AS BIGINT) AS lines, string_agg(language || '=' || n, ',' ORDER BY language) AS languages FROM m GROUP BY 1""",
    "module_edge_weights": """WITH n AS (SELECT n_nationkey AS k, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey)
        SELECT a.r AS from_module, b.r AS to_module, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey
        JOIN n a ON s_nationkey = a.k JOIN n b ON c_nationkey = b.k WHERE a.r <> b.r GROUP BY 1, 2""",
    "call_graph_ambiguous": """WITH c AS (SELECT DISTINCT p_brand AS f, p_type AS s FROM part WHERE p_size <= 25), d AS (SELECT DISTINCT 'def/' || p_brand AS t, p_type AS s FROM part WHERE p_size > 25)
        SELECT f AS from_path, t AS to_path, s AS symbol, (SELECT count(*) FROM d e WHERE e.s = c.s) > 1 AS ambiguous FROM c JOIN d USING (s) WHERE f <> t QUALIFY row_number() OVER (PARTITION BY f ORDER BY s, t) <= 120""",
    "external_top": "SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 50",
    "template_score": """WITH r(target, pattern, points) AS (VALUES ('metal', 'steel', 3), ('metal', 'tin', 2), ('paint', 'red', 3), ('paint', 'blue', 3), ('wood', 'oak', 1), ('paint', 'economy', 1), ('metal', 'standard', 1)),
        s AS (SELECT p_partkey, target, sum(points) AS score FROM part JOIN r ON contains(lower(p_name || ' ' || p_type), pattern) GROUP BY 1, 2)
        SELECT p_partkey, CAST(score AS BIGINT) AS score, target FROM s WHERE score >= 3 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, target) = 1""",
    "coverage_ratios": """WITH g AS (SELECT o_orderpriority, count(*) FILTER (o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')) AS numerator,
        CASE WHEN o_orderpriority[1] = '5' THEN 0 ELSE count(*) FILTER (o_orderstatus <> 'O') END AS denominator FROM orders GROUP BY 1)
        SELECT *, CASE WHEN denominator > 0 THEN round(100.0::DOUBLE * numerator / denominator, 2) END AS percentage FROM g""",
    "gap_missing_stage": """SELECT * FROM (SELECT c_custkey AS k, 'missing-design' AS gap_type, 1 AS severity_rank FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
        UNION ALL SELECT o_orderkey, 'missing-implementation', 0 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'))""",
    "json_props": "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS total, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS most FROM events GROUP BY 1",
    "integrity_check": """SELECT 'duplicate-key' AS check, count(*) AS findings FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'null-key', count(*) FROM orders WHERE o_orderkey IS NULL
        UNION ALL SELECT 'missing-parent', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 9 <> 0)""",
    "glossary_winner": "SELECT * FROM (VALUES ('ISR', 'in sync replica set', 'docs/a.md', 12), ('DLQ', 'Dead-Letter Queue', 'docs/glossary.md', 3), ('TTL', 'time to live', 'x.md', 5)) v(term, definition, path, line)",
    "content_hash_groups": """WITH d AS (SELECT source, sha256(coalesce(text, '')) AS h FROM documents) SELECT source, count(*) AS shared FROM d WHERE h IN (SELECT h FROM d GROUP BY h HAVING count(DISTINCT source) > 1) GROUP BY 1""",
}
