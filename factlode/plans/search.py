"""Tokens, filters and retrieval over documents, parts and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens
from ..operators import filters, retrieval


def table(spark, sf_dir, name):
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_exact_search(spark, sf_dir):
    """Documents with the whole token 'with', most occurrences first."""
    return retrieval.token_search(table(spark, sf_dir, "documents"), "with")


def token_count_by_lang(spark, sf_dir):
    """Occurrences of the whole token 'the' by language."""
    docs = table(spark, sf_dir, "documents").select("lang", tokens.count_token(F.col("text"), "the").alias("n"))
    return docs.groupBy("lang").agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").cast("long").alias("occurrences"))


def token_casefold_search(spark, sf_dir):
    """As token_exact_search without regard to case, for 'that'."""
    return retrieval.token_search(table(spark, sf_dir, "documents"), "THAT", case_sensitive=False)


def subword_components(spark, sf_dir):
    """Camel, snake and digit components of part types and brands."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.array_join(tokens.subword_components(F.col("p_brand")), ",").alias("brand"), F.array_join(tokens.subword_components(F.translate("p_type", " ", "_")), ",").alias("type"))
    return parts


QUERIES_TEXT = (
    (1, "what is the manual review timeout for REQ-NC-017?"),
    (2, "where does OrderService call GET /name-check/{caseId} with retry.max_attempts"),
    (3, "plain words only, nothing special"),
    (4, ""),
)


def identifier_extract(spark, sf_dir):
    """Explicit identifiers of four literal questions, and the number of license tokens in documents."""
    asked = spark.createDataFrame(list(QUERIES_TEXT), "id int, question string")
    found = asked.select("id", F.explode_outer(F.regexp_extract_all("question", F.lit(tokens.EXPLICIT[0]), F.lit(0))).alias("token"))
    docs = table(spark, sf_dir, "documents").filter(F.col("text").contains("BY-NC"))
    total = docs.select(F.sum(tokens.count_token(F.col("text"), "BY-NC")).cast("long").alias("n")).select(F.lit(0).alias("id"), F.concat(F.lit("BY-NC:"), F.coalesce("n", F.lit(0)).cast("string")).alias("token"))
    return found.unionByName(total)


def lexical_multi_term_rank(spark, sf_dir):
    """Documents by how many of four terms they hold as whole tokens."""
    return retrieval.lexical_rank(table(spark, sf_dir, "documents"), ["with", "from", "that", "should"])


def like_nocase_search(spark, sf_dir):
    """Parts whose name holds a substring in any case; nothing in it is a wildcard."""
    return table(spark, sf_dir, "part").filter(filters.contains_nocase(F.col("p_name"), "RED")).select("p_partkey", "p_name")


def metadata_filter_null_safe(spark, sf_dir):
    """Documents whose quality label isn't 0, with no label counting as different, in two languages."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    return docs.filter(filters.where({"$and": [{"quality": {"$ne": 0}}, {"lang": {"$in": ["en", "de"]}}, {"quality": {"$gt": 5}}]})).select("doc_id", "lang", "quality")


def _first_vector(rows):
    return [float(x) for x in rows.orderBy("vec_id").select("embedding").first()[0]]


def vector_topk_cosine(spark, sf_dir):
    """The ten vectors nearest to the first one."""
    rows = table(spark, sf_dir, "embeddings")
    return retrieval.vector_topk(rows, _first_vector(rows), 10).select("vec_id", F.round("distance", 6).alias("distance"))


def vector_topk_filtered(spark, sf_dir):
    """As vector_topk_cosine among the vectors whose label isn't that of the first."""
    rows = table(spark, sf_dir, "embeddings")
    first = rows.orderBy("vec_id").select("label").first()[0]
    return retrieval.vector_topk(rows.filter(filters.where({"label": {"$ne": first}})), _first_vector(rows), 10, keep=["label"]).select("vec_id", "label", F.round("distance", 6).alias("distance"))


def similar_cases_per_label(spark, sf_dir):
    """Three nearest vectors of each label, then the ten nearest of these."""
    rows = table(spark, sf_dir, "embeddings")
    from ..functions import vectors

    near = rows.select("vec_id", "label", vectors.cosine_distance(F.col("embedding"), _first_vector(rows)).alias("distance"))
    top = retrieval.topk_per_group(near, "label", [F.col("distance"), F.col("vec_id")], 3, 10)
    return top.select("vec_id", "label", F.round("distance", 6).alias("distance"), F.col("rank").cast("long").alias("rank"))


def rrf_fusion(spark, sf_dir):
    """Vector and lexical ranks of documents (vec_id = doc_id) fused by reciprocal rank."""
    rows = table(spark, sf_dir, "embeddings")
    near = retrieval.ranked(retrieval.vector_topk(rows, _first_vector(rows), 24), [F.col("distance"), F.col("vec_id")], 24, "vec_id")
    words = retrieval.lexical_rank(table(spark, sf_dir, "documents"), ["with", "from", "that"], 24)
    lexical = retrieval.ranked(words, [F.desc("hits"), F.col("doc_id")], 24, "doc_id")
    return retrieval.fuse([near, lexical]).select("id", F.round("rrf", 9).alias("rrf"))


def exact_promotion_order(spark, sf_dir):
    """Fused results with documents that hold all terms promoted; the position is part of the result."""
    rows = table(spark, sf_dir, "embeddings")
    found = retrieval.hybrid(table(spark, sf_dir, "documents"), rows, ["with", "from", "that"], _first_vector(rows))
    return found.select("id", F.col("exact").cast("int").alias("exact"), F.round("rrf", 9).alias("rrf"), "hits")


def tiered_search(spark, sf_dir):
    """Suppliers and parts by the best tier of a query over key and name."""
    parts = table(spark, sf_dir, "part").select(F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("key"), F.col("p_name").alias("name"))
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("key"), F.col("s_name").alias("name"))
    return retrieval.tiered_search(parts.unionByName(suppliers), "key", "name", "part:17", 25).select("key", "name", "score", "via")


def query_router(spark, sf_dir):
    """Where each of some literal questions goes."""
    asked = [(1, "OrderService"), (2, "what is ISR?"), (3, "which modules import the payment client"), (4, "how are late orders refunded to customers"), (5, "")]
    return spark.createDataFrame(asked, "id int, question string").select("id", retrieval.route(F.col("question")).alias("route"))


QUERIES = {f.__name__: f for f in (
    token_exact_search, token_count_by_lang, token_casefold_search, subword_components, identifier_extract, lexical_multi_term_rank,
    like_nocase_search, metadata_filter_null_safe, vector_topk_cosine, vector_topk_filtered, similar_cases_per_label, rrf_fusion,
    exact_promotion_order, tiered_search, query_router,
)}

_NEAR = """
q AS (SELECT embedding::DOUBLE[] AS e, label FROM embeddings ORDER BY vec_id LIMIT 1),
near AS (SELECT vec_id, m.label, 1 - list_cosine_similarity(m.embedding::DOUBLE[], q.e) AS distance, q.label AS own FROM embeddings m, q)"""
_TOKENS = "regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+')"
_FUSED = f"""
WITH {_NEAR},
v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY distance, vec_id) - 1 AS r FROM near QUALIFY r < 24),
w AS (SELECT doc_id AS id, CAST(list_contains({_TOKENS}, 'with') AS BIGINT) + CAST(list_contains({_TOKENS}, 'from') AS BIGINT) + CAST(list_contains({_TOKENS}, 'that') AS BIGINT) AS hits FROM documents),
l AS (SELECT id, hits, row_number() OVER (ORDER BY hits DESC, id) - 1 AS r FROM w WHERE hits > 0 QUALIFY r < 24),
f AS (SELECT id, sum(1.0::DOUBLE / (61 + r)) AS rrf FROM (SELECT id, r FROM v UNION ALL SELECT id, r FROM l) GROUP BY id)
"""

ORACLES = {
    "token_exact_search": f"""SELECT doc_id, CAST(len(list_filter(t, lambda x: x = 'with')) AS BIGINT) AS hits, CAST(list_position(t, 'with') AS BIGINT) AS first_token
        FROM (SELECT doc_id, {_TOKENS} AS t FROM documents) WHERE list_contains(t, 'with') ORDER BY hits DESC, doc_id LIMIT 20""",
    "token_casefold_search": f"""SELECT doc_id, CAST(len(list_filter(t, lambda x: x = 'that')) AS BIGINT) AS hits, CAST(list_position(t, 'that') AS BIGINT) AS first_token
        FROM (SELECT doc_id, list_transform({_TOKENS}, lambda x: lower(x)) AS t FROM documents) WHERE list_contains(t, 'that') ORDER BY hits DESC, doc_id LIMIT 20""",
    "token_count_by_lang": f"""SELECT lang, count(*) FILTER (n > 0) AS docs, CAST(sum(n) AS BIGINT) AS occurrences
        FROM (SELECT lang, len(list_filter({_TOKENS}, lambda x: x = 'the')) AS n FROM documents) GROUP BY lang""",
    "subword_components": """SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(string_split(p_brand, '_'), regexp_extract_all(p_brand, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+')))), ',') AS brand,
        array_to_string(list_sort(list_distinct(list_concat(string_split(p_type, ' '), list_transform(regexp_extract_all(p_type, '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: x)))), ',') AS type FROM part""",
    "identifier_extract": """SELECT id, unnest(CASE WHEN len(t) = 0 THEN [NULL] ELSE t END) AS token FROM (SELECT id, regexp_extract_all(question, '[A-Z][A-Z0-9]*(?:-[A-Z0-9]+)+') AS t
        FROM (VALUES (1, 'what is the manual review timeout for REQ-NC-017?'), (2, 'where does OrderService call GET /name-check/{caseId} with retry.max_attempts'), (3, 'plain words only, nothing special'), (4, '')) v(id, question))
        UNION ALL SELECT 0, 'BY-NC:' || CAST(sum(len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+(?:[.\\-][A-Za-z0-9_]+)+'), lambda x: x = 'BY-NC'))) AS VARCHAR) FROM documents""",
    "lexical_multi_term_rank": f"""SELECT * FROM (SELECT doc_id, {' + '.join(f"CAST(list_contains({_TOKENS}, '{w}') AS BIGINT)" for w in ('with', 'from', 'that', 'should'))} AS hits FROM documents) WHERE hits > 0 ORDER BY hits DESC, doc_id LIMIT 50""",
    "like_nocase_search": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%red%'",
    "metadata_filter_null_safe": """SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY 1) l USING (doc_id)
        WHERE l.quality IS DISTINCT FROM 0 AND d.lang IN ('en', 'de')""",
    "vector_topk_cosine": f"WITH {_NEAR} SELECT vec_id, round(distance, 6) AS distance FROM near ORDER BY near.distance, vec_id LIMIT 10",
    "vector_topk_filtered": f"WITH {_NEAR} SELECT vec_id, label, round(distance, 6) AS distance FROM near WHERE label IS DISTINCT FROM own ORDER BY near.distance, vec_id LIMIT 10",
    "similar_cases_per_label": f"""WITH {_NEAR}, r AS (SELECT vec_id, label, distance AS d, row_number() OVER (PARTITION BY label ORDER BY distance, vec_id) AS rank FROM near QUALIFY rank <= 3)
        SELECT vec_id, label, round(d, 6) AS distance, rank FROM r ORDER BY d, vec_id LIMIT 10""",
    "rrf_fusion": _FUSED + "SELECT id, round(rrf, 9) AS rrf FROM f",
    "exact_promotion_order": _FUSED + """SELECT f.id, CASE WHEN l.hits = 3 THEN 1 ELSE 0 END AS exact, round(f.rrf, 9) AS rrf, coalesce(l.hits, 0) AS hits
        FROM f LEFT JOIN l USING (id) ORDER BY exact DESC, f.rrf DESC, hits DESC, f.id LIMIT 20""",
    "tiered_search": """WITH r AS (SELECT 'part:' || p_partkey AS key, p_name AS name FROM part UNION ALL SELECT 'supplier:' || s_suppkey, s_name FROM supplier),
        m AS (SELECT *, CASE WHEN lower(key) = 'part:17' THEN 100 WHEN lower(name) = 'part:17' THEN 90
          WHEN regexp_matches(lower(key), '(^|[^a-z0-9_])part:17([^a-z0-9_]|$)') OR regexp_matches(lower(name), '(^|[^a-z0-9_])part:17([^a-z0-9_]|$)') THEN 80 ELSE 50 END AS score
          FROM r WHERE lower(key) LIKE '%part:17%' OR lower(name) LIKE '%part:17%')
        SELECT key, name, score, CASE score WHEN 100 THEN 'key' WHEN 90 THEN 'name' WHEN 80 THEN 'token' ELSE 'substring' END AS via FROM m ORDER BY score DESC, key LIMIT 25""",
    "query_router": "SELECT * FROM (VALUES (1, 'glossary'), (2, 'glossary'), (3, 'structure'), (4, 'search'), (5, 'search')) v(id, route)",
}
