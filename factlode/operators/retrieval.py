"""Exact, lexical, vector and hybrid retrieval. Every ranking is a total order before its limit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens, vectors

#: The constant of reciprocal rank fusion, and results of a hybrid query at most.
RRF = 60
MOST = 20


def token_search(docs: DataFrame, term: str, limit: int = MOST, case_sensitive: bool = True) -> DataFrame:
    """Documents with a whole token, most occurrences first: doc_id, hits, first_token (ordinal from 1)."""
    wanted = tokens.clean(term) if case_sensitive else tokens.clean(term).lower()
    held = F.coalesce("text", F.lit(""))
    # on the bare column, so that the substring test reaches the scan; a null text can't match
    near = docs.filter((F.col("text") if case_sensitive else F.lower("text")).contains(wanted))
    every = F.regexp_extract_all(held, F.lit(tokens.DOTTED if tokens.is_dotted(wanted) else tokens.IDENTIFIER), F.lit(0))
    found = near.select("doc_id", (every if case_sensitive else F.transform(every, lambda t: F.lower(t))).alias("tokens"))
    found = found.select("doc_id", F.size(F.filter("tokens", lambda t: t == wanted)).cast("long").alias("hits"), F.array_position("tokens", wanted).alias("first_token"))
    return found.filter("hits > 0").orderBy(F.desc("hits"), "doc_id").limit(limit)


def lexical_rank(docs: DataFrame, terms: Sequence[str], limit: int = 50, case_sensitive: bool = True) -> DataFrame:
    """Documents by the number of distinct terms that they hold as whole tokens: doc_id, hits."""
    near = F.lit(False)
    for t in terms:
        near = near | (F.col("text").contains(t) if case_sensitive else F.lower("text").contains(t.lower()))
    hits = sum((tokens.matches_term(F.col("text"), t, case_sensitive).cast("long") for t in terms), F.lit(0))
    return docs.filter(near).select("doc_id", hits.cast("long").alias("hits")).filter("hits > 0").orderBy(F.desc("hits"), "doc_id").limit(limit)


def vector_topk(rows: DataFrame, query: Sequence[float], k: int, key: str = "vec_id", embedding: str = "embedding", keep: Sequence[str] = ()) -> DataFrame:
    """The k rows nearest by cosine distance, ties by key. Partial top-k runs in every task before the merge."""
    near = rows.select(key, *keep, vectors.cosine_distance(F.col(embedding), list(query)).alias("distance"))
    return near.orderBy("distance", key).limit(k)


def topk_per_group(rows: DataFrame, group: str, order: Sequence[Column], k: int, total: int | None = None) -> DataFrame:
    """The first k rows of each group, then the first `total` of them under the same order. Adds rank, from 1."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.orderBy(*order).limit(total) if total else ranked


def ranked(rows: DataFrame, order: Sequence[Column], k: int, key: str) -> DataFrame:
    """key and rank0 (from 0) of the first k rows. The limit comes first, so the ranking window sees k rows only."""
    top = rows.orderBy(*order).limit(k)
    return top.select(F.col(key).alias("id"), (F.row_number().over(Window.orderBy(*order)) - 1).alias("rank0"))


def fuse(lists: Sequence[DataFrame], constant: int = RRF) -> DataFrame:
    """Reciprocal rank fusion of lists of (id, rank0): id, rrf."""
    out = None
    for one in lists:
        scored = one.select("id", (F.lit(1.0) / (constant + 1 + F.col("rank0"))).alias("score"))
        out = scored if out is None else out.unionByName(scored)
    return out.groupBy("id").agg(F.sum("score").alias("rrf"))


def promote_exact(fused: DataFrame, exact: DataFrame, hits: DataFrame, limit: int) -> DataFrame:
    """Ids with an exact identifier first, then by fused score, lexical hits and id. exact: (id); hits: (id, hits)."""
    marked = fused.join(exact.select("id").distinct().withColumn("is_exact", F.lit(1)), "id", "left").join(hits, "id", "left")
    marked = marked.select("id", F.coalesce("is_exact", F.lit(0)).alias("exact"), "rrf", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))
    return marked.orderBy(F.desc("exact"), F.desc("rrf"), F.desc("hits"), "id").limit(limit)


def hybrid(docs: DataFrame, embeddings: DataFrame, terms: Sequence[str], query: Sequence[float], k: int = 12, limit: int = MOST) -> DataFrame:
    """Vector and lexical legs over documents (vec_id = doc_id) fused, exact terms promoted."""
    wide = max(2 * k, 10)
    near = ranked(vector_topk(embeddings, query, wide).withColumnRenamed("vec_id", "doc_id"), [F.col("distance"), F.col("doc_id")], wide, "doc_id")
    words = lexical_rank(docs, terms, wide)
    lexical = ranked(words, [F.desc("hits"), F.col("doc_id")], wide, "doc_id")
    hits = words.select(F.col("doc_id").alias("id"), "hits")
    return promote_exact(fuse([near, lexical]), hits.filter(F.col("hits") == len(terms)), hits, min(limit, 50))


def tiered_search(rows: DataFrame, key: str, name: str, query: str, limit: int = 25, description: str | None = None) -> DataFrame:
    """Best tier of each row: 100 key equal, 90 name equal, 80 whole token in key or name, 50 substring. Nocase.

    Ties go by key. Adds score and via.
    """
    low = query.lower()
    fields = [key, name] + ([description] if description else [])
    near = F.lit(False)
    for f in fields:
        near = near | F.lower(F.col(f).cast("string")).contains(low)
    boundary = tokens.identifier_boundary(low)
    k, n = F.lower(F.col(key).cast("string")), F.lower(F.col(name).cast("string"))
    tiers = F.when(k == low, F.struct(F.lit(100).alias("score"), F.lit("key").alias("via"))).when(n == low, F.struct(F.lit(90).alias("score"), F.lit("name").alias("via")))
    if boundary:
        tiers = tiers.when(k.rlike(boundary) | n.rlike(boundary), F.struct(F.lit(80).alias("score"), F.lit("token").alias("via")))
    tiers = tiers.otherwise(F.struct(F.lit(50).alias("score"), F.lit("substring").alias("via")))
    found = rows.filter(near).withColumn("t", tiers).select("*", "t.score", "t.via").drop("t")
    return found.orderBy(F.desc("score"), key).limit(limit)


# Cue words that send a question to the code structure.
STRUCTURE_CUES = "call calls caller callers callee callees import imports imported module modules depend depends dependency dependencies entry entrypoint defined definition".split()


def route(question: Column) -> Column:
    """'glossary' for one exact token or "what is X", 'structure' for its cue words, else 'search'."""
    asks = F.regexp_extract(question, r"(?i)^\s*(?:what\s+(?:is|are|does)|define|meaning\s+of)\s+(?:an?\s+|the\s+)?(\S.*?)\s*\??\s*$", 1)
    cue = question.rlike(rf"(?i)(?<![A-Za-z0-9_])({'|'.join(STRUCTURE_CUES)})(?![A-Za-z0-9_])")
    one = tokens.is_exact_token_query(F.regexp_replace(asks, r"\s+mean$", ""))
    return F.when(tokens.is_exact_token_query(question) | one, "glossary").when(cue, "structure").otherwise("search")
