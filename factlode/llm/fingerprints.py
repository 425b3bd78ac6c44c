"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch holds the k smallest distinct hashes of a document's shingles. Sketches merge (the k smallest of
their union) and estimate resemblance, containment and the number of distinct shingles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import SPACED_WORD, n_parts

K = 128
SHINGLE = 5
BITS = 32
#: Ids sampled for each range of doc_id, whose borders they give.
SAMPLED = 64


def sketch(text: Column, k: int = K, shingle: int = SHINGLE, bits: int = BITS) -> Column:
    """Bottom-k sketch of a text as an ascending array of longs below 2 ** bits.

    Words lie between ASCII white space. A text of fewer words than a shingle has one shingle, its whole
    sequence; a null or empty text has the empty sketch.
    """
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SPACED_WORD), F.lit(0))
    return sketch_words(F.transform(words, lambda w: F.xxhash64(w)), k, shingle, bits)


def sketch_words(hashes: Column, k: int, shingle: int, bits: int) -> Column:
    """As sketch(), of an array of word hashes."""
    # binding the array once as a lambda variable keeps it from being evaluated for every shingle
    def of(w: Column) -> Column:
        starts = F.slice(w, 1, F.greatest(F.size(w) - (shingle - 1), F.least(F.size(w), F.lit(1))))
        each = F.transform(starts, lambda x, i: F.shiftrightunsigned(F.xxhash64(x, *[F.get(w, i + j) for j in range(1, shingle)]), 64 - bits))
        return F.slice(F.sort_array(F.array_distinct(each)), 1, k)

    return F.transform(F.array(hashes), of)[0]


def encode(sketched: Column, bits: int = BITS) -> Column:
    """A sketch as a string of fixed-width lower-case hexadecimal numbers."""
    return F.lower(F.array_join(F.transform(sketched, lambda h: F.lpad(F.hex(h), bits // 4, "0")), ""))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two documents together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of the shingle sets; two empty sets are alike."""
    union = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(shared / F.greatest(F.size(union), F.lit(1)))


def distinct_count(a: Column, k: int = K, bits: int = BITS) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the normalised k-th value."""
    kth = (F.element_at(a, -1) + 1) / F.lit(float(2**bits))
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / kth)


def containment(a: Column, b: Column, k: int = K, bits: int = BITS) -> Column:
    """Estimated share of a's shingles that b has; 1 for an empty a."""
    both = resemblance(a, b, k) * distinct_count(merge(a, b, k), k, bits)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / F.greatest(distinct_count(a, k, bits), F.lit(1.0))))


def merge_groups(sketches: DataFrame, keys: Sequence[str], column: str, k: int = K, salts: int = 64) -> DataFrame:
    """One sketch per group. Rows are first merged under (keys, salt), so a hot group spreads over many tasks."""
    def smallest(rows: DataFrame, by: list[str]) -> DataFrame:
        ranked = rows.distinct().withColumn("__rank", F.row_number().over(Window.partitionBy(*by).orderBy("__hash")))
        return ranked.filter(F.col("__rank") <= k).drop("__rank")

    keys = list(keys)
    hashes = sketches.select(*keys, F.pmod(F.xxhash64(column), F.lit(salts)).alias("__salt"), F.explode(column).alias("__hash"))
    hashes = smallest(hashes, [*keys, "__salt"]).drop("__salt")
    empty = sketches.select(*keys).distinct()
    merged = smallest(hashes, keys).groupBy(*keys).agg(F.sort_array(F.collect_list("__hash")).alias(column))
    on = [F.col(f"e.{c}").eqNullSafe(F.col(f"m.{c}")) for c in keys]
    joined = empty.alias("e").join(merged.alias("m"), on, "left") if keys else empty.limit(1).alias("e").join(merged.alias("m"), F.lit(True), "left")
    return joined.select(*[f"e.{c}" for c in keys], F.coalesce(F.col(f"m.{column}"), F.array().cast("array<bigint>")).alias(column))


def with_next(docs: DataFrame, carried: Sequence[str], buckets: int | None = None) -> DataFrame:
    """Add next_<column> from the row with the next larger doc_id; after the last comes the first.

    docs needs doc_id and __order, which orders rows of one doc_id. Null doc_ids come last. Rows are dealt into
    ranges of doc_id between approximate quantiles of a sample of them; each range also receives the head of the following one, so
    one shuffle and one window per range are enough whatever the ids look like.
    """
    n = buckets or 4 * n_parts(docs)
    n = min(n, 65536)
    whole = docs.agg(F.min("doc_id").alias("least"), F.count("doc_id").alias("rows")).first()
    # the ranges need only be about even, so their borders come from a bounded sample of the ids, as in a range shuffle
    some = docs.select("doc_id").sample(min(1.0, SAMPLED * n / max(1, whole.rows)), 7)
    marks = some.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], SAMPLED * n).alias("q")).first()
    bounds = sorted({whole.least, *(marks.q or [])} - {None})
    cells = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    steps = [2**i for i in reversed(range(max(1, len(bounds)).bit_length()))]

    def search(found_so_far: Column, step: Column) -> Column:
        ahead = found_so_far + step
        return F.when((ahead <= len(bounds)) & (F.get(cells, ahead - 1) <= F.col("doc_id")), ahead).otherwise(found_so_far)

    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), search))
    dealt = docs.withColumn("__bucket", bucket.cast("int"))
    # a table of null ids alone has no bounds and one range, headed by all its rows
    head = F.get(cells, F.col("__bucket") - 1) == F.col("doc_id") if bounds else F.lit(True)
    before = F.when(F.col("__bucket") <= 1, F.lit(len(bounds))).otherwise(F.col("__bucket") - 1)
    own = F.struct(F.col("__bucket").alias("b"), F.lit(False).alias("ahead"))
    copies = F.when(head, F.array(own, F.struct(before.cast("int").alias("b"), F.lit(True).alias("ahead")))).otherwise(F.array(own))
    dealt = dealt.withColumn("__at", F.explode(copies)).withColumns({"__bucket": F.col("__at.b"), "__ahead": F.col("__at.ahead")}).drop("__at")
    order = Window.partitionBy("__bucket").orderBy("__ahead", F.col("doc_id").asc_nulls_last(), "__order")
    # one lead a column: a struct of them would be made before the shuffle and travel beside them
    dealt = dealt.withColumns({f"next_{c}": F.lead(c).over(order) for c in carried}).filter(~F.col("__ahead"))
    return dealt.drop("__bucket", "__ahead")


def edited_text(text: Column, following: Column) -> Column:
    """The last quarter (rounded down) of the code points replaced by as many first ones of the following text, or all."""
    quarter = F.floor(F.char_length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - quarter), F.substring(following, F.lit(1), quarter))


def fingerprint_documents(docs: DataFrame, k: int = K, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """Fingerprints of every text and of its edited text, with their likeness and that to the next document.

    docs needs doc_id and text. A null text counts as empty; equal texts have equal fingerprints; likeness of two
    empty texts is 1. Rows of one doc_id are ordered by xxhash64 of their text, null doc_ids come last.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base = base.withColumns({"__order": F.xxhash64("text"), "sketch": sketch(F.col("text"), k, shingle, bits)})
    chained = with_next(base, ["text", "sketch"])
    chained = chained.withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    chained = chained.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "edited", "sketch", "next_sketch", sketch(F.col("edited"), k, shingle, bits).alias("edited_sketch"))
    return chained.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        encode(F.col("sketch"), bits).alias("fingerprint"),
        encode(F.col("edited_sketch"), bits).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        F.round(distinct_count(F.col("sketch"), k, bits), 3).alias("n_shingles"),
    )


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprint every whole text of documents and its edited text."""
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
