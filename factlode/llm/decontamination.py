"""Benchmark decontamination by winnowing.

A benchmark window is 13 consecutive words of an item (a shorter item is one window). Of every window of L
words, the least hash of its k-grams (k = ceil(L / 2)) is its anchor. A document's anchors are the same
minima over its own windows, so every shared window shares an anchor. Anchors are joined first; the windows
around a shared anchor are then compared in full, and the words of equal windows are hit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import ascii_lower, cut

WINDOW = 13
#: A document is contaminated if at least one in so many of its words is hit.
SHARE = 20
#: Benchmark rows (anchors or windows) up to which that side of a join is broadcast, and the bytes of their texts.
BROADCAST_ROWS = 50_000
BROADCAST_BYTES = 32 << 20
#: ASCII letters and digits and all non-ASCII characters, in two predicates, which Java matches far faster than five ranges.
WORD = r"[\p{Alnum}\P{ASCII}]+"


def words_of(text: Column) -> Column:
    """Words of a lower-cased text: digits, a-z and non-ASCII characters; none for null."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def window_anchors(words: Column, length: int) -> Column:
    """The anchor of each window of so many words, by start; empty if there are fewer words."""
    k = (length + 1) // 2
    wide = length - k + 1

    def grams(h: Column) -> Column:
        starts = F.slice(h, 1, F.greatest(F.size(h) - (k - 1), F.lit(0)))
        return F.transform(starts, lambda x, i: F.xxhash64(F.lit(length), x, *[F.get(h, i + j) for j in range(1, k)]))

    def minima(g: Column) -> Column:
        starts = F.slice(g, 1, F.greatest(F.size(g) - (wide - 1), F.lit(0)))
        return F.transform(starts, lambda x, i: F.least(x, *[F.get(g, i + j) for j in range(1, wide)]) if wide > 1 else x)

    return _let(_let(F.transform(words, lambda w: F.xxhash64(w)), grams), minima)


def windows_at(words: Column, length: int, starts: Column) -> Column:
    """(start, length, window) of the windows at the given starts."""
    return F.transform(
        starts,
        lambda s: F.struct(s.alias("start"), F.lit(length).alias("length"), F.array_join(F.slice(words, s + 1, length), " ").alias("window")),
    )


def bounded(side: DataFrame, limit: int) -> DataFrame:
    """A checkpointed side, with a broadcast hint only if its counted rows and the bytes of its texts are within their limits."""
    side = cut(side)
    texts = [F.octet_length(name) for name, kind in side.dtypes if kind == "string"]
    rows, size = side.agg(F.count("*"), F.sum(sum(texts, F.lit(0)).cast("long"))).first()
    return F.broadcast(side) if rows <= limit and (size or 0) <= BROADCAST_BYTES else side


def overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Occurrences of benchmark windows in documents.

    docs: (doc_id, text); benchmark: (item_id, text). Returns places (doc_id, th, start, length), one row for
    each place, and items (doc_id, th, item_id), distinct; th is xxhash64 of the text. Null texts have no words;
    items with a null item_id count like any other.
    """
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words"))
    items = items.filter(F.size("words") > 0)
    lengths = sorted(r[0] for r in items.select(F.least(F.size("words"), F.lit(window)).alias("n")).distinct().collect())  # at most `window` numbers
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    if not lengths:
        none = own.select("doc_id", "th").limit(0)
        return none.withColumns({"start": F.lit(0), "length": F.lit(0)}), none.withColumn("item_id", F.lit(None).cast(benchmark.schema["item_id"].dataType))

    def of_length(n: int, body) -> Column:
        fits = F.size("words") >= window if n == window else F.size("words") == n
        return F.when(fits, body(n)).otherwise(F.slice(body(n), 1, 0))

    every = lambda n: windows_at(F.col("words"), n, F.sequence(F.lit(0), F.greatest(F.size("words") - n, F.lit(0))))
    spans = items.select("item_id", F.explode(F.concat(*[of_length(n, every) for n in lengths])).alias("w")).select("item_id", "w.length", "w.window").distinct()
    spans = cut(spans)
    own_anchor = lambda n: F.transform(window_anchors(F.col("words"), n), lambda a: F.struct(F.lit(n).alias("length"), a.alias("anchor")))
    anchors = items.select(F.explode(F.concat(*[of_length(n, own_anchor) for n in lengths])).alias("a")).select("a.*").distinct()
    anchors = bounded(anchors, broadcast_rows)

    distinct = lambda n: F.transform(F.array_distinct(window_anchors(F.col("words"), n)), lambda a: F.struct(F.lit(n).alias("length"), a.alias("anchor")))
    emitted = own.select("doc_id", "th", words_of(F.col("text")).alias("words"))
    emitted = emitted.select("doc_id", "th", F.explode(F.concat(*[distinct(n) for n in lengths])).alias("a")).select("doc_id", "th", "a.*")
    met = emitted.join(anchors, ["length", "anchor"], "left_semi")
    met = met.groupBy("doc_id", "th").agg(F.collect_set(F.struct("length", "anchor")).alias("met"))  # at most a document's own anchors

    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.th") == F.col("m.th"))
    found = own.alias("d").join(met.alias("m"), same).select("d.doc_id", "d.th", words_of(F.col("d.text")).alias("words"), "met")

    def extended(n: int) -> Column:
        wanted = F.transform(F.filter("met", lambda m: m["length"] == n), lambda m: m["anchor"])
        flagged = F.transform(window_anchors(F.col("words"), n), lambda a, i: F.when(F.array_contains(F.col(f"wanted_{n}"), a), i))
        return wanted, windows_at(F.col("words"), n, F.filter(flagged, lambda i: i.isNotNull()))

    found = found.withColumns({f"wanted_{n}": extended(n)[0] for n in lengths})
    found = found.select("doc_id", "th", F.explode(F.concat(*[extended(n)[1] for n in lengths])).alias("w")).select("doc_id", "th", "w.*")
    distinct_windows = spans.select("length", "window").distinct()
    hits = cut(found.join(bounded(distinct_windows, broadcast_rows), ["length", "window"], "left_semi"))
    owners = hits.select("doc_id", "th", "length", "window").distinct().join(spans, ["length", "window"]).select("doc_id", "th", "item_id").distinct()
    return hits.select("doc_id", "th", "start", "length"), owners


def covered(spans: Column) -> Column:
    """Number of words in the union of (start, length) spans sorted by start."""
    def step(acc: Column, s: Column) -> Column:
        end = s["start"] + s["length"]
        return F.struct(
            F.greatest(acc["end"], end).alias("end"),
            (acc["n"] + F.greatest(end - F.greatest(s["start"], acc["end"]), F.lit(0))).alias("n"),
        )

    return F.aggregate(spans, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda acc: acc["n"]).cast("long")


def judge(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = SHARE) -> DataFrame:
    """Per document row: doc_id, th, n_words, n_hit, items (their ids as sorted strings, without null) and contaminated."""
    places, owners = overlaps(docs, benchmark, window)
    hit = places.groupBy("doc_id", "th").agg(covered(F.sort_array(F.collect_set(F.struct("start", "length")))).alias("n_hit"))
    owned = owners.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    found = hit.alias("a").join(owned.alias("b"), F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th")))
    found = found.select("a.doc_id", "a.th", "n_hit", "items")
    base = docs.select("doc_id", F.xxhash64("text").alias("th"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    joined = base.alias("d").join(found.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.th") == F.col("f.th")), "left")
    n_hit = F.coalesce("f.n_hit", F.lit(0)).cast("long")
    return joined.select(
        "d.doc_id",
        "d.th",
        "d.n_words",
        n_hit.alias("n_hit"),
        F.coalesce("f.items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * share >= F.col("d.n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with all their columns. Null texts have no words and stay; repeated rows stay or go together."""
    bad = judge(docs.select("doc_id", "text"), benchmark).filter("contaminated").select("doc_id", "th").distinct()
    bad = bad.select(F.col("doc_id").alias("__bad_id"), F.col("th").alias("__bad_th"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("__bad_id")) & (F.xxhash64(docs["text"]) == F.col("__bad_th")), "left_anti")


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """Judge every whole text of documents against benchmark."""
    judged = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
lens AS (SELECT DISTINCT least(len(w), 13) AS n FROM b WHERE len(w) > 0),
bp AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(0, len(w) - least(len(w), 13) + 1)) AS s FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s + 1 : s + n], ' ') AS win FROM bp),
dp AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, lens WHERE len(w) >= n),
dw AS (SELECT doc_id, n, s, array_to_string(w[s + 1 : s + n], ' ') AS win FROM dp),
hit AS (SELECT dw.doc_id, dw.s, dw.n, bw.item_id FROM dw JOIN bw USING (n, win)),
pos AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hit),
nh AS (SELECT doc_id, count(*) AS n_hit FROM pos GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, list_aggregate(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), 'string_agg', ',') AS ids FROM hit GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN nh USING (doc_id) LEFT JOIN it USING (doc_id)
"""
