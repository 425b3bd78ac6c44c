"""Substring dedup by seed and extend.

Every 50 consecutive words hold an anchor: the least hash among their 25-word grams (winnowing). Documents are joined
on anchors that two of them share; a chance meeting of two anchors only costs time. Around each shared anchor the match
is extended both ways: the windows that the anchor stands for are compared by their words, as the cryptographic
digest (BLAKE2b, 96 bits: two of 10^12 windows agree by chance with a probability of 10^-5) of the words joined by one space. Consecutive windows that repeat the same document
are one maximal repeat. Copies of whole word sequences are settled first, by the same digest of all their words.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from . import _words
from ._common import cut

#: Words in a window, and in the grams that anchors are chosen from.
WINDOW = 50
GRAM = 25


def _anchors(w: _words.Words) -> tuple[np.ndarray, np.ndarray]:
    """(starts, anchors) of all windows that lie within one text."""
    low = _words.sliding_min(_words.grams(w.hash, GRAM), WINDOW - GRAM + 1)
    starts = np.arange(len(low))
    last = w.first[1:][w.owner[: len(low)]] if len(low) else starts
    inside = starts + WINDOW <= last
    return starts[inside], low[inside]


def _digests(pieces: Iterable[bytes]) -> np.ndarray:
    """The digest of every piece, as a structured array of a long and an int."""
    return np.frombuffer(b"".join(blake2b(p, digest_size=12).digest() for p in pieces), [("a", "<i8"), ("b", "<i4")])


def outline(texts: list[bytes]) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """Per text: number of words, the two parts of its word sequence's digest, and its distinct anchors."""
    for _, some in _words.groups(texts):
        w = _words.words(some, _words.SPACED)
        counts, ends = np.diff(w.first), _digests(b" ".join(t.split()) for t in some)
        starts, low = _anchors(w)
        bounds = np.searchsorted(starts, w.first)
        for i in range(len(some)):
            yield int(counts[i]), int(ends["a"][i]), int(ends["b"][i]), np.unique(low[bounds[i] : bounds[i + 1]]).view(np.int64)


def window_digests(text: bytes, starts: np.ndarray) -> np.ndarray:
    """Digests of the windows of a text at the given words."""
    parts = text.split()
    stops = np.cumsum([len(p) + 1 for p in parts])
    joined = b" ".join(parts)
    begins, ends = (stops[starts] - [len(parts[s]) + 1 for s in starts]).tolist(), (stops[starts + WINDOW - 1] - 1).tolist()
    return _digests(joined[a:b] for a, b in zip(begins, ends, strict=True))


def _outlines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In: doc_id, th, text. Out: doc_id, th, n_words, s1, s2, anchors."""
    for rows, texts in _words.sliced(batches, "text"):
        n, s1, s2, anchors = zip(*outline(texts), strict=True)
        columns = [rows["doc_id"], rows["th"], pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int32()), pa.array(anchors, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "n_words", "s1", "s2", "anchors"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, th, w1, w2, start) of each window whose anchor is shared. In: doc_id, th, text, shared."""
    for rows, texts in _words.sliced(batches, "text"):
        shared = rows["shared"].to_pylist()
        for first, some in _words.groups(texts):
            w = _words.words(some, _words.SPACED)
            starts, low = _anchors(w)
            owner = w.owner[starts]
            bounds = np.searchsorted(owner, np.arange(len(some) + 1))
            hit = np.zeros(len(starts), bool)
            for i in range(len(some)):
                part = slice(bounds[i], bounds[i + 1])
                hit[part] = np.isin(low[part], np.array(shared[first + i], np.int64).view(np.uint64))
            starts, owner = starts[hit], owner[hit]
            if not len(starts):
                continue
            starts = starts - w.first[owner]
            own = np.flatnonzero(np.bincount(owner, minlength=len(some)))
            both = np.concatenate([window_digests(some[i], starts[owner == i]) for i in own])
            at = pa.array(first + owner)
            columns = [rows["doc_id"].take(at), rows["th"].take(at), pa.array(both["a"]), pa.array(both["b"]), pa.array(starts.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "w1", "w2", "start"])


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows that can be judged: (doc_id, th, text). Joins on (doc_id, th) with these rows share one shuffle of the texts."""
    return docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.xxhash64("text").alias("th"), "text")


def repeats(docs: DataFrame) -> DataFrame:
    """Windows to remove: (doc_id, th, whole, found), one row a document that has any, or two if it is also a whole copy.

    th is xxhash64 of the text. whole: the smaller doc_id whose whole word sequence the document has, or null. found: (start, first)
    of each window whose words also start in a document with a smaller doc_id, the least of which is first; windows are
    judged on the input. Rows without a doc_id neither lose words nor make others lose any; of a repeated row neither is smaller.
    """
    rows = _keyed(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    outlined = rows.mapInArrow(_outlines, f"doc_id {kind}, th long, n_words long, s1 long, s2 int, anchors array<long>")
    outlined = cut(outlined.filter(F.col("n_words") >= WINDOW))
    one = F.col("s1").bitwiseAND(F.lit(255))
    # with a key beyond the aggregation's, both sides are dealt for the join alone, and adaptive execution can split hot groups
    firsts = outlined.groupBy("s1", "s2").agg(F.min("doc_id").alias("first")).withColumn("key", one)
    settled = outlined.withColumn("key", one).join(firsts, ["key", "s1", "s2"])
    copies = settled.filter(F.col("doc_id") > F.col("first")).select("doc_id", "th", F.col("first").alias("whole")).distinct()
    seeds = settled.filter(F.col("doc_id") == F.col("first")).select("doc_id", "th", F.explode("anchors").alias("anchor"))
    shared = seeds.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor")
    candidates = seeds.join(shared, "anchor", "left_semi").groupBy("doc_id", "th").agg(F.collect_set("anchor").alias("shared"))  # a document's own
    found = rows.join(cut(candidates), ["doc_id", "th"]).select("doc_id", "th", "text", "shared")
    windows = found.mapInArrow(_windows, f"doc_id {kind}, th long, w1 long, w2 int, start int")
    earliest = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("w1", "w2", "lo")
    one = F.col("w1").bitwiseAND(F.lit(255))  # a byte, as the rows are many
    removed = windows.withColumn("key", one).join(earliest.withColumn("key", one), ["key", "w1", "w2"]).filter("doc_id > lo")
    removed = removed.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", F.col("lo").alias("first"))).alias("found"))  # a document's own
    return copies.withColumn("found", F.lit(None).cast(removed.schema["found"].dataType)).unionByName(removed.withColumn("whole", F.lit(None).cast(kind)))


def maximal(starts: np.ndarray, firsts: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, place) of the maximal repeats that the windows at starts form; place is where one of its windows stands in the input."""
    order = np.argsort(starts)
    s, f = starts[order], firsts[order]
    opens = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1] + 1) | (f[1:] != f[:-1])]))
    closes = np.append(opens[1:], len(s)) - 1
    return [(int(s[a]), int(s[b]) + WINDOW, int(order[a])) for a, b in zip(opens, closes, strict=True)]


def without(text: bytes, whole: object, starts: np.ndarray, firsts: pa.Array) -> tuple[int, list[dict], int, bytes]:
    """(n_words, repeats, n_removed, kept) of a text that is a whole copy, or has repeated windows at starts, first found in firsts."""
    parts = text.split()
    n = len(parts)
    if whole is not None:
        return n, [{"start": 0, "end": n, "first": whole}], n, b""
    if not len(starts):
        return n, [], 0, b" ".join(parts)
    spans = maximal(starts, firsts.dictionary_encode().indices.to_numpy())
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, [a for a, _, _ in spans], 1)
    np.add.at(depth, [b for _, b, _ in spans], -1)
    keep = np.cumsum(depth[:-1]) == 0
    repeats = [{"start": a, "end": b, "first": firsts[i].as_py()} for a, b, i in spans]
    return n, repeats, int(n - keep.sum()), b" ".join(p for p, k in zip(parts, keep, strict=True) if k)


def _remover(kind: pa.DataType):
    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All columns but __whole and __found, and n_words, repeats, n_removed, kept."""
        spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("first", kind)]))
        for rows, texts in _words.sliced(batches, "text"):
            found = rows["__found"]
            ends = np.concatenate([[0], np.cumsum(found.value_lengths().fill_null(0).to_numpy())])
            starts, firsts = found.flatten().field("start").to_numpy(), found.flatten().field("first")
            done = [without(t, whole, starts[a:b], firsts[a:b]) for t, whole, a, b in zip(texts, rows["__whole"].to_pylist(), ends[:-1], ends[1:], strict=True)]
            n, repeats, gone, kept = zip(*done, strict=True)
            own = [c for c in rows.schema.names if c not in ("__whole", "__found")]
            columns = [rows[c] for c in own] + [pa.array(n, pa.int64()), pa.array(repeats, spans), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*own, "n_words", "repeats", "n_removed", "kept"])

    return removed


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs with n_words, repeats, n_removed and kept, the words outside all repeats joined by one space. Null text: no words.

    repeats: (start, end, first) of each maximal repeat in words from 0, end exclusive, with the least doc_id that has its windows.
    Columns of these names are replaced.
    """
    docs = docs.drop("n_words", "repeats", "n_removed", "kept")
    spans = repeats(docs.select("doc_id", "text"))
    spans = spans.groupBy(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).agg(F.max("whole").alias("__whole"), F.max("found").alias("__found"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    judged = _keyed(docs).withColumnRenamed("th", "__own") if not others else docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).withColumn("__own", F.xxhash64("text"))
    joined = judged.join(spans, (judged["doc_id"] == spans["__id"]) & (judged["__own"] == spans["__th"]), "left")
    kind = docs.schema["doc_id"].dataType
    of = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("first", kind)]))
    rest = docs.filter(F.col("doc_id").isNull() | F.col("text").isNull()).withColumns({c: F.lit(None).cast(spans.schema[c].dataType) for c in ("__whole", "__found")})
    every = joined.select(*docs.columns, "__whole", "__found").unionByName(rest)
    added = (("n_words", T.LongType()), ("repeats", of), ("n_removed", T.LongType()), ("kept", T.StringType()))
    return every.mapInArrow(_remover(to_arrow_type(kind)), T.StructType([*docs.schema.fields, *(T.StructField(c, t) for c, t in added)]))


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove repeated windows of 50 words from every whole text of documents."""
    done = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS s FROM d WHERE len(w) >= 50),
win AS (SELECT doc_id, s, array_to_string(w[s + 1 : s + 50], ' ') AS k FROM p),
early AS (SELECT k, min(doc_id) AS lo, max(doc_id) AS hi FROM win GROUP BY k HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS i FROM win JOIN early USING (k) WHERE doc_id > lo),
g AS (SELECT doc_id, list(i) AS l, count(*) AS n FROM gone GROUP BY doc_id),
x AS (SELECT d.doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d JOIN g USING (doc_id)),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.i) AS t FROM x LEFT JOIN gone ON gone.doc_id = x.doc_id AND gone.i = x.i WHERE gone.i IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN g.n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept.t, '') END) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
