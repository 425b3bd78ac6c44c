"""SimHash near-duplicates by a byte-position inverted index.

A 64-bit fingerprint has 8 positional bytes. Two fingerprints that differ in at most 4 bits share at least 4
of them. Lists of a single positional byte would tally a pair for every 32nd of all pairs, so the lists are kept for
the 70 choices of 4 positional bytes: a pair that shares m bytes meets in C(m, 4) lists, at least once exactly if it
reaches the minimum of 4 shared bytes. Pairs that meet are verified by counting bits.

A list is searched as a whole: it yields a spanning forest of its links, never all its pairs. Lists that are too
long for one task are split over the points within 2 bits of each member: two fingerprints are within 4 bits exactly
if they share such a point, so linking members to the least member at each point keeps every component.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import likeness
from ._common import cut, release
from .components import components, of_group

SHINGLE = 4
SEED = 42
MAX_BITS = 4
#: Members up to which a list is searched in one task; longer lists go over the points around their members.
LIST_LIMIT = 4096
#: Shingles that are counted at once.
BLOCK = 1 << 15


def simhash(text: bytes) -> int:
    """Signed 64-bit fingerprint of a text (A-Z lower-cased): bit i is set in over half the shingles' XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return int(np.uint64(xxhash.xxh64_intdigest(joined, SEED)).view(np.int64))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - SHINGLE + 1].tolist()
    stops = ends[SHINGLE - 1 :].tolist()
    digest, n = xxhash.xxh64_intdigest, len(starts)
    counts = np.zeros(64, np.int64)
    for first in range(0, n, BLOCK):
        pairs = zip(starts[first : first + BLOCK], stops[first : first + BLOCK], strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in pairs], np.uint64)
        counts += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0].astype(np.uint64).view(np.int64))


def forest(members: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Edges (member, root) that connect distinct members exactly as all links within max_bits do."""
    rest = members.view(np.uint64)
    out: list[tuple[int, int]] = []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        open_nodes, name = [root], int(root.view(np.int64))
        while open_nodes and len(rest):
            near = np.bitwise_count(rest ^ open_nodes.pop()) <= max_bits
            if near.any():
                found = rest[near]
                out += [(int(x), name) for x in found.view(np.int64)]
                open_nodes += list(found)
                rest = rest[~near]
    return out


def links(fingerprints: DataFrame, max_bits: int = MAX_BITS, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Edges (a, b) with the components of all links within max_bits (0, 2 or 4). fingerprints: distinct (fp)."""
    if max_bits not in (0, 2, 4):
        raise ValueError("four shared bytes are guaranteed up to 4 bits, and points halfway need an even number")
    masks = [sum(0xFF << 8 * p for p in chosen) for chosen in combinations(range(8), 4)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    cells = F.array(*[F.struct(F.lit(i).cast("byte").alias("choice"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)])
    listed = fingerprints.select("fp", F.explode(cells).alias("c")).select("fp", "c.*")
    # lists are counted by partial sums; a byte of the key is a join key more, so that adaptive execution can split a long list
    byte = F.col("key").bitwiseXOR(F.shiftright("key", 32)).bitwiseAND(F.lit(255))
    counted = listed.groupBy("choice", "key").agg(F.count("*").alias("n")).filter("n > 1")
    # both ends below read what is left of the lists, and neither makes the cells again
    listed = cut(listed.withColumn("byte", byte).join(counted.withColumn("byte", byte), ["byte", "choice", "key"]).drop("byte"))
    release(fingerprints.sparkSession)
    short = listed.filter(F.col("n") <= list_limit).groupBy("choice", "key").agg(F.collect_list("fp").alias("members"))  # list_limit at most

    @F.pandas_udf("array<struct<a:bigint,b:bigint>>")
    def search(lists: pd.Series) -> pd.Series:
        def one(m: np.ndarray) -> list[dict]:
            if len(m) == 2:
                a, b = (int(x) for x in m)
                return [{"a": a, "b": b}] if ((a ^ b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= max_bits else []
            return [{"a": a, "b": b} for a, b in forest(np.sort(np.asarray(m, np.int64)), max_bits)]

        return pd.Series([one(m) for m in lists])

    near = short.select(F.explode(search("members")).alias("e")).select("e.*").distinct()
    long_members = listed.filter(F.col("n") > list_limit).select("fp").distinct()
    half = max_bits // 2
    flips = [sum(1 << b for b in chosen) for size in range(half + 1) for chosen in combinations(range(64), size)]
    points = F.split(F.lit(",".join(str(m - (1 << 64) if m >> 63 else m) for m in flips)), ",").cast("array<bigint>")
    around = long_members.select("fp", F.explode(points).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    least = around.groupBy("point").agg(F.min("fp").alias("least"), F.count("*").alias("n")).filter("n > 1")
    around = of_group(around, least, "point").filter("least <> fp")
    return near.unionByName(around.select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct())


@F.pandas_udf(T.LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    """simhash() of each text; 0 for null."""
    return pd.Series([simhash(t.encode()) if t else 0 for t in texts], dtype="int64")


def with_components(marked: DataFrame, max_bits: int = MAX_BITS, list_limit: int = LIST_LIMIT) -> DataFrame:
    """Rows with doc_id and fp, and component_id, the least doc_id reachable by links.

    Null doc_ids take part but never name a component unless it has no other; repeated rows stay.
    """
    firsts = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = components(links(firsts.select("fp"), max_bits, list_limit))
    named = firsts.join(groups, firsts["fp"] == groups["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    lookup = cut(of_group(named, names, "component").select(F.col("fp").alias("__fp"), "component_id"))
    return marked.join(lookup, marked["fp"] == lookup["__fp"]).drop("__fp")


def meetings(docs: DataFrame, max_bits: int = MAX_BITS, list_limit: int = LIST_LIMIT) -> DataFrame:
    """(a, b): texts (likeness.text_key) that the index brings together, with no more rows than texts and links.

    Texts of one fingerprint meet the least of them, and the least texts of linked fingerprints each other.
    """
    marked = cut(docs.select(likeness.text_key().alias("th"), fingerprint("text").alias("fp")).dropDuplicates(["th"]))
    firsts = cut(marked.groupBy("fp").agg(F.min("th").alias("least")))
    met = links(firsts.select("fp"), max_bits, list_limit)
    for end in "ab":
        met = of_group(met, firsts.select(F.col("fp").alias(end), F.col("least").alias(f"of_{end}")), end)
    same = of_group(marked, firsts, "fp").filter("th <> least").select(F.col("th").alias("a"), F.col("least").alias("b"))
    return same.unionByName(met.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")))


def _near_copies(docs: DataFrame) -> DataFrame:
    """(th, component): texts that meet in the index and are alike as whole shingle sets, and those of more than MAX_BITS that likeness finds beside."""
    return likeness.groups(docs, meetings(docs))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """docs (any columns, with doc_id and text) with fp and component_id, the least doc_id of the text's near copies; see likeness.groups.

    Null doc_ids take part but never name a component unless it has no other. Texts without words are copies of each
    other. Columns named fp and component_id are replaced.
    """
    marked = docs.drop("component_id").withColumn("fp", fingerprint("text")).withColumn("__own", likeness.text_key())
    firsts = docs.groupBy(likeness.text_key().alias("th")).agg(F.min("doc_id").alias("least"))
    named = cut(firsts.join(_near_copies(docs), "th", "left").select("th", "least", F.coalesce("component", "th").alias("component")))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    lookup = of_group(named, names, "component").select(F.col("th").alias("__th"), "component_id")
    return marked.join(lookup, marked["__own"] == lookup["__th"]).drop("__own", "__th")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies (found by fingerprints, then likeness.groups), that with the least doc_id, with all its columns.

    A repeated row of that document goes too. Of a group without doc_ids the row with the least xxhash64 of its
    text stays.
    """
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), likeness.text_key().alias("th"))
    firsts = docs.groupBy(likeness.text_key().alias("th")).agg(F.min(place).alias("least"))
    named = firsts.join(_near_copies(docs), "th", "left").select("least", F.coalesce("component", "th").alias("component"))
    heads = cut(named.groupBy("component").agg(F.min("least").alias("h")).select(F.col("h.id").alias("__id"), F.col("h.th").alias("__th")))
    del named
    release(docs.sparkSession)  # before the texts are shuffled
    # plain keys, so that the join and the removal of repeated rows share one shuffle of the texts
    keys = lambda id, th: {"__none": id.isNull(), "__id": F.coalesce(id.cast("string"), F.lit("")), "__th": th}
    heads = heads.select(*[c.alias(n) for n, c in keys(F.col("__id"), F.col("__th")).items()])
    kept = docs.withColumns(keys(F.col("doc_id"), likeness.text_key())).join(heads, ["__none", "__id", "__th"])
    return kept.dropDuplicates(["__none", "__id", "__th"]).select(*docs.columns)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # the fingerprints are kept without the texts, as both the links and the result need them
    found = with_components(cut(docs.select("doc_id", fingerprint("text").alias("fp"))))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
