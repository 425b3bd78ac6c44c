"""Near copies by the Jaccard likeness of five-word shingles.

Texts meet in lists by bands of min-hashes and are linked only if their whole shingle sets are alike. Two texts of
likeness 0.8 share a band of 4 hashes with probability 0.41, so all 32 bands miss them in 5 of 10^8 cases.

A list is never compared pair by pair. Its members first meet the least of them, then some members of the component that
most of the list is in. Texts of lists that still hold several components meet by their prefixes: of two sets of likeness
0.8, each sorted by how rare its shingles are among these texts, the first fifths share a shingle. Variants of one text
that differ too much have only shingles of their own there, so a large group of them makes no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _words
from ._common import cut, release
from .components import components, of_group

SHINGLE = 5
BANDS = 32
ROWS = 4
#: Members of a list's main component that its other members meet.
PIVOTS = 4
_SCALE = np.random.default_rng(5).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = np.random.default_rng(8).integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def text_key() -> Column:
    """What names a text: the hash of column text, where null is an empty text."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the shingles of all texts, those of text i from first[i] to first[i + 1]; a shorter text is one shingle, A-Z count as a-z."""
    w = _words.words([t.lower() for t in texts], _words.SPACED)
    n = np.diff(w.first)
    running, unshift = _words.spans_hash(w.hash, _words.BASES[1])
    many = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    first = np.concatenate([[0], np.cumsum(many)])
    start = np.arange(first[-1]) - np.repeat(first[:-1], many) + np.repeat(w.first[:-1], many)
    stop = start + np.repeat(np.minimum(n, SHINGLE), many)
    return _words.mix((running[stop] - running[start]) * unshift[start]), first


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In: th, text. Out: th and the distinct shingles."""
    for rows, texts in _words.sliced(batches, "text"):
        sets = []
        for _, some in _words.groups(texts):
            x, first = shingles(some)
            sets += [np.unique(x[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([rows["th"], pa.array(sets, pa.list_(pa.int64()))], ["th", "shingles"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In: th, text. Out: th and a key for each band; texts without words share theirs."""
    for rows, texts in _words.sliced(batches, "text"):
        keys = []
        for _, some in _words.groups(texts):
            x, first = shingles(some)
            filled = np.flatnonzero(np.diff(first))
            key = np.zeros((len(some), BANDS), np.uint64)
            for i in range(BANDS * ROWS if len(filled) else 0):
                least = np.minimum.reduceat(x * _SCALE[i] + _SHIFT[i], first[filled])
                key[filled, i // ROWS] = _words.mix(key[filled, i // ROWS] * _SCALE[0] + least)
            keys += list(key.view(np.int64))
        yield pa.RecordBatch.from_arrays([rows["th"], pa.array(keys, pa.list_(pa.int64()))], ["th", "keys"])


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of likeness 0.8 or more. sets: (th, shingles)."""
    side = lambda name: sets.select(F.col("th").alias(name), F.col("shingles").alias(f"of_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.filter(shared * 9 >= (F.size("of_a") + F.size("of_b")) * 4).select("a", "b")


def _band_lists(keyed: DataFrame) -> DataFrame:
    """(id, th, least): the lists of two texts and more, each with its least member. keyed: (th, text), copies too."""
    # copies go after their bands are known, which are far shorter than the texts
    marked = keyed.mapInArrow(_bands, "th long, keys array<long>").groupBy("th").agg(F.first("keys").alias("keys"))
    listed = marked.select("th", F.posexplode("keys").alias("band", "key")).select(F.xxhash64("band", "key").alias("id"), "th")
    many = listed.groupBy("id").agg(F.min("th").alias("least"), F.max("th").alias("most")).filter("least < most").select("id", "least")
    return of_group(listed, many, "id")


def _placed(lists: DataFrame, named: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, th, c, n) of the lists whose members are in several components; n is the number of a text's shingles. named: (node, component)."""
    placed = lists.select("id", "th").join(named.withColumnRenamed("node", "th"), "th", "left").select("id", "th", F.coalesce("component", "th").alias("c"))
    mixed = placed.groupBy("id").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("id")
    found = cut(of_group(placed, mixed, "id").join(sizes, "th").select("id", "th", "c", "n"))
    release(lists.sparkSession)
    return found


def _near(a: str, b: str) -> Column:
    """Whether sets of these sizes can be of likeness 0.8."""
    return F.least(a, b) * 5 >= F.greatest(a, b) * 4


def _to_pivots(placed: DataFrame) -> DataFrame:
    """Pairs (a, b) of each list's members outside its main component with PIVOTS members of that."""
    main = placed.groupBy("id", "c").agg(F.count("*").alias("rows"), *[F.min_by(F.struct("th", "n"), F.xxhash64("th", F.lit(i))).alias(f"p{i}") for i in range(PIVOTS)])
    pivots = F.array(*[f"p{i}" for i in range(PIVOTS)])
    main = main.groupBy("id").agg(F.max_by(F.struct(F.col("c").alias("main"), pivots.alias("pivots")), F.struct("rows", "c")).alias("m")).select("id", "m.*")
    met = of_group(placed, main, "id").filter("c <> main").select("th", "n", F.explode("pivots").alias("p"))
    return met.filter(_near("n", "p.n")).select(F.col("th").alias("a"), F.col("p.th").alias("b")).distinct()


def _by_prefix(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of texts in different components whose sets, rarest shingles first, share one in the part that likeness 0.8 needs."""
    texts = placed.groupBy("th").agg(F.first("c").alias("c"), F.first("n").alias("n"))
    each = cut(sets.join(texts, "th").select("th", "c", "n", F.explode("shingles").alias("s")))
    release(sets.sparkSession)
    rows = each.groupBy("s").agg(F.count("*").alias("rows"), F.min("c").alias("low"), F.max("c").alias("high"))
    # a set of n shingles shares at least 4 n / 5 of them with one of likeness 0.8, so one of any n / 5 + 1
    order = F.sort_array(F.collect_list(F.struct("rows", "s", (F.col("low") < F.col("high")).alias("mixed"))))  # a text's own
    prefix = of_group(each, rows, "s").groupBy("th", "c", "n").agg(order.alias("o"))
    prefix = prefix.select("th", "c", "n", F.posexplode(F.slice("o", 1, F.col("n") - F.ceil(F.col("n") * 4 / 5).cast("int") + 1)).alias("at", "x"))
    prefix = cut(prefix.filter("x.mixed").select("th", "c", (F.col("n") - F.col("at")).alias("left"), "n", F.col("x.s").alias("s")))
    del each, rows
    release(sets.sparkSession)
    main = prefix.groupBy("s", "c").count().groupBy("s").agg(F.max_by("c", F.struct("count", "c")).alias("main"))
    minor = of_group(prefix, main, "s").filter("c <> main").select("s", *[F.col(c).alias(f"{c}_a") for c in ("th", "c", "n", "left")])
    other = prefix.select("s", *[F.col(c).alias(f"{c}_b") for c in ("th", "c", "n", "left")])
    # nothing before the first shared shingle is shared, so what is left from there on must be enough
    enough = F.least("left_a", "left_b") * 9 >= (F.col("n_a") + F.col("n_b")) * 4
    met = minor.join(other, "s").filter((F.col("c_a") != F.col("c_b")) & enough)
    return met.select(F.least("th_a", "th_b").alias("a"), F.greatest("th_a", "th_b").alias("b")).distinct()


def groups(docs: DataFrame, met: DataFrame | None = None) -> DataFrame:
    """(th, component) of the texts (column text) that have a near copy; chains of near copies are one component.

    met: pairs (a, b) of texts that another index brings together; they are compared like those of the bands.
    """
    keyed = docs.select(text_key().alias("th"), F.coalesce("text", F.lit("")).alias("text"))
    lists = cut(_band_lists(keyed))
    release(docs.sparkSession)
    pairs, listed = lists.filter("th <> least").select(F.col("th").alias("a"), F.col("least").alias("b")), lists.select("th")
    if met is not None:
        met = cut(met.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
        release(docs.sparkSession)
        pairs, listed = pairs.unionByName(met), listed.unionByName(met.select(F.explode(F.array("a", "b")).alias("th")))
    sets = keyed.dropDuplicates(["th"]).join(listed.distinct(), "th", "left_semi").mapInArrow(_sets, "th long, shingles array<long>")
    sets = cut(sets)
    release(docs.sparkSession)  # the texts
    sizes = sets.select("th", F.size("shingles").alias("n"))
    named = components(_alike(pairs.distinct(), sets))
    for candidates in (_to_pivots, lambda placed: _by_prefix(placed, sets)):
        links = _alike(candidates(_placed(lists, named, sizes)), sets)
        named = components(links.unionByName(named.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    return named.withColumnRenamed("node", "th")
