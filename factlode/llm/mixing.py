"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1, piecewise linear between knots. Its integral
is the source's share of demand; the share of a source is bounded by max_epochs times its own size and
what it can't use is shared again by weight. A source is read around in a (hashed) order of its documents until its
demand is met, up to max_epochs times. The training position of a pass over a document is the time at which its
source's cumulative demand reaches the document's place in that pass.

Prefix sums run in two levels: (source, bucket of the order's hash) sums first, then the few rows of a
bucket, so a source with a third of all rows spreads over as many buckets as it needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import SPACED_WORD, cut

#: Rows that one bucket of the reading order holds on average.
ROWS_PER_BUCKET = 4096
#: Hexadecimal digits of the order hash that name a bucket, at most (16 ** 6 buckets).
MAX_DIGITS = 6

#: Knots (time, weight multiplier): sources of odd rank rise through training, those of even rank fall.
RISING = ((0.0, 0.5), (1.0, 1.5))
FALLING = ((0.0, 1.5), (1.0, 0.5))


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int], max_epochs: int = 3) -> DataFrame:
    """Shares of the total size by cyclic weight, bounded by max_epochs times each source's size.

    sizes: (source, source_size), one row a source. Sources rank by code point, null last; source r weighs
    weights[r % len(weights)]. Adds weight and target. With sources in ascending order of bound / weight, source k
    is at its bound if the remaining total over the remaining weight reaches its ratio; the level at the first
    source below its bound holds for all later ones. All sums are integers, with one division at the end.
    A source without words gets the target 0.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = sizes.withColumn("rank", rank)
    table = table.withColumn("weight", F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long"))
    table = table.withColumn("bound", F.col("source_size") * max_epochs)
    by_ratio = Window.orderBy(F.col("bound") / F.col("weight"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    table = table.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("bound").over(before), F.lit(0))).alias("left_total"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("left_weight"),
    )
    exact = lambda c: F.col(c).cast("decimal(18,0)")  # noqa: E731  the product of two sums may not fit a long
    table = table.withColumn("open", exact("left_total") * exact("weight") < exact("bound") * exact("left_weight"))
    first = F.min(F.when(F.col("open"), F.struct((F.col("bound") / F.col("weight")).alias("ratio"), "rank", "left_total", "left_weight"))).over(everything)
    table = table.withColumn("level", first)
    target = F.when(
        F.col("level").isNotNull() & (F.struct((F.col("bound") / F.col("weight")).alias("ratio"), "rank") >= F.struct(F.col("level.ratio").alias("ratio"), F.col("level.rank").alias("rank"))),
        (F.col("weight") * F.col("level.left_total")) / F.col("level.left_weight"),
    ).otherwise(F.col("bound").cast("double"))
    return table.select("source", "source_size", "rank", "weight", target.cast("double").alias("target"))


def schedule_segments(knots: Sequence[tuple[float, float]]) -> list[dict[str, float]]:
    """Integrate a schedule: per segment its times, rates and cumulative shares, scaled to a whole share of 1."""
    area = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False))
    if knots[0][0] != 0.0 or knots[-1][0] != 1.0 or area <= 0 or any(w < 0 for _, w in knots) or any(a[0] >= b[0] for a, b in zip(knots, knots[1:], strict=False)):
        raise ValueError("knots must rise in time from 0 to 1 with weights that are not negative and not all zero")
    out, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        share = (t1 - t0) * (w0 + w1) / 2 / area
        out.append({"t0": t0, "dt": t1 - t0, "r0": w0 / area, "r1": w1 / area, "c0": total, "c1": total + share})
        total += share
    return out


def invert_demand(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The time at which the integrated schedule reaches share (0..1).

    Within a segment the demand is r0 x + (r1 - r0) x^2 / (2 dt), x = time - t0; its root is written so that
    flat segments need no special case.
    """
    out = None
    for seg in schedule_segments(knots):
        need = F.greatest(share - F.lit(seg["c0"]), F.lit(0.0))
        slope = (seg["r1"] - seg["r0"]) / seg["dt"]
        root = F.sqrt(F.greatest(F.lit(seg["r0"] * seg["r0"]) + F.lit(2 * slope) * need, F.lit(0.0)))
        x = F.when(need <= 0, F.lit(0.0)).otherwise((F.lit(2.0) * need) / (F.lit(seg["r0"]) + root))
        time = F.least(F.lit(seg["t0"]) + x, F.lit(seg["t0"] + seg["dt"]))
        out = time if out is None else F.when(share < F.lit(seg["c0"]), out).otherwise(time)
    return out


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (1, 2, 3),
    max_epochs: int = 3,
    schedules: Sequence[Sequence[tuple[float, float]]] = (FALLING, RISING),
    carry: Sequence[str] = (),
    every_pass: bool = False,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Assign target words, words taken and the training positions to every document, in order of position.

    docs needs doc_id, text and source; columns named in carry come along, but for names that the result has itself. Returns doc_id,
    the carried columns, size, source_size, target, taken, position and last_position (times 0..1 of the document's first word in the
    first and in the last pass over it; null if nothing of it is taken). With every_pass there is one row for each pass over a document
    instead, with its number from 0, the words taken in it and its position: the order of training.

    A source's reading order is md5 of doc_id (of the text's md5, where that is null), then xxhash64 of text. It is read around until
    floor(target) words are taken, so the last document of the last pass may be cut; taken counts repeats and is at most
    max_epochs times size. Null text: size 0. Null source: a source of its own, after all others. Repeated rows count as
    often as they stand. An empty table gives an empty result.
    """
    own = ("doc_id", "size", "source_size", "target", "taken", "pass", "words", "position", "last_position")
    carry = [c for c in carry if c not in own]
    text = F.col("text")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.md5(text.cast("binary")), F.lit("")).cast("binary"))
    base = docs.select("doc_id", "source", word_count(text).alias("size"), order.alias("h"), F.xxhash64("text").alias("th"), *([F.struct(*carry).alias("__own")] if carry else []))
    # without texts the rows are kept for both passes over them; with them, counting words again is less than writing them
    base = base if carry else cut(base)
    rows = base.count()
    digits = 0
    while 16**digits * rows_per_bucket < rows and digits < MAX_DIGITS:
        digits += 1
    keyed = base.withColumns({"bucket": F.substring("h", 1, digits), "no_source": F.col("source").isNull(), "key": F.coalesce("source", F.lit(""))})
    place = ["no_source", "key", "bucket"]
    buckets = cut(keyed.groupBy(*place).agg(F.sum("size").alias("bucket_size")))
    goals = targets(
        buckets.groupBy("no_source", "key").agg(F.sum("bucket_size").alias("source_size")).select(F.when(~F.col("no_source"), F.col("key")).alias("source"), "source_size"),
        weights,
        max_epochs,
    ).select(F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("key"), "source_size", "target", "rank")
    ahead = Window.partitionBy("no_source", "key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("offset", F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0))).join(goals, ["no_source", "key"]).drop("bucket_size")
    within = Window.partitionBy(*place).orderBy("h", "th", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.join(buckets, place).withColumn("at", F.col("offset") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    whole = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("long")
    rest = whole - epochs * F.col("source_size")
    taken = F.col("size") * epochs + F.least(F.greatest(rest - F.col("at"), F.lit(0)), F.col("size"))
    placed = placed.withColumn("taken", taken.cast("long"))
    last = F.ceil(F.col("taken") / F.greatest(F.col("size"), F.lit(1))).cast("int") - 1  # of a document with taken words

    def position(number: Column) -> Column:
        share = F.when(F.col("target") > 0, (F.col("at") + number * F.col("source_size")) / F.col("target"))
        out = None
        for r, knots in enumerate(schedules):
            time = invert_demand(share, knots)
            out = time if out is None else F.when(F.col("rank") % len(schedules) == r, time).otherwise(out)
        return F.when(F.col("taken") > 0, F.round(out, 9))

    measures = ["size", "source_size", "target", "taken"]
    if every_pass:
        placed = placed.filter("taken > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), last)))
        words = F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size"))
        placed = placed.withColumns({"words": words, "position": position(F.col("pass"))})
        measures += ["pass", "words", "position"]
    else:
        placed = placed.withColumns({"position": position(F.lit(0)), "last_position": position(last)})
        measures += ["position", "last_position"]
    out = placed.select("doc_id", *[F.col("__own")[c].alias(c) for c in carry], *measures)
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    """Mix all documents with weights 1, 2, 3 to 100 % of all words, no source above 3 passes."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _time(place: str) -> str:
    """SQL of the time at which the schedule of a source reaches a place in its demand."""
    share = f"(CAST({place} AS DOUBLE) / target)"
    root = f"sqrt(greatest(CASE WHEN rank % 2 = 0 THEN 2.25::DOUBLE - 2.0::DOUBLE * {share} ELSE 0.25::DOUBLE + 2.0::DOUBLE * {share} END, 0.0::DOUBLE))"
    first = "CASE WHEN rank % 2 = 0 THEN 1.5::DOUBLE ELSE 0.5::DOUBLE END"
    return f"round(least(CASE WHEN {place} <= 0 THEN 0.0 ELSE 2.0::DOUBLE * {share} / ({first} + {root}) END, 1.0::DOUBLE), 9)"


ORACLE_SQL = rf"""
WITH base AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), md5(text), '')) AS h
  FROM documents),
src AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM src),
weighed AS (SELECT *, CAST(rank % 3 + 1 AS BIGINT) AS weight, source_size * 3 AS bound, CAST(source_size * 3 AS DOUBLE) / (rank % 3 + 1) AS ratio FROM ranked),
lefts AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(bound) OVER w, 0) AS left_total,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS left_weight
  FROM weighed WINDOW w AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lvl AS (SELECT * FROM lefts WHERE left_total * weight < bound * left_weight ORDER BY ratio, rank LIMIT 1),
goal AS (
  SELECT l.source, l.source_size, l.rank,
         CASE WHEN v.rank IS NOT NULL AND (l.ratio > v.ratio OR (l.ratio = v.ratio AND l.rank >= v.rank))
              THEN CAST(l.weight * v.left_total AS DOUBLE) / CAST(v.left_weight AS DOUBLE) ELSE CAST(l.bound AS DOUBLE) END AS target
  FROM lefts l LEFT JOIN lvl v ON true),
placed AS (
  SELECT b.doc_id, b.size, g.source_size, g.target, g.rank,
         CAST(coalesce(sum(b.size) OVER (PARTITION BY b.source ORDER BY b.h, b.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place
  FROM base b JOIN goal g ON b.source IS NOT DISTINCT FROM g.source),
cuts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target) AS BIGINT) // source_size ELSE 0 END AS epochs FROM placed),
took AS (
  SELECT *, CAST(size * epochs + least(greatest(CAST(floor(target) AS BIGINT) - epochs * source_size - place, 0), size) AS BIGINT) AS taken FROM cuts)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 THEN {_time("place")} END AS position,
       CASE WHEN taken > 0 THEN {_time("(place + ((taken + size - 1) // size - 1) * source_size)")} END AS last_position
FROM took
"""
