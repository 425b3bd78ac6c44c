"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, release


def of_group(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """Inner join of rows with what an aggregation by key says of each group.

    A byte of the key's hash is a join key more: both sides are then dealt for the join alone, not as the aggregation left
    them, and adaptive execution can split a group with very many rows.
    """
    byte = F.pmod(F.xxhash64(F.col(key)), F.lit(256))
    return rows.withColumn("__byte", byte).join(groups.withColumn("__byte", byte), ["__byte", key]).drop("__byte")


def _least(near: DataFrame) -> DataFrame:
    """(u, m): the least node among each node's neighbours and itself. near: (u, v)."""
    return near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _are_stars(e: DataFrame) -> bool:
    """Whether each u has one v, which is no u: as v < u, it is then the least of its component. e: (u, v), distinct."""
    ends = e.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    return ends.groupBy("node").agg(F.sum("up").alias("many"), F.min("up").alias("low")).filter("many > 1 or many > low").isEmpty()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that has an edge; component is the least node reachable.

    edges: (a, b), any order, repeats and loops allowed; components of some edges, as (node, component), stand for
    those. Nothing but whether the edges are stars comes to the driver; each round's edges are checkpointed, and
    the shuffles behind them released.
    """
    e = cut(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())

    for _ in range(max_rounds):
        release(edges.sparkSession)
        if _are_stars(e):
            roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = of_group(both, _least(both), "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v")  # repeats, no more than e has rows, go with those of the small stars
        least = _least(large)
        small = of_group(large, least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = cut(small.filter("u <> v").distinct())
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
