"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, shared_folder

__all__ = ["SPACED_WORD", "ascii_lower", "cut", "n_parts", "prefix_sums", "release", "shared_folder"]

#: Words between ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, and no other letter; texts of ASCII alone take the fast path."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def n_parts(df: DataFrame, floor: int = 1) -> int:
    """The session's shuffle width."""
    return max(floor, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffles and checkpoints that nothing refers to, which it does only when the driver's JVM collects its garbage.

    After a cut these are the shuffles that led to it, if no variable holds the frame that was cut.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def prefix_sums(values: Column) -> Column:
    """Inclusive running sums of an array of ints, in blocks of about the square root of its length."""
    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda acc, x: acc + x)

    def of(a: Column) -> Column:
        block = F.ceil(F.sqrt(F.size(a).cast("double"))).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(a) / block).cast("int") - 1), lambda j: F.slice(a, j * block + 1, block))
        offsets = F.transform(F.array(F.transform(blocks, total)), lambda sums: F.transform(sums, lambda _, j: total(F.slice(sums, 1, j))))[0]
        inner = F.zip_with(blocks, offsets, lambda b, o: F.transform(b, lambda _, i: o + total(F.slice(b, 1, i + 1))))
        return F.when(F.size(a) == 0, F.slice(a, 1, 0)).otherwise(F.flatten(inner))

    return F.transform(F.array(values), of)[0]
