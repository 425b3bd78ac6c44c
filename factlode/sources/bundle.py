"""Bundles: sorted JSON lines per kind of object with a manifest of hashes, and their verification."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1
#: Absolute paths of machines, which a bundle must not hold.
ABSOLUTE = r"""(^|["\s=(])(/(home|Users|root|var|tmp|opt)/|[A-Za-z]:\\\\)"""


def canonical(df: DataFrame) -> Column:
    """A row as compact JSON with its fields in alphabetical order; nulls are kept."""
    return F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})


def digest(lines: DataFrame) -> DataFrame:
    """(records, sha256) of lines (key, line): SHA-256 over the rows' hashes in order of key.

    Each row is hashed where it is; only hashes meet in one place, in blocks by the first digit of their position.
    """
    ranked = lines.select("key", F.sha2(F.col("line").cast("binary"), 256).alias("h"))
    blocks = ranked.groupBy(F.substring(F.sha2(F.col("key").cast("binary"), 256), 1, 2).alias("block")).agg(
        F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("key", "h"))), lambda x: x["h"]), "").cast("binary"), 256).alias("h")
    )
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "h"))), lambda x: x["h"]), "")
    return blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.sha2(joined.cast("binary"), 256).alias("sha256"))


def write(frames: dict[str, tuple[DataFrame, str]], folder: str) -> DataFrame:
    """Write kinds (frame, id column) as sorted JSON lines below the folder, with a manifest (kind, id, records, sha256, version)."""
    spark, rows = None, []
    for kind in sorted(frames):
        df, key = frames[kind]
        spark = df.sparkSession
        lines = df.select(F.col(key).cast("string").alias("key"), canonical(df).alias("line"))
        lines.orderBy("key", "line").select("line").write.mode("overwrite").text(f"{folder}/{kind}.jsonl")
        found = digest(lines).first()
        rows.append((kind, key, found.records, found.sha256, VERSION))
    manifest = spark.createDataFrame(rows, "kind string, id string, records long, sha256 string, version int")
    manifest.coalesce(1).write.mode("overwrite").json(f"{folder}/manifest.json")
    return manifest


def read(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Lines of a kind."""
    return spark.read.text(f"{folder}/{kind}.jsonl").select(F.col("value").alias("line"))


def verify(spark: SparkSession, folder: str, references: list[tuple[str, str, str]] = ()) -> DataFrame:
    """Findings of a bundle: (kind, check, findings), none if it is sound.

    Checks: hash and count against the manifest, repeated ids, references (kind, field, other kind) without a
    target, and absolute paths.
    """
    manifest = spark.read.json(f"{folder}/manifest.json").collect()  # a row for each kind
    keys = {m["kind"]: m["id"] for m in manifest}
    out = []

    def finding(df: DataFrame, kind: str, check: str) -> None:
        out.append(df.agg(F.count("*").alias("findings")).select(F.lit(kind).alias("kind"), F.lit(check).alias("check"), "findings"))

    lines = {}
    for m in manifest:
        kind = m["kind"]
        one = read(spark, folder, kind).withColumn("key", F.get_json_object("line", f"$.{m['id']}"))
        lines[kind] = one
        now = digest(one.select("key", "line"))
        finding(now.filter((F.col("sha256") != m["sha256"]) | (F.col("records") != m["records"])), kind, "manifest")
        finding(one.groupBy("key").count().filter("count > 1 or key is null"), kind, "unique-id")
        finding(one.filter(F.col("line").rlike(ABSOLUTE)), kind, "absolute-path")
    for kind, field, other in references:
        wanted = lines[kind].select(F.get_json_object("line", f"$.{field}").alias("key")).filter("key is not null").distinct()
        finding(wanted.join(lines[other].select("key"), "key", "left_anti"), kind, f"reference:{field}")
    every = out[0]
    for more in out[1:]:
        every = every.unionByName(more)
    assert set(keys) == set(lines)
    return every.filter("findings > 0")


def page(sections: DataFrame, notes: str = "") -> DataFrame:
    """Markdown pages from sections (page, ordinal, title, body): (page, markdown); notes come under their own heading."""
    part = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.coalesce("body", F.lit("")), F.lit("\n"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ordinal", part.alias("p")))), lambda x: x["p"]), "\n")
    tail = f"\n## Notes\n\n{notes}\n" if notes else ""
    return sections.groupBy("page").agg(F.concat(F.lit("# "), F.first("page"), F.lit("\n\n"), body, F.lit(tail)).alias("markdown"))


def merge_projects(rows: DataFrame, key: str, order: str = "project_order") -> DataFrame:
    """Artifacts of several projects united; of equal keys the first project's row stays."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("__r")).select(key, "__r.*")


def dumps(value: object) -> str:
    """Canonical JSON of a small driver-side value."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
