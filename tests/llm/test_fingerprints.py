"""Bottom-k sketches against Python sets; the chain of next documents on odd ids."""

import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from factlode.llm import fingerprints as fp


def shingles(text):
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    out = set()
    for i in range(max(len(words) - 4, min(len(words), 1))):
        h = 42
        for v in words[i : i + 5]:
            h = xxhash.xxh64_intdigest(v.to_bytes(8, "little"), h)
        out.add(h >> 32)
    return out


def brute(rows):
    """rows: (doc_id, text) without null ids and repeated ids."""
    rows = sorted((i, t or "") for i, t in rows)
    out = {}
    for n, (i, t) in enumerate(rows):
        nxt, q = rows[(n + 1) % len(rows)][1], len(t) // 4
        e = t[: len(t) - q] + nxt[:q]
        a, b, c = (sorted(shingles(x))[:128] for x in (t, e, nxt))
        like = lambda x, y: 1.0 if not x and not y else len(set(sorted(set(x) | set(y))[:128]) & set(x) & set(y)) / len(sorted(set(x) | set(y))[:128])
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), "".join(f"{v:08x}" for v in a), "".join(f"{v:08x}" for v in b), round(like(a, b), 9), round(like(a, c), 9))
    return out


def got(df):
    return {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect()}


def test_query_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got(fp.op2_fingerprints(spark, "/root/testdata/sf0.001")) == brute([(r.doc_id, r.text) for r in df.collect()])


@pytest.mark.parametrize("buckets", [1, 3, 64])
def test_sparse_ids(spark, buckets):
    ids = [-(10**17), -3, 0, 1, 2, 3, 500, 501, 10**15, 10**15 + 1, 9 * 10**18]
    df = spark.createDataFrame([(i, None if n == 4 else f"text {n} " * (n % 4)) for n, i in enumerate(ids)], "doc_id long, text string").repartition(3)
    chained = fp.with_next(df.withColumns({"__order": F.lit(0)}), ["doc_id"], buckets)
    assert {r.doc_id: r.next_doc_id for r in chained.collect()} == dict(zip(ids, ids[1:] + ids[:1], strict=True))


def test_edges(spark, hard, clashing, empty):
    out = fp.fingerprint_documents(hard).collect()
    assert len(out) == 11 and all(r.fingerprint is not None and 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in out)
    twins = [r.fingerprint for r in out if r.doc_id in (1, 2)]
    assert len(twins) == 3 and len(set(twins)) == 1
    assert fp.fingerprint_documents(empty).count() == 0 and fp.fingerprint_documents(clashing).count() == 11
    alone = fp.fingerprint_documents(spark.createDataFrame([(None, "a b c d e f")], "doc_id long, text string")).first()
    assert alone.near_next == 1.0


def test_merge_and_estimates(spark):
    texts = [("x", " ".join(f"w{i}" for i in range(a, a + 900))) for a in (0, 300, 600)] + [("y", "")]
    df = spark.createDataFrame(texts, "k string, t string").withColumn("s", fp.sketch(F.col("t")))
    merged = {r.k: r.s for r in fp.merge_groups(df, ["k"], "s", salts=3).collect()}
    assert merged == {"x": sorted(set().union(*(shingles(t) for k, t in texts if k == "x")))[:128], "y": []}
    a, b = texts[0][1], texts[1][1]
    row = spark.createDataFrame([(a, b)], "a string, b string").select(fp.sketch(F.col("a")).alias("a"), fp.sketch(F.col("b")).alias("b"))
    r = row.select(fp.resemblance(F.col("a"), F.col("b")).alias("j"), fp.containment(F.col("a"), F.col("b")).alias("c"), fp.distinct_count(F.col("a")).alias("n")).first()
    sa, sb = shingles(a), shingles(b)
    assert abs(r.j - len(sa & sb) / len(sa | sb)) < 0.15 and abs(r.c - len(sa & sb) / len(sa)) < 0.2 and abs(r.n / len(sa) - 1) < 0.3
