"""Near copies against brute-force Jaccard, on planted copies and on given tables."""

import random
import re
import time

from factlode import session
from factlode.llm import _common, components, likeness, simhash

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) * 5 >= len(sets[i] | sets[j]) * 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


def planted():
    rnd = random.Random(3)
    out = []
    for _ in range(30):
        base = [f"v{rnd.randrange(3000)}" for _ in range(rnd.randint(3, 300))]
        for _ in range(6):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 30))):
                w[rnd.randrange(len(w))] = f"u{rnd.randrange(1000)}"
            out.append(rnd.choice([" ", "\n", "  "]).join(w).upper() if rnd.random() < 0.2 else " ".join(w))
    rnd.shuffle(out)
    return list(enumerate(out)) + [(900, ""), (901, None), (902, " \t")]


def test_planted_copies(spark):
    rows = planted()
    want = brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == want
    assert {r.doc_id for r in simhash.keep_one(df).collect()} == set(want.values()) and len(set(want.values())) < 150
    marked = simhash.with_components(df.withColumn("fp", simhash.fingerprint("text"))).collect()
    assert {r.doc_id: r.component_id for r in marked} != want


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = brute(sorted((r.doc_id, r.text) for r in docs.collect()))
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == set(want.values())
    assert likeness.groups(docs.limit(0)).count() == 0


def test_large_group_of_variants_against_brute_force(spark):
    """Variants of one text, most too different from each other, and copies of them: chains through any of them count."""
    rnd = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(240):
        w = list(base)
        for _ in range(rnd.choice((0, 1, 2, 3, 4, 6, 9))):
            w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
        rows.append((i, " ".join(w[rnd.choice((0, 0, 7)) :])))
    rows += [(1000 + i, t) for i, t in rows[:40]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows)
    assert 10 < len(set(want.values())) < 200
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()} == want


def test_copies_come_through_the_index_of_fingerprints(spark, monkeypatch):
    rnd = random.Random(4)
    base = [f"v{rnd.randrange(3000)}" for _ in range(400)]
    rows = [(i, " ".join(base[:390] + [f"u{j}" for j in range(390, 390 + i)])) for i in range(6)] + [(6, " ".join(base[::-1])), (7, ""), (8, "  ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    texts = {r.th: r.text for r in df.select(likeness.text_key().alias("th"), "text").collect()}
    met = [(texts[r.a], texts[r.b]) for r in simhash.meetings(df).collect()]
    assert {"", "  "} in [set(pair) for pair in met] and rows[6][1] not in {t for pair in met for t in pair}
    # without the bands the pairs of the fingerprints alone are compared and linked
    monkeypatch.setattr(likeness, "_band_lists", lambda keyed: keyed.limit(0).selectExpr("th as id", "th", "th as least"))
    kept = {r.doc_id for r in simhash.keep_one(df).collect()}
    assert set(brute(rows).values()) <= kept and not {5, 8} <= kept and len(kept) < 8


def test_no_step_finds_the_shuffles_of_those_before(spark, monkeypatch):
    rnd = random.Random(6)
    base = [f"v{rnd.randrange(3000)}" for _ in range(200)]
    df = spark.createDataFrame([(i, " ".join(base[: 200 - i] + [f"u{i}x{j}" for j in range(i)])) for i in range(40)], "doc_id long, text string")
    alive = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size
    _common.release(spark)
    time.sleep(1)
    few, seen = alive() + 16, []

    def watched(frame):
        end = time.monotonic() + 1  # Spark deletes them in a thread of its own
        while alive() > few and time.monotonic() < end:
            time.sleep(0.05)
        seen.append(alive())
        return session.cut(frame)

    for module in (likeness, simhash, components):
        monkeypatch.setattr(module, "cut", watched)
    assert 0 < simhash.keep_one(df).count() < 40
    assert len(seen) > 10 and max(seen) <= few, (few, seen)
