"""Winnowing against brute force, with short items, repeats and odd characters."""

import random
import re

from factlode.llm import decontamination as dc

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))


def brute(docs, items):
    windows = {}
    for item, t in items:
        w = words(t)
        n = min(13, len(w))
        for s in range(len(w) - n + 1) if n and item is not None else ():
            windows.setdefault(tuple(w[s : s + n]), set()).add(str(item))
    lengths = {len(k) for k in windows}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for s in range(len(w) - n + 1):
                if tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    found |= windows[tuple(w[s : s + n])]
        out.append((i, len(w), len(hit), sorted(found), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def got(docs, items):
    return sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in dc.judge(docs, items).collect()), key=repr)


def test_against_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice(["the", "of", "Über", "x1", "naïve", "to", "and", "中", "q"]) + rnd.choice(["", "a", "b"])
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([0, 1, 2, 3, 5, 12, 13, 14, 30, 80])]
    items += [(10, items[8][1].upper()), (11, None), (None, "lost item words here"), (8, "another text of the same item that is long enough to count as well")]
    docs = []
    for i in range(50):
        w = [word() for _ in range(rnd.randint(0, 60))]
        for _ in range(rnd.randint(0, 3)):
            source = rnd.choice(items[2:10])[1].split()
            a = rnd.randint(0, max(0, len(source) - 1))
            w[len(w) // 2 : len(w) // 2] = source[a : a + rnd.randint(1, 40)]
        docs.append((i, rnd.choice([" ", ", ", "-"]).join(w)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(d, b) == brute(docs, items)
    few = items[6:]
    assert got(d, spark.createDataFrame(few, "item_id long, text string")) == brute(docs, few)


def test_without_broadcast(spark):
    d = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(40))), (2, "none")], "doc_id long, text string")
    b = spark.createDataFrame([(7, " ".join(f"w{i}" for i in range(10, 30)))], "item_id long, text string")
    places, owners = dc.overlaps(d, b, broadcast_rows=-1)
    assert places.count() == 8 and [tuple(r)[::2] for r in owners.collect()] == [(1, 7)]


def test_edges(spark, hard, clashing, empty):
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog near the river bank today"), (2, "é")], "item_id long, text string")
    pairs = [(r.doc_id, r.text) for r in hard.collect()]
    assert got(hard, items) == brute(pairs, [tuple(r) for r in items.collect()])
    assert dc.judge(empty, items).count() == 0 and dc.judge(hard, items.limit(0)).filter("n_hit > 0 or contaminated").count() == 0
    left = dc.decontaminate(clashing, items)
    assert left.columns == clashing.columns and {r.doc_id for r in left.collect()} == {3, 4, None, 5, 6, 7, 10}


def test_items_without_id(spark, as_tables):
    import duckdb

    lost = " ".join(f"w{i}" for i in range(20))
    docs = [(1, lost), (2, f"before {lost} after"), (3, "clean words"), (4, "short one"), (5, f"{lost} short one")]
    folder = as_tables(documents=spark.createDataFrame(docs, "doc_id long, text string"), benchmark=spark.createDataFrame([(None, lost), (7, "short one")], "item_id long, text string"))
    out = dc.op4_decontamination(spark, folder)
    rows = {r.doc_id: (r.n_hit, r.n_items, r.contaminated) for r in out.collect()}
    assert rows == {1: (20, 0, True), 2: (20, 0, True), 3: (0, 0, False), 4: (2, 1, True), 5: (22, 1, True)}
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet/*.parquet')")
    assert sorted(con.execute(dc.ORACLE_SQL).fetchall()) == sorted(map(tuple, out.collect()))
    left = dc.decontaminate(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))
    assert [r.doc_id for r in left.collect()] == [3]


def test_a_very_long_text_of_hits(spark):
    rnd = random.Random(7)
    text = " ".join(f"w{rnd.randrange(10**6)}" for _ in range(60_000))
    docs = spark.createDataFrame([(1, text), (2, "w1 w2")], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit) for r in dc.judge(docs, spark.createDataFrame([(1, text)], "item_id long, text string")).collect()}
    assert got == {1: (60_000, 60_000), 2: (2, 0)}
