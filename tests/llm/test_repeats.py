"""Substring dedup against brute force, on made texts with shared passages."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from factlode.llm import repeats


def brute(rows, width=50):
    first, words = {}, []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        words.append((i, w))
        for s in range(len(w) - width + 1) if i is not None else ():
            key = tuple(w[s : s + width])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - width + 1) if i is not None else ():
            if first[tuple(w[s : s + width])] < i:
                gone |= set(range(s, s + width))
        kept = " ".join(x for n, x in enumerate(w) if n not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    out = repeats.remove_repeats(df).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("h"))
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_against_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: rnd.choice("abcdefghijklm") * rnd.randint(1, 2)
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 75, 120, 400)]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rnd.randint(0, 5)):
            w += [word() for _ in range(rnd.randint(0, 40))]
            p = rnd.choice(passages)
            a = rnd.randint(0, 20)
            w += p[a:] if rnd.random() < 0.4 else p
        rows.append((i * 7 % 61, rnd.choice([" ", "\n", " \t "]).join(w)))
    rows += [(100, " ".join(["same"] * 70)), (101, " ".join(["same"] * 200)), (102, rows[5][1]), (103, rows[5][1].replace(" ", "\n"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = brute(rows)
    assert got(df) == want and sum(r[2] for r in want) > 1000


def test_edges(spark, hard, clashing, empty):
    rows = [(r.doc_id, r.text) for r in hard.collect()]
    assert got(hard.select("doc_id", "text")) == brute(rows)
    assert got(clashing) == brute(rows)
    assert "fp" in repeats.remove_repeats(clashing).columns
    assert repeats.remove_repeats(empty).count() == 0


def test_words_of_one_rolling_hash_are_not_equal(spark):
    """Thue-Morse order and its complement have one polynomial hash modulo 2 ** 64, as letters of a word and as words of a text."""
    order = [bin(i).count("1") % 2 for i in range(2048)]
    word, other = ("".join("ab"[b ^ flip] for b in order[:1024]) for flip in (0, 1))
    same = " ".join(f"w{i}" for i in range(49))
    rows = [(1, f"{same} {word}"), (2, f"{same} {other}"), (3, f"{same} {word}")]
    rows += [(10 + flip, " ".join(("left", "right")[b ^ flip] for b in order)) for flip in (0, 1)]
    rows += [(20 + flip, " ".join(f"x{i}" for i in range(60)) + " " + " ".join(("up", "down")[b ^ flip] for b in order)) for flip in (0, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    assert got(df) == want and {r[0]: r[2] for r in want}[2] == 0 and {r[0]: r[2] for r in want}[3] == 50


def test_maximal_repeats(spark):
    a, b, own = ([f"{c}{i}" for i in range(n)] for c, n in (("a", 80), ("b", 60), ("o", 10)))
    rows = [(1, a), (2, b), (3, own + a + own[:3] + b[:50]), (4, a[5:70] + own), (5, a)]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(2)
    out = {r.doc_id: [tuple(x) for x in r.repeats] for r in repeats.remove_repeats(df).collect()}
    assert out == {1: [], 2: [], 3: [(10, 90, 1), (93, 143, 2)], 4: [(0, 65, 1)], 5: [(0, 80, 1)]}
