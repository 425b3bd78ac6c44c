"""SimHash fingerprints and components against brute force, with long lists split."""

import random
import re

import numpy as np
import xxhash

from factlode.llm import components, simhash

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UP))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(values, bits=4):
    """Least index reachable of each value."""
    parent = list(range(len(values)))
    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_query_against_brute_force(spark):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    values = [fingerprint(t) for _, t in rows]
    want = {i: (f"{v:016x}", rows[g][0]) for (i, _), v, g in zip(rows, values, groups(values), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op7_simhash(spark, "/root/testdata/sf0.001").collect()} == want


def test_components_of_made_fingerprints(spark):
    rnd = random.Random(2)
    centres = [rnd.getrandbits(64) for _ in range(6)]
    values = sorted({c ^ sum({1 << rnd.randrange(64) for _ in range(rnd.randint(0, 6))}) for c in centres for _ in range(40)} | {0, 2**64 - 1})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    order = sorted(range(len(values)), key=signed.__getitem__)
    want = groups([values[i] for i in order])
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    for limit in (4096, 3):
        found = {r.node: r.component for r in components.components(simhash.links(df, list_limit=limit)).collect()}
        assert [found.get(signed[i], signed[i]) for i in order] == [signed[order[g]] for g in want]


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 90)] + [(200, 150), (150, 300), (7, 7), (5, 4)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(91)} | {150: 150, 200: 150, 300: 150}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_is_spanning():
    far = (1 << 60) - 1
    v = np.array([0, 1, 3, 255, 1 << 40, far, far - 1], np.int64)
    assert sorted(simhash.forest(np.sort(v))) == [(1, 0), (3, 0), (1 << 40, 0), (far, far - 1)]
    assert sorted(simhash.forest(np.array([0, 15, 255], np.int64))) == [(15, 0), (255, 0)]


def test_edges(spark, hard, clashing, empty):
    rows = hard.collect()
    out = simhash.near_duplicates(clashing)
    assert out.count() == 11 and len(set(out.columns)) == len(out.columns) and out.filter("th = 'own'").count() == 11
    got = {(r.doc_id, r.text): r.component_id for r in simhash.near_duplicates(hard).collect()}
    assert got[1, rows[0].text] == got[2, rows[0].text] == 1
    assert got[3, None] == got[4, ""] == got[6, rows[7].text] == 3
    assert got[5, rows[6].text] == got[10, rows[10].text] == 5
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns and sorted((r.doc_id is None, r.doc_id) for r in kept.collect()) == [(False, 1), (False, 3), (False, 5), (False, 7), (False, 9), (True, None)]
