"""License scans: phrases against brute force, templates with edits."""

import re

from factlode.llm import licenses as lic

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def base(text):
    w, at = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UP)), []
    for phrase, label in lic.PHRASES.items():
        p = phrase.split()
        at += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in lic.op9_licenses(spark, sf).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_templates(spark):
    mit, bsd = lic.TEMPLATES["mit"], lic.TEMPLATES["bsd"]
    w = mit.split()
    edited = " ".join(["pre"] * 30 + w[:30] + ["put", "in"] + w[30:50] + w[55:] + ["post"])
    rows = [(1, edited), (2, " ".join(w[:20])), (3, bsd.upper() + " mit LICENSE, The MIT-License"), (4, "cc\nby cc by"), (5, "gnu general public"), (6, "license: mit license"), (7, mit + " x " + mit)]
    got = {r.doc_id: r for r in lic.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].labels == ["mit"] and got[1].score > 0.9 and got[2].labels == [] and 0 < got[2].score < 0.6
    assert got[3].labels == ["bsd", "mit"] and got[3].n_base == 2 and got[4].n_base == 2 and got[5].n_base == 0 and got[6].n_base == 0
    spans = lic.license_spans(spark.createDataFrame(rows, "doc_id long, text string")).filter("label = 'mit' and coverage > 0.6").collect()
    assert sorted((r.doc_id, r.first) for r in spans) == [(1, 30), (7, 0), (7, len(re.findall(r"[a-z0-9]+", mit.lower())) + 1)]


def test_edges(spark, hard, clashing, empty):
    assert lic.scan(empty).count() == 0
    for r in lic.scan(clashing).collect():
        assert r.score is not None
    got = sorted((r.n_words for r in lic.scan(hard).collect()))
    assert got == sorted(base(r.text)[0] for r in hard.collect())
