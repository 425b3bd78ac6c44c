"""Cross-entropy difference against plain Python models over strings, and on labelled rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factlode.llm import _words, lm


def brute(target, background, docs):
    """(n_words, target loss, background loss) of each text, counting words, contexts and pairs as strings."""
    def tokens(t):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        return list(zip([None, *w], w, strict=False))

    def count(texts):
        pairs = [p for t in texts for p in tokens(t)]
        return Counter(w for _, w in pairs), Counter(b for b, _ in pairs), Counter(pairs)

    models = [count(target), count(background)]
    total, vocabulary = sum(models[0][0].values()), max(2**lm.VOCABULARY_BITS, len({*models[0][0], *models[1][0]}))
    out = []
    for t in docs:
        loss = []
        for w, c, p in models:
            n = sum(w.values())
            mean = 0.0
            for before, word in tokens(t):
                base = (w[word] * total / max(1, n) + lm.ALPHA) / ((total if n else 0) + lm.ALPHA * vocabulary)
                mean -= math.log(lm.LAMBDA * p[before, word] / c[before] + (1 - lm.LAMBDA) * base if c[before] and total else base)
            loss.append(mean / max(1, len(tokens(t))))
        out.append((len(tokens(t)), *loss))
    return out


def got(df):
    return [(r.n_words, r.target_loss, r.background_loss) for r in df.orderBy("doc_id").collect()]


def close(rows):
    return [pytest.approx(w, rel=1e-9) for w in rows]


def test_against_brute_force(spark, monkeypatch):
    texts = ["a b c a b", "A b d", None, "", "the a the a the", "x y z x y z x", "É é 中文 a\x0bb"] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = lm.with_scores(df, F.col("doc_id") < 4)
    assert got(out) == close(brute(texts[:4], texts, texts))
    assert all(r.score == pytest.approx(r.target_loss - r.background_loss) for r in out.collect())
    # texts outside the background, and blocks of a few tokens
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 5)
    assert got(lm.with_scores(df, F.col("doc_id") < 4, F.col("doc_id") < 12)) == close(brute(texts[:4], texts[:12], texts))
    assert got(lm.with_scores(df, F.lit(None).cast("boolean"))) == close(brute([], texts, texts))


def test_large_vocabulary_against_brute_force(spark):
    """More distinct words and pairs than any fixed table of cells would keep apart."""
    words = [f"w{i}" for i in range(80_000)]
    texts = [" ".join(words[i : i + 2000]) for i in range(0, len(words), 2000)] + ["never seen words", " ".join(words[::7])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = lm.with_scores(df, F.col("doc_id") == 0, F.col("doc_id") < 40)
    assert got(out) == close(brute(texts[:1], texts[:40], texts))


def test_quality_and_edges(spark, hard, clashing, empty):
    sf = "/root/testdata/sf0.01"
    scores = {r.doc_id: r.score for r in lm.op6_lm(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good, bad = ([scores[r.doc_id] for r in labels if r.quality == q] for q in (1, 0))
    assert sum(g < b for g in good for b in bad) / (len(good) * len(bad)) > 0.9
    assert lm.with_scores(empty, F.lit(True)).count() == 0
    out = lm.with_scores(clashing, F.lit(True))
    assert out.count() == 11 and len(set(out.columns)) == len(out.columns) and out.filter("score is null").count() == 0
    own = [c for c in clashing.columns if c not in lm.ADDED]
    assert sorted(map(repr, out.select(own).collect())) == sorted(map(repr, clashing.select(own).collect()))
    for most in (-1, 100):
        marked = lm.of_ids(hard, hard.select("doc_id"), "good", most)
        assert marked.count() == 11 and marked.filter("good").count() == 10


def test_packed_arrays():
    rnd = np.random.default_rng(2)
    arrays = [rnd.integers(0, 1 << bits, n) for bits, n in ((1, 9), (56, 100), (8, 0), (9, 3))] + [np.zeros(4, np.int64), np.ones(2, bool)]
    back = lm.unpack(lm.pack(*arrays))
    assert len(back) == len(arrays) and all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, back, strict=True))


def test_sliding_minima_and_grams():
    x = np.random.default_rng(1).integers(0, 1 << 60, 200, dtype=np.uint64)
    for width in (1, 2, 7, 26, 64):
        assert (_words.sliding_min(x, width) == [x[i : i + width].min() for i in range(len(x) - width + 1)]).all()
    w = _words.words([b"a b c d a b c", b"", b"c d a b"], _words.SPACED)
    g = _words.grams(w.hash, 3)
    assert w.first.tolist() == [0, 7, 7, 11] and g[0] == g[4] and g[2] == g[7] and len(set(g.tolist())) < len(g)
