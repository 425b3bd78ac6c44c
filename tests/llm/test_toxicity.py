"""Toxicity: held-out quality on labelled rows, misspellings, edges."""

import random
import re
import zlib
from collections import Counter

import numpy as np

from factlode.llm import toxicity as tox


def corpus(n, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["an", "er", "th", "on", "in", "es", "re", "at"]) for _ in range(rnd.randint(1, 4)))
    texts, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rnd.randint(20, 200))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(max(1, len(w) // 50)):
                w[rnd.randrange(len(w))] = rnd.choice(["glorkzilla", "vumpqua"])
        texts.append(" ".join(w).encode())
        labels.append(int(toxic))
    return texts, np.array(labels)


def test_learns_and_carries_to_misspellings():
    texts, labels = corpus(600, 1)
    model = tox.fit(texts, labels)
    fresh, truth = corpus(300, 2)
    flagged = model.score(fresh) >= tox.THRESHOLD
    assert (flagged == truth).mean() > 0.95
    clean = next(t for t, y in zip(fresh, truth, strict=True) if not y)
    assert model.score([clean[:300] + b" glorkzila Glorkzillas glorkzill"])[0] > 0.3 > model.score([clean[:300]])[0]


def test_scores_sum_the_same_rows_as_the_training_matrix():
    texts, labels = corpus(40, 3)
    texts += [b"", b"..", b"a", "é ß".encode(), b"x" * 5000]
    model = tox.Model(np.random.default_rng(0).normal(size=1 << tox.ROW_BITS).astype(np.float32), 0.25)
    logits = [0.25 + float((p.weights[a:b] * model.rows[p.rows[a:b]]).sum()) for p in tox.parts(texts) for a, b in zip(p.indptr, p.indptr[1:], strict=False)]
    assert np.allclose(model.score(texts), 1 / (1 + np.exp(-np.array(logits))), atol=1e-4)


def test_query(spark):
    sf = "/root/testdata/sf0.1"
    out = {r.doc_id: r for r in tox.op8_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(out) == 10000 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())
    held = [(out[i].score, y) for i, y in labels.items() if out[i].held_out]
    better = [(a > b) + (a == b) / 2 for a, y in held if y for b, z in held if not z]
    assert sum(better) / len(better) > 0.9


def test_edges(spark, hard, clashing, empty):
    labels = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (4, 1, 0), (None, 1, 1), (5, 1, None), (99, 0, 1)], "doc_id long, quality int, toxic int")
    model = tox.train(hard, labels)
    assert tox.with_score(hard, model).filter("score is null").count() == 0
    assert tox.with_score(empty, model).count() == 0
    assert tox.drop_toxic(hard, tox.train(hard, labels.limit(0))).count() == 11
    assert tox.drop_toxic(clashing, model).columns == clashing.columns
    assert tox.fit([], np.array([])).score([b"x"])[0] < 0.01


def row(gram, kind):
    """The embedding row of an n-gram (kind: its length), or of a whole word (kind 0), in plain integers."""
    whole = 1 << 32
    codes = [b + 1 for b in gram] if kind == 0 else gram
    h = sum(c * 16777619**i for i, c in enumerate(codes)) % whole
    if kind == 0:
        return ((h ^ h >> 15) * 2654435761 % whole) >> 32 - tox.ROW_BITS
    return (((h ^ h >> 15) * (2654435761, 2246822519, 3266489917, 668265263)[kind % 4] % whole) ^ kind) >> 32 - tox.ROW_BITS


def bag(text):
    """Weights by row of a text's mean over its words of the mean over their subwords."""
    words = [w for w in re.split(rb"[^0-9a-z\x80-\xff]+", text.lower()) if w]
    out = Counter()
    for w in words:
        marked = b" " + w + b" "
        rows = [row(w, 0)] + [row(marked[i : i + n], n) for n in tox.GRAMS for i in range(len(marked) - n + 1)]
        for r in rows:
            out[r] += 1 / (len(rows) * len(words))
    return out


def brute(texts, labels, fresh):
    """Scores of a dense softmax over embeddings, trained with the plain gradients of both."""
    bags = {t: bag(t) for t in {*texts, *fresh}}
    rows = sorted({r for t in texts for r in bags[t]})
    dense = lambda ts: np.array([[bags[t][r] for r in rows] for t in ts])
    a, y = tox.SCALE * dense(texts), np.eye(2)[labels]
    rng = np.random.default_rng(tox.SEED)
    values = [rng.normal(0, 0.1, (len(rows), tox.WIDTH)), rng.normal(0, 0.5, (tox.WIDTH, 2)), np.log([1 - labels.mean(), labels.mean()])]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]

    def shares(matrix):
        logits = matrix @ values[0] @ values[1] + values[2]
        e = np.exp(logits - logits.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    for step in range(1, tox.PASSES + 1):
        error = (shares(a) - y) / len(y)
        grads = [a.T @ error @ values[1].T + tox.DECAY * values[0], (a @ values[0]).T @ error, error.sum(0)]
        for i, g in enumerate(grads):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            rate = tox.STEP * (1 - (step - 1) / tox.PASSES)
            values[i] = values[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return shares(tox.SCALE * dense(fresh))[:, 1]


def test_against_brute_force(spark, as_tables):
    """The query against a dense model, on tables where every row that may be learnt from is labelled."""
    texts, labels = corpus(80, 4)
    texts = [t[:120] for t in texts] + [b"", "É é 中文".encode()]
    labels = [*labels.tolist(), 0, 1]
    learnt = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 4 != 2]
    want = brute([texts[i] for i in learnt], np.array([labels[i] for i in learnt]), texts)
    docs = spark.createDataFrame([(i, t.decode()) for i, t in enumerate(texts)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, 1, y) for i, y in enumerate(labels)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.score for r in tox.op8_toxicity(spark, as_tables(documents=docs, labels=marks)).collect()}
    assert np.allclose([got[i] for i in range(len(texts))], want, atol=2e-3) and 0.1 < np.ptp(want)
