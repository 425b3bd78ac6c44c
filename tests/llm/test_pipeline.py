"""The pipeline stage by stage, against what each operator says of its own input, and as a whole against plain Python."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import test_likeness
import test_mixing
import test_secrets
import test_toxicity

import corpus_pipeline as cp
from factlode.llm import decontamination, secrets, simhash, toxicity

SF = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    seen = {}
    for n, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, SF)
        assert n == 4 or out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = (docs, spark.read.parquet(f"{tmp_path}/{name}"))
        docs = seen[name][1]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    before, after = seen["toxicity"]
    scored = toxicity.with_score(before, toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet")))
    assert ids(after) == ids(scored.filter(f"score < {toxicity.THRESHOLD}")) and 0 < after.count() < before.count()
    before, after = seen["near_duplicates"]
    assert ids(after) == ids(simhash.near_duplicates(before).filter("doc_id = component_id"))
    before, after = seen["decontamination"]
    judged = decontamination.judge(before, spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert ids(after) == ids(judged.filter("not contaminated"))
    before, after = seen["secrets"]
    model = secrets.train(secrets.samples(spark))
    assert ids(after) == ids(before) and secrets.scan(after, model).filter("size(spans) > 0").count() == 0
    kept = {r.doc_id: r.text for r in after.collect()}
    assert all(kept[r.doc_id] == r.text for r in secrets.scan(before, model).filter("size(spans) = 0").select("doc_id", "text").collect())
    before, after = seen["mixing"]
    rows = after.collect()
    assert set(columns) < set(after.columns) and all(0 < r.taken <= 3 * r["size"] for r in rows)
    assert {r.doc_id: r.text for r in rows}.items() <= {r.doc_id: r.text for r in before.collect()}.items()
    assert abs(sum(r.words for r in rows) / sum(len((t or "").split()) for t in (r.text for r in before.collect())) - 1) < 0.02


def test_run_and_repeated_rows(spark, as_tables, hard, clashing, empty):
    labels = spark.createDataFrame([(1, 1, 0), (4, 1, 1)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, "nothing of this kind")], "item_id long, text string")
    out = cp.run(spark, as_tables(documents=hard, labels=labels, benchmark=items)).collect()
    assert out and len({(r.doc_id, r.text, r["pass"]) for r in out}) == len(out)
    assert cp.run(spark, as_tables(documents=empty, labels=labels, benchmark=items)).count() == 0
    out = cp.run(spark, as_tables(documents=clashing, labels=labels, benchmark=items))
    assert out.filter("fp = 'own' and spans = 'own'").count() > 0 and len(set(out.columns)) == len(out.columns)


def markov(samples):
    """Mean log-likelihood ratio of a token's character pairs by two models of (token, random)."""
    letters = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"
    n = {kind: np.zeros((len(letters), len(letters))) for kind in (True, False)}
    for token, kind in samples:
        known = [letters.index(c) for c in token if c in letters]
        for a, b in zip(known, known[1:], strict=False):
            n[kind][a, b] += 1
    p = {}
    for kind, counts in n.items():
        share = counts.sum(0) + secrets.SMOOTHING
        p[kind] = (counts + secrets.BACKOFF * share / share.sum()) / (counts.sum(1, keepdims=True) + secrets.BACKOFF)

    def ratio(token):
        known = [letters.index(c) for c in token if c in letters]
        pairs = list(zip(known, known[1:], strict=False))
        return sum(math.log(p[True][a, b] / p[False][a, b]) for a, b in pairs) / max(1, len(pairs))

    return ratio


def masked(text, ratio):
    """text with all secrets, overlapping ones together, replaced."""
    spans = [tuple(map(int, s.split(":")[1:])) for s in test_secrets.base(text).split(",") if s]
    spans += [m.span() for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text) if ratio(m[0]) > secrets.THRESHOLD]
    out, at, end = "", 0, 0
    for a, b in sorted(spans):
        if a >= end:
            out, at = out + text[at:a] + "[SECRET]", b
        end = max(end, b)
        at = max(at, end)
    return out + text[at:]


def low(text):
    return text.translate(test_likeness.UP)


def hit(text, items):
    """Whether the benchmark contaminates a text: words inside occurrences of windows are a twentieth or more of all."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    w = re.findall(word, low(text))
    windows = set()
    for item in items:
        v = re.findall(word, low(item))
        n = min(13, len(v))
        windows |= {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
    inside = {i + j for i in range(len(w)) for n in {len(x) for x in windows} if tuple(w[i : i + n]) in windows for j in range(n)}
    return bool(inside) and 20 * len(inside) >= len(w)


def test_run_against_brute_force(spark, as_tables):
    rnd = random.Random(34)
    word = lambda: "".join(rnd.choice(["an", "er", "th", "on", "in", "es", "re", "at"]) for _ in range(rnd.randint(1, 4)))
    items = [" ".join(word() for _ in range(n)) for n in (40, 13, 5)]
    rows = []
    for i in range(90):
        w = [word() for _ in range(rnd.randint(5, 60))]
        toxic = i % 5 == 0
        if toxic:
            w[rnd.randrange(len(w))] = rnd.choice(["glorkzilla", "vumpqua"])
        if i % 9 == 1:
            w[3:3] = rnd.choice(items).split()
        if i % 7 == 2:
            w.append(rnd.choice(["token=abcdefgh1234", "AKIA" + "Q7" * 8, hashlib.sha256(str(i).encode()).hexdigest()]))
        rows.append((i, " ".join(w), rnd.choice(["a", "b", "b", "c", "c", "c"]), int(toxic)))
    for i in range(90, 110):
        _, t, _, toxic = rows[rnd.randrange(60)]
        rows.append((i, t if i % 2 else t + " " + word(), rnd.choice("abc"), toxic))
    rows += [(200, "", "a", 0), (201, None, "b", 0)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s, _ in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    labels = spark.createDataFrame([(i, 1, y) for i, _, _, y in rows], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = sorted((r.doc_id, r["pass"], r.words, r.text or "", r.position) for r in cp.run(spark, as_tables(documents=docs, labels=labels, benchmark=bench)).collect())

    learnt = [(t or "", y) for i, t, _, y in rows if zlib.crc32(str(i).encode()) % 4 != 2]
    scores = test_toxicity.brute([t.encode() for t, _ in learnt], np.array([y for _, y in learnt]), [(t or "").encode() for _, t, _, _ in rows])
    assert min(abs(scores - toxicity.THRESHOLD)) > 0.002  # else rounding could decide
    clean = [r for r, s in zip(rows, scores, strict=True) if s < toxicity.THRESHOLD]
    heads = test_likeness.brute([(i, t) for i, t, _, _ in clean])
    single = [r for r in clean if heads[r[0]] == r[0]]
    kept = [r for r in single if not hit(r[1] or "", items)]
    ratio = markov([(r.token, r.random) for r in secrets.samples(spark).collect()])
    final = [(i, masked(t or "", ratio), s) for i, t, s, _ in kept]
    assert len(rows) > len(clean) > len(single) > len(kept) > 20 and [t for _, t, _ in final] != [t or "" for _, t, _, _ in kept]

    sources, want = sorted({s for *_, s in final}), []
    size = lambda t: len(t.split())
    sizes = [sum(size(t) for _, t, s in final if s == x) for x in sources]
    for rank, (x, target) in enumerate(zip(sources, test_mixing.fill(sizes, [i % 3 + 1 for i in range(len(sizes))]), strict=True)):
        order = sorted((hashlib.md5(str(i).encode()).hexdigest(), i, t) for i, t, s in final if s == x)
        done, turn = 0, 0
        while done < int(target + 1e-9):
            for _, i, t in order:
                n = min(size(t), int(target + 1e-9) - done)
                if n > 0:
                    want.append((i, turn, n, t, test_mixing._when(done / target, rank)))
                done += n
            turn += 1
    assert [g[:4] for g in got] == [w[:4] for w in sorted(want)]
    assert [g[4] for g in got] == pytest.approx([w[4] for w in sorted(want)], abs=1e-6)
