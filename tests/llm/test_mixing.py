"""Mixing: targets by brute force, whole shares, reruns, positions, edges."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from factlode.llm import mixing


def fill(sizes, weights, epochs=3):
    """Targets by repeated resharing, in the order of sources."""
    target, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total >= epochs * sizes[i]}
        if not over:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in over:
            target[i] = float(epochs * sizes[i])
        left -= sum(target[i] for i in over)
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    rnd = random.Random(seed)
    sizes = [rnd.choice([0, 1, 10, 1000, 10**6]) * rnd.randint(1, 9) for _ in range(rnd.randint(1, 9))]
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df, (1, 2, 3)).collect()}
    want = fill(sizes, [i % 3 + 1 for i in range(len(sizes))])
    assert [got[f"s{i}"] for i in range(len(sizes))] == pytest.approx(want)


def test_null_source_is_last_and_shares_are_met(spark, hard):
    out = mixing.mix(hard, rows_per_bucket=2).cache()
    assert out.count() == 11 and out.filter("size is null or taken is null").count() == 0
    sums = hard.select("source", mixing.word_count(F.col("text")).alias("n")).groupBy("source").sum("n").collect()
    order = sorted(sums, key=lambda r: (r["source"] is None, r["source"]))
    want = fill([r[1] for r in order], [i % 3 + 1 for i in range(len(order))])
    by_size = {r.source_size: r for r in out.groupBy("source_size").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect()}
    for r, w in zip(order, want, strict=True):
        assert by_size[r[1]].g == pytest.approx(w) and by_size[r[1]].t == int(w + 1e-6)
    assert out.filter("taken > 3 * size").count() == 0
    again = mixing.mix(hard.orderBy(F.desc("doc_id")), rows_per_bucket=4096)
    key = lambda df: sorted(map(repr, df.select("doc_id", "size", "target", "taken", "position", "last_position").collect()))
    assert key(out) == key(again)


def test_positions_invert_the_integrated_schedule(spark):
    knots = ((0.0, 1.0), (0.25, 0.0), (0.5, 3.0), (1.0, 0.5))
    area = lambda t: sum(max(0.0, min(t, b) - a) * (wa + (wa + (wb - wa) * (min(t, b) - a) / (b - a))) / 2 for (a, wa), (b, wb) in zip(knots, knots[1:], strict=False) if t > a)
    df = spark.range(101).select((F.col("id") / 100).alias("q"))
    for r in df.select("q", mixing.invert_demand(F.col("q"), knots).alias("t")).collect():
        assert area(r.t) / area(1.0) == pytest.approx(r.q, abs=1e-6)
    flat = df.select("q", mixing.invert_demand(F.col("q"), ((0.0, 2.0), (1.0, 2.0))).alias("t")).collect()
    assert [r.t for r in flat] == pytest.approx([r.q for r in flat])
    with pytest.raises(ValueError):
        mixing.schedule_segments(((0.0, 1.0), (0.5, 1.0)))


def test_passes_and_edges(spark, hard, clashing, empty):
    out = mixing.mix(hard)
    every = mixing.mix(hard, every_pass=True)
    assert every.agg(F.sum("words")).first()[0] == out.agg(F.sum("taken")).first()[0]
    assert mixing.mix(empty, every_pass=True).count() == 0
    assert mixing.mix(empty).count() == 0
    carried = mixing.mix(clashing, carry=clashing.columns)
    assert carried.count() == 11 and len(set(carried.columns)) == len(carried.columns) and carried.filter("fp = 'own'").count() == 11
    assert dict(carried.dtypes)["size"] == "bigint"


def test_passes_take_their_places_in_time(spark):
    """Every pass by plain Python: read each source around in its order, and find the time of each place by bisection."""
    rnd = random.Random(9)
    rows = [(i if i % 11 else None, " ".join(["w"] * rnd.randint(0, 30)) + f" {i}", rnd.choice("aaabcccccc")) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    every = mixing.mix(df, every_pass=True, carry=["text", "source"], rows_per_bucket=16)
    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    sources = sorted({s for *_, s in rows})
    order = {s: sorted((md5(str(i) if i is not None else md5(t)), i, t) for i, t, x in rows if x == s) for s in sources}
    sizes = [sum(len(t.split()) for _, _, t in order[s]) for s in sources]
    want = []
    for rank, (s, size, target) in enumerate(zip(sources, sizes, fill(sizes, [i % 3 + 1 for i in range(len(sizes))]), strict=True)):
        done, number = 0, 0
        while done < int(target + 1e-9):
            for _, i, t in order[s]:
                n = min(len(t.split()), int(target + 1e-9) - done)
                if n > 0:
                    want.append((i, t, number, n, _when(done / target, rank)))
                done += n
            number += 1
    assert any(number == 2 for *_, number, _, _ in want)
    got = [(r.doc_id, r.text, r["pass"], r.words, r.position) for r in every.collect()]
    assert [p for *_, p in got] == sorted(p for *_, p in got)
    key = lambda x: (str(x[0]), x[1], x[2])
    assert [g[:4] for g in sorted(got, key=key)] == [w[:4] for w in sorted(want, key=key)]
    assert [g[4] for g in sorted(got, key=key)] == pytest.approx([w[4] for w in sorted(want, key=key)], abs=1e-6)
    ends = {(r.doc_id, r.text): r.last_position for r in mixing.mix(df, carry=["text"], rows_per_bucket=16).filter("taken > 0").collect()}
    last = {}
    for i, t, number, _, time in sorted(want, key=lambda w: w[2]):
        last[i, t] = time
    assert ends == {k: pytest.approx(v, abs=1e-6) for k, v in last.items()}


def _when(share, rank):
    """The time at which demand that falls from 1.5 to 0.5 (even ranks), or rises, adds up to share."""
    used = lambda t: 1.5 * t - t * t / 2 if rank % 2 == 0 else 0.5 * t + t * t / 2
    low, high = 0.0, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if used(middle) < share else (low, middle)
    return low
