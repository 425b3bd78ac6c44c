"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its byte n-grams (with word borders) and of the word itself, all
hashed into a fixed number of rows; a text's vector is the mean over its words. Two softmax outputs read it.
Unseen misspellings share n-gram vectors with the words they come from. As the outputs are linear in the mean,
scoring needs one number for each row, the difference of the two outputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words

#: Rows of the embedding, its width, and the n-gram lengths in bytes.
ROW_BITS = 18
WIDTH = 8
GRAMS = (3, 4, 5)
#: Labelled rows that the model is trained on at most: those with the least xxhash64 of doc_id.
MAX_LABELLED = 5000
#: A text is predicted toxic from this score on.
THRESHOLD = 0.3
#: Texts are handled in groups of about so many bytes, in scoring and in training.
CHUNK_BYTES = 1 << 18
TRAINING_BYTES = 1 << 16
#: Full-batch passes, the first step, the scale of the mean and the decay of the vectors.
PASSES = 120
STEP = 0.02
SCALE = 150.0
DECAY = 2e-4
SEED = 11
#: Vectors that are moved at once, so that a step makes no second copy of the embedding.
SLICE = 1 << 14

_WORD = np.zeros(256, bool)
_WORD[np.r_[0x30:0x3A, 0x61:0x7B, 0x80:0x100]] = True
_MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917), np.uint32(668265263))


@dataclass
class Subwords:
    """Words of a group of texts: their text, span in the buffer, and the buffer's n-gram rows by start."""

    owner: np.ndarray
    start: np.ndarray
    end: np.ndarray
    word_row: np.ndarray
    gram_rows: list[np.ndarray]


def subwords(texts: list[bytes]) -> Subwords:
    """Split texts into words of digits, letters and non-ASCII bytes (A-Z lower-cased) and hash their n-grams."""
    gap = b" " * max(GRAMS)
    joined = gap + gap.join(t.lower() for t in texts) + gap
    raw = np.frombuffer(joined, np.uint8)
    inside = _WORD[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edges[::2], edges[1::2]
    begins = np.cumsum([len(gap)] + [len(t) + len(gap) for t in texts[:-1]]) if texts else np.zeros(0, int)
    owner = np.searchsorted(begins, start, "right") - 1
    codes = np.where(inside, raw, 32).astype(np.uint32)
    shift = np.uint32(32 - ROW_BITS)
    grams, h, factor = [], np.zeros(len(raw), np.uint32), np.uint32(1)
    with np.errstate(over="ignore"):
        for n in range(1, max(GRAMS) + 1):
            h = h[: len(raw) - n + 1] + codes[n - 1 :] * factor
            factor = np.uint32(factor * np.uint32(16777619))
            if n in GRAMS:
                grams.append((((h ^ (h >> np.uint32(15))) * _MIX[n % 4] ^ np.uint32(n)) >> shift).astype(np.int32))
        if len(start):
            lengths = end - start
            offset = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            powers = np.uint32(16777619) ** np.arange(int(lengths.max()), dtype=np.uint32)
            terms = (codes[inside] + np.uint32(1)) * powers[offset]
            whole = np.add.reduceat(terms, np.cumsum(lengths) - lengths, dtype=np.uint32)
            word_row = (((whole ^ (whole >> np.uint32(15))) * _MIX[0]) >> shift).astype(np.int32)
        else:
            word_row = np.zeros(0, np.int32)
    return Subwords(owner, start, end, word_row, grams)


def _counts(s: Subwords) -> np.ndarray:
    """Subwords of each word, the word itself among them."""
    return 1 + sum(np.maximum(s.end - s.start + 3 - n, 0) for n in GRAMS)


def groups(texts: list[bytes], most: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about so many bytes together, with the index of the first."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


@dataclass
class Part:
    """The mean subword bags of consecutive texts from `first` on: sparse rows of a matrix."""

    first: int
    indptr: np.ndarray
    rows: np.ndarray
    weights: np.ndarray


def parts(texts: list[bytes]) -> list[Part]:
    """The texts' mean subword bags, a part for each group of texts; the parts are never copied into one."""
    out = []
    for first, some in groups(texts, TRAINING_BYTES):
        s = subwords(some)
        words = np.bincount(s.owner, minlength=len(some))
        weight = 1.0 / (_counts(s) * words[s.owner])
        keys, weights = [s.owner.astype(np.int64) << ROW_BITS | s.word_row], [weight]
        for n, rows in zip(GRAMS, s.gram_rows, strict=True):
            m = np.maximum(s.end - s.start + 3 - n, 0)
            at = np.repeat(s.start - 1, m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            keys.append(np.repeat(s.owner, m).astype(np.int64) << ROW_BITS | rows[at])
            weights.append(np.repeat(weight, m))
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(weights), len(key))
        indptr = np.searchsorted(key >> ROW_BITS, np.arange(len(some) + 1))
        out.append(Part(first, indptr, (key & ((1 << ROW_BITS) - 1)).astype(np.int32), total.astype(np.float32)))
    return out


@dataclass
class Model:
    """Per row the difference of the two outputs, and the difference of their biases."""

    rows: np.ndarray
    bias: float

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1; a text without words has that of the biases alone."""
        out = np.full(len(texts), self.bias)
        for first, some in groups(texts):
            s = subwords(some)
            if not len(s.owner):
                continue
            total = self.rows[s.word_row].astype(np.float64)
            for n, rows in zip(GRAMS, s.gram_rows, strict=True):
                running = np.concatenate([[0.0], np.cumsum(self.rows[rows], dtype=np.float64)])
                fits = s.end - s.start + 2 >= n
                total += np.where(fits, running[np.where(fits, s.end + 2 - n, 0)] - running[np.where(fits, s.start - 1, 0)], 0.0)
            words = np.bincount(s.owner, minlength=len(some))
            mean = np.bincount(s.owner, total / _counts(s), len(some)) / np.maximum(words, 1)
            out[first : first + len(some)] += mean
        return 1.0 / (1.0 + np.exp(-np.clip(out, -500, 500)))


def fit(texts: list[bytes], labels: np.ndarray) -> Model:
    """A model of the labels of texts; see fit_parts."""
    return fit_parts(parts(texts), labels)


def fit_parts(some: list[Part], labels: np.ndarray) -> Model:
    """Train embedding and softmax together by full-batch Adam with decayed vectors. One class alone gives a constant.

    The rows of the parts are numbered anew in place.

    With A the sparse mean matrix, E the embedding and W the outputs, logits are SCALE * A (E W) + b. Both gradients
    go through A^T error, so a pass reads A's entries twice whatever the width.
    """
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << ROW_BITS, np.float32), 20.0 if len(y) and y[0] else -20.0)
    present = np.zeros(1 << ROW_BITS, bool)
    for p in some:
        present[p.rows] = True
    used = np.flatnonzero(present)
    place = np.cumsum(present, dtype=np.int32) - 1
    for p in some:
        p.rows = place[p.rows]
    rng = np.random.default_rng(SEED)
    # the vectors and their moments are the largest arrays beside the parts
    embedding, output = rng.normal(0, 0.1, (len(used), WIDTH)).astype(np.float32), rng.normal(0, 0.5, (WIDTH, 2))
    bias = np.log([1 - y.mean(), y.mean()])
    values = (embedding, output, bias)
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    for step in range(1, PASSES + 1):
        rate = STEP * (1 - (step - 1) / PASSES)  # falls to nothing, so that the last passes settle
        read = output[:, 1] - output[:, 0]
        logit, row_value = np.zeros(len(y)), embedding @ read.astype(np.float32)
        for p in some:
            filled = np.flatnonzero(np.diff(p.indptr))
            if len(filled):
                logit[p.first + filled] = np.add.reduceat(p.weights * row_value[p.rows], p.indptr[filled])
        logit = SCALE * logit + bias[1] - bias[0]
        error = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y) / len(y)
        back = np.zeros(len(used))
        for p in some:
            spread = np.repeat(error[p.first : p.first + len(p.indptr) - 1], np.diff(p.indptr))
            back += np.bincount(p.rows, p.weights * spread, len(used))
        back *= SCALE
        toward = (embedding.T @ back.astype(np.float32)).astype(np.float64)
        vectors = [(slice(i, i + SLICE), lambda at: np.outer(back[at], read) + DECAY * embedding[at]) for i in range(0, len(used), SLICE)]
        whole = slice(None)
        grads = (vectors, [(whole, lambda _: np.stack([-toward, toward], 1))], [(whole, lambda _: np.array([-error.sum(), error.sum()]))])
        for value, (m, v), pieces in zip(values, moments, grads, strict=True):
            for at, of in pieces:
                g = of(at)
                m[at] += 0.1 * (g - m[at])
                v[at] += 0.001 * (g * g - v[at])
                value[at] -= rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.999**step)) + 1e-8)
    out = np.zeros(1 << ROW_BITS, np.float32)
    out[used] = SCALE * (embedding @ (output[:, 1] - output[:, 0]))
    return Model(out, float(bias[1] - bias[0]))


def _fit_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In: text and toxic of the whole sample. Out: one row, the model. Texts are dropped once their bags are known."""
    some, labels = [], []
    for rows, texts in _words.sliced(batches, "text"):
        some += [replace(p, first=p.first + len(labels)) for p in parts(texts)]
        labels += [int(y > 0) for y in rows["toxic"].to_pylist()]
    model = fit_parts(some, np.array(labels))
    yield pa.RecordBatch.from_arrays([pa.array([model.rows.tobytes()]), pa.array([model.bias])], ["rows", "bias"])


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of doc_id as text, mod 4, is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    """A model of labels.toxic over docs.text, on at most `most` labelled rows that aren't held out.

    A doc_id labelled twice counts as toxic if any of its labels is; of several texts with one doc_id the least is
    learnt. Null labels and doc_ids are left out. The sample is bounded, so its ids may be broadcast.
    """
    known = labels.select("doc_id", "toxic").dropna().filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    sample = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    # the sample is bounded, so one task takes it; only the model comes to the driver
    found = sample.repartition(1).sortWithinPartitions("doc_id").mapInArrow(_fit_task, "rows binary, bias double").first()
    return Model(np.frombuffer(found["rows"], np.float32), found["bias"]) if found else fit_parts([], np.zeros(0))


def with_score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with the score of each text (null: empty) as a column, in place of an own one of that name. The broadcast model has 2 ** ROW_BITS floats."""
    shared = docs.sparkSession.sparkContext.broadcast((model.rows, model.bias))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(Model(*shared.value).score([t.encode() for t in texts.fillna("")]))

    return docs.withColumn(name, score(F.col("text")))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below the threshold, with all their columns; null texts count as empty, repeated rows stay or go together."""
    return with_score(docs, model, "__score").filter(F.col("__score") < threshold).select(*docs.columns)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score every whole text of documents as labels.toxic marks it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = with_score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
