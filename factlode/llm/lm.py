"""LM scoring by cross-entropy difference.

Two word-bigram models, one of target documents and one of all documents, share one vocabulary, one table of counts
and one smoothing, and their counts are scaled to the same total. A document's score is the mean over its tokens of
the target model's loss less the background model's; lower is closer to the target.

Every distinct word and pair is counted, by 56-bit hashes, in tables that grow with the corpus: among 10^12 pairs one
in some 70,000 would share its count with another. Documents are counted by blocks of about BLOCK_TOKENS tokens. A block
sends its distinct keys, dealt by range, to the parts of the table, and each part answers with their counts over the
corpus in the order in which they came, so that no key travels back and a frequent word is one key of a block. A block's tokens go along
as numbers of its words and meet the answers in the end: each text is cut into words once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _words
from ._common import cut, n_parts

#: The least vocabulary that smoothing assumes, as a power of two; a larger one counts as it is.
VOCABULARY_BITS = 16
#: Weight of the bigram estimate beside the unigram one, and what is added to each unigram count.
LAMBDA = 0.6
ALPHA = 0.5
#: Ids of target documents (some 16 bytes each) up to which they are broadcast; beyond, the join shuffles the texts.
BROADCAST_IDS = 500_000
#: Tokens at which a block is closed, and keys that one part of the table holds about (some 50 bytes each).
BLOCK_TOKENS = 1 << 21
PART_KEYS = 1 << 22
#: Bytes of text for each key that a block sends; only for the number of parts.
BYTES_PER_KEY = 8
KEY_BITS = 56
#: What stands for the word before a text.
START = np.uint64(0x5851F42D4C957F2D >> 8)
ADDED = ("n_words", "target_loss", "background_loss", "score")


def losses(word: np.ndarray, before: np.ndarray, pair: np.ndarray, n_tokens: float, total: float, vocabulary: int) -> np.ndarray:
    """Negative log probability of tokens whose word, context and pair have these counts; the counts are scaled to total."""
    scale = total / max(1.0, n_tokens)
    base = (word * scale + ALPHA) / ((total if n_tokens else 0.0) + ALPHA * vocabulary)
    seen = (before > 0) & (scale > 0)
    share = pair / np.where(before > 0, before, 1)
    return -np.log(np.where(seen, LAMBDA * share + (1 - LAMBDA) * base, base))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 on, as planes of their bytes, compressed."""
    head, planes = [], []
    for a in arrays:
        a = np.ascontiguousarray(a, np.uint64)
        width = (int(a.max()).bit_length() + 7) // 8 if len(a) else 0
        planes.append(a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
        head += [len(a), width]
    raw = b"".join(planes)
    return np.array([len(arrays), len(raw), *head], "<i8").tobytes() + pa.Codec("zstd").compress(raw, asbytes=True)


def unpack(body: bytes) -> list[np.ndarray]:
    """The arrays of pack(), as int64."""
    n, size = (int(x) for x in np.frombuffer(body, "<i8", 2))
    head, out, at = np.frombuffer(body, "<i8", 2 * n, 16).tolist(), [], 0
    raw = pa.Codec("zstd").decompress(memoryview(body)[16 + 16 * n :], size, asbytes=True) if size else b""
    for length, width in zip(head[::2], head[1::2], strict=True):
        a = np.zeros((length, 8), np.uint8)
        a[:, :width] = np.frombuffer(raw, np.uint8, length * width, at).reshape(width, length).T
        out.append(a.view("<i8")[:, 0])
        at += length * width
    return out


class Block:
    """Distinct words and pairs of consecutive texts, both by ascending key, with their counts in the two corpora.

    known: the words' keys; lengths: tokens of each text; slots: for each token its word's number in known, all texts in
    a row; in_target, in_background: whether each text counts there.
    """

    def __init__(self, known: np.ndarray, lengths: np.ndarray, slots: np.ndarray, in_target: np.ndarray, in_background: np.ndarray):
        self.lengths, self.slots, self.flags = lengths, slots, (in_target, in_background)
        self.owner = np.repeat(np.arange(len(lengths)), lengths)
        # START is one word more, which may also stand in a text
        self.words, place = np.unique(np.append(known, START), return_inverse=True)
        self.word = place[:-1][slots]
        self.before = np.empty_like(self.word)
        self.before[1:] = self.word[:-1]
        self.before[(np.cumsum(lengths) - lengths)[lengths > 0]] = place[-1]
        both, of = np.unique(self.before * len(self.words) + self.word, return_inverse=True)
        first, second = self.words[both // len(self.words)], self.words[both % len(self.words)]
        keys = _words.mix(second + first * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - KEY_BITS)
        self.pairs, place = np.unique(keys, return_inverse=True)
        self.pair = place[of]

    def counts(self, slots: np.ndarray, size: int) -> list[np.ndarray]:
        """How often each of size numbers stands among slots (one a token) in the target and in the background."""
        return [np.bincount(slots[flag[self.owner]], minlength=size) for flag in self.flags]

    def cells(self, parts: int) -> Iterator[tuple[int, bytes]]:
        """(part, its keys and their counts) for every part."""
        words = [self.words, *self.counts(self.word, len(self.words)), *self.counts(self.before, len(self.words))]
        pairs = [self.pairs, *self.counts(self.pair, len(self.pairs))]
        bounds = [np.searchsorted(part_of(x[0], parts), np.arange(parts + 1)) for x in (words, pairs)]
        for p in range(parts):
            some = [[a[b[p] : b[p + 1]] for a in x] for x, b in zip((words, pairs), bounds, strict=True)]
            yield p, pack(*(a for keys, *counts in some for a in (np.diff(keys, prepend=keys.dtype.type(0)), *counts)))

    def losses(self, words: list[np.ndarray], pairs: list[np.ndarray], totals: list[float], vocabulary: int) -> list[np.ndarray]:
        """Mean loss of each text by target and background, from the corpus counts of words (words, contexts) and pairs."""
        out = []
        for k, n in enumerate(totals):
            loss = losses(words[k][self.word], words[2 + k][self.before], pairs[k][self.pair], n, totals[0], vocabulary)
            out.append(np.bincount(self.owner, loss, len(self.lengths)) / np.maximum(1, self.lengths))
        return out


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of the table that each key belongs to; ascends with the key."""
    return ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(parts)) >> np.uint64(32)


def _ipc(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def _encoder(parts: int):
    """(part, block, body): every block's cell for each part, and its texts' own columns and tokens under a negative part."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ordinal = TaskContext.get().partitionId(), 0
        rows_held: list[pa.RecordBatch] = []
        hashes: list[np.ndarray] = []
        lengths: list[np.ndarray] = []

        def closed() -> pa.RecordBatch:
            every, n = np.concatenate(hashes), np.concatenate(lengths)
            known, slots = np.unique(every, return_inverse=True)
            flags = [np.concatenate([r[c].to_numpy(zero_copy_only=False) for r in rows_held]) for c in ("__target", "__background")]
            # a block's name has its contents, so that cells of one reading can never be mistaken for another's
            name = f"{at}:{ordinal}:{xxhash.xxh3_128_hexdigest(every.tobytes() + n.tobytes())}"
            cells = list(Block(known, n, slots, *flags).cells(parts)) if len(every) else []
            own = _ipc([r.drop_columns(["__text", "__target", "__background"]) for r in rows_held])
            body = pack(np.diff(known, prepend=np.uint64(0)), n, slots, *flags)
            docs = np.array([len(body)], "<i8").tobytes() + body + own
            part = pa.array([-1 - at, *(p for p, _ in cells)], pa.int32())
            return pa.RecordBatch.from_arrays([part, pa.array([name] * (len(cells) + 1)), pa.array([docs, *(b for _, b in cells)], pa.binary())], ["part", "block", "body"])

        for rows, texts in _words.sliced(batches, "__text"):
            for first, some in _words.groups(texts):
                w = _words.words([t.lower() for t in some], _words.SPACED)
                rows_held.append(rows.slice(first, len(some)))
                hashes.append(w.hash >> np.uint64(64 - KEY_BITS))
                lengths.append(np.diff(w.first))
                if sum(map(len, hashes)) >= BLOCK_TOKENS:
                    yield closed()
                    ordinal, rows_held, hashes, lengths = ordinal + 1, [], [], []
        if rows_held:
            yield closed()

    return encode


def _summed(columns: list[list[np.ndarray]]) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
    """(total counts of the distinct keys, the same dealt back to each list). columns: per list its keys and counts."""
    keys, place = np.unique(np.concatenate([c[0] for c in columns]), return_inverse=True)
    totals = []
    for k in range(1, len(columns[0])):
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, place, np.concatenate([c[k] for c in columns]))
        totals.append(total)
    ends = np.cumsum([len(c[0]) for c in columns])[:-1]
    return totals, [list(x) for x in zip(*(np.split(t[place], ends) for t in totals), strict=True)]


def _answer(cells: pa.Table) -> pa.Table:
    """Each block's cell of one part with the counts over all blocks, and the part's vocabulary and totals. Texts pass as they are."""
    if cells["part"][0].as_py() < 0:
        return cells
    words, pairs = [], []
    for body in cells["body"]:
        a = unpack(body.as_py())
        words.append([np.cumsum(a[0]), *a[1:5]])
        pairs.append([np.cumsum(a[5]), *a[6:]])
    of_words, each_word = _summed(words)
    _, each_pair = _summed(pairs)
    about = np.array([((of_words[0] > 0) | (of_words[1] > 0)).sum(), of_words[0].sum(), of_words[1].sum()])
    bodies = [pack(about, *w, *p) for w, p in zip(each_word, each_pair, strict=True)]
    return pa.table({"part": cells["part"], "block": cells["block"], "body": pa.array(bodies, pa.binary())})


def _scorer(parts: int, names: Sequence[str]):
    def score(rows: pa.Table) -> pa.Table:
        """The texts of one block with their scores, from its tokens and the answers of all parts."""
        order = np.argsort(rows["part"].to_numpy())
        bodies = [rows["body"][int(i)].as_py() for i in order]
        docs, answers = bodies[0], [unpack(b) for b in bodies[1:]]
        size = int(np.frombuffer(docs, "<i8", 1)[0])
        known, lengths, slots, *flags = unpack(docs[8 : 8 + size])
        own = pa.ipc.open_stream(docs[8 + size :]).read_all()
        if len(slots) == 0:
            means = [np.zeros(len(lengths))] * 2
        elif len(answers) != parts or rows["part"][int(order[0])].as_py() >= 0:
            raise RuntimeError("a block was read in two ways: the input changes from one reading to the next")
        else:
            about = np.sum([a[0] for a in answers], axis=0)
            words, pairs = ([np.concatenate([a[k] for a in answers]) for k in ks] for ks in (range(1, 5), range(5, 7)))
            block = Block(np.cumsum(known).astype(np.uint64), lengths, slots, *(f.astype(bool) for f in flags))
            means = block.losses(words, pairs, [float(about[1]), float(about[2])], max(1 << VOCABULARY_BITS, int(about[0])))
        added = (pa.array(lengths, pa.int64()), pa.array(means[0]), pa.array(means[1]), pa.array(means[0] - means[1]))
        return pa.table([*own.columns, *added], [*names, *ADDED])

    return score


def with_scores(docs: DataFrame, target: Column, background: Column | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """docs with n_words, target_loss, background_loss (means per token) and score, their difference.

    target, background: conditions on a row, whether its text counts for the target model and for the background model (every row,
    if none is given); null is false. keep: the columns of docs to return (all); own columns named like the added ones are replaced. A
    null or empty text has no words and zeros; repeated rows count as often as they stand; an empty table gives an empty result.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ADDED]
    flags = [F.coalesce(c, F.lit(False)) for c in (target, F.lit(True) if background is None else background)]
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(n_parts(docs), -(-size // (BYTES_PER_KEY * PART_KEYS)))
    marked = docs.select(*kept, F.coalesce("text", F.lit("")).alias("__text"), flags[0].alias("__target"), flags[1].alias("__background"))
    encoded = marked.mapInArrow(_encoder(parts), "part int, block string, body binary")
    # a part holds a cell of each block, a block an answer of each part: no group grows with a frequent word
    answered = encoded.groupBy("part").applyInArrow(_answer, "part int, block string, body binary")
    added = [T.StructField(c, T.LongType() if c == "n_words" else T.DoubleType()) for c in ADDED]
    return answered.groupBy("block").applyInArrow(_scorer(parts, kept), T.StructType([*docs.select(*kept).schema.fields, *added]))


def of_ids(docs: DataFrame, ids: DataFrame, name: str, most: int = BROADCAST_IDS) -> DataFrame:
    """docs with a column that says whether doc_id is among the ids, which are broadcast only if they are counted and few."""
    ids = cut(ids.select(F.col("doc_id").alias("__id")).distinct())
    ids = F.broadcast(ids) if ids.count() <= most else ids
    return docs.join(ids, docs["doc_id"] == F.col("__id"), "left").withColumn(name, F.col("__id").isNotNull()).drop("__id")


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all documents; the target are those that labels marks with quality 1, the background all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").select("doc_id")
    return with_scores(of_ids(docs, good, "good"), F.col("good"), keep=["doc_id"])
