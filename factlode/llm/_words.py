"""Words of many texts at once, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Rows of a batch that are turned into Python objects at once.
SLICE = 256
#: Texts are handled in groups of about so many bytes; a longer text is a group of its own.
GROUP_BYTES = 1 << 20

_u64 = np.uint64
_BYTE = np.random.default_rng(64).integers(1, 1 << 63, 256, dtype=np.uint64) * _u64(2) + _u64(1)
#: Odd multipliers of rolling hashes, with their inverses modulo 2 ** 64.
BASES = (0x9E3779B97F4A7C17, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[int, np.ndarray] = {}

#: Bytes of words between ASCII white space, and of words of digits, a-z and non-ASCII characters.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
PLAIN = np.zeros(256, bool)
PLAIN[np.r_[0x30:0x3A, 0x61:0x7B, 0x80:0x100]] = True


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept and grown by need."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> _u64(30))) * _u64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _u64(27))) * _u64(0x94D049BB133111EB)
    return x ^ (x >> _u64(31))


@dataclass
class Words:
    """hash, start and end (bytes in raw) of each word; text i has words first[i] to first[i + 1]."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(texts: list[bytes], inside_word: np.ndarray) -> Words:
    """Maximal runs of the given bytes."""
    raw = np.frombuffer(b"\n" + b"\n".join(texts) + b"\n", np.uint8)
    inside = inside_word[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edges[::2], edges[1::2]
    begins = 1 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)
    first = np.searchsorted(start, begins)
    lengths = end - start
    if len(start):
        ahead = np.cumsum(lengths) - lengths
        offset = np.arange(int(lengths.sum())) - np.repeat(ahead, lengths)
        terms = _BYTE[raw[inside]] * powers(BASES[0], int(lengths.max()))[offset]
        hashes = mix(np.add.reduceat(terms, ahead, dtype=np.uint64) + lengths.astype(np.uint64))
    else:
        hashes = np.zeros(0, np.uint64)
    return Words(raw, start, end, hashes, first)


def spans_hash(hashes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    """(running, unshift): words i to j hash to mix((running[j] - running[i]) * unshift[i]), wherever they stand."""
    n = len(hashes)
    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * powers(base, n), dtype=np.uint64)])
    return running, powers(pow(base, -1, 1 << 64), n + 1)


def grams(hashes: np.ndarray, k: int, base: int = BASES[1]) -> np.ndarray:
    """Hash of every k consecutive words, across texts too."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    running, unshift = spans_hash(hashes, base)
    n = len(hashes) - k + 1
    return mix((running[k:] - running[:-k]) * unshift[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values."""
    out, done = x, 1
    while done < width and len(out):
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:]) if len(out) > step else out[:0]
        done += step
    return out


def groups(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Consecutive texts of about GROUP_BYTES together, with the index of the first."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= GROUP_BYTES:
            yield first, texts[first : i + 1]
            first, size = i + 1, 0
    if first < len(texts):
        yield first, texts[first:]


def sliced(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches in slices of a few rows, with one column's texts as bytes (null: empty)."""
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE):
            rows = batch.slice(first, SLICE)
            yield rows, [t or b"" for t in rows[column].cast(pa.binary()).to_pylist()]
