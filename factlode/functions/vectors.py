"""Vectors as arrays of float."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    """Euclidean length; a zero vector counts as 1."""
    size = F.sqrt(dot(a, a))
    return F.when(size == 0, F.lit(1.0)).otherwise(size)


def cosine_distance(a: Column, query: list[float]) -> Column:
    """1 - cosine of a and a fixed vector; 1 if either is zero."""
    length = float(np.sqrt(sum(float(x) ** 2 for x in query))) or 1.0
    fixed = F.array(*[F.lit(float(x)) for x in query])
    return F.lit(1.0) - dot(a, fixed) / (norm(a) * F.lit(length))


# Fixed value: tokens that the hashing embedder counts.
EMBEDDED_TOKEN = re.compile(r"[A-Za-z_][A-Za-z0-9_]+|[{}();=<>.]")


def hash_vector(text: str, width: int = 384) -> np.ndarray:
    """Feature-hashed tokens and token pairs of the lower-cased text, at unit length.

    The first 8 bytes of a token's md5 are a little-endian number: modulo width it is the cell, its top bit the sign.
    """
    words = EMBEDDED_TOKEN.findall((text or "").lower())
    out = np.zeros(width, np.float32)
    for token in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]:
        number = int.from_bytes(hashlib.md5(token.encode()).digest()[:8], "little")
        out[number % width] += 1.0 if number >> 63 else -1.0
    length = float(np.linalg.norm(out))
    return out / length if length else out


@F.pandas_udf(T.ArrayType(T.FloatType()))
def hashing_embedding(texts: pd.Series) -> pd.Series:
    """hash_vector() of each text."""
    return pd.Series([hash_vector(t) for t in texts])
