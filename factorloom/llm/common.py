"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SHINGLE_WORDS = 5
SIMILARITY = 0.8


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of ``text``; bytes are split at the same six blanks as WORD."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, text.encode().split())), dtype=">u8").astype(np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(text: str, size: int = SHINGLE_WORDS) -> np.ndarray:
    """Hashes of the runs of ``size`` words, by position; a shorter text with words has one shingle, one without has none."""
    h = word_hashes(text)
    if not len(h):
        return h
    size = min(size, len(h))
    n = len(h) - size + 1
    out = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(size):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n]
        return mix(out)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def as_unsigned(x: np.ndarray) -> np.ndarray:
    return x.view(np.uint64)


def widen(spans: list[list[int]], start: int, stop: int) -> None:
    """Add [start, stop] to ascending ``spans`` that do not meet. It may begin before the last ones: a later hit of a
    piece from further along implies an earlier start."""
    while spans and start <= spans[-1][1]:
        lo, hi = spans.pop()
        start, stop = min(start, lo), max(stop, hi)
    spans.append([start, stop])


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` as one struct column ``row_``, so that an operator's own columns clash with none of them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_"))


def unpacked(df: DataFrame, docs: DataFrame, *new: str) -> DataFrame:
    """The columns of ``docs`` again and the ``new`` ones, which take the place of columns of the same name."""
    return df.select(*[F.col(f"row_.`{c}`") for c in docs.columns if c not in new], *new)
