"""Lines that several documents share stay in the first of them only.

A line's key is the line without blanks (space, \\t to \\r) at both ends and with A-Z lower-cased. Two Bloom filters over
64-bit hashes of keys say which keys were seen at least once and which were seen again: every task fills its own pair
from its documents, the pairs are merged piece by piece (seen again = again in one, or once in two), and the second
filter, of bounded size, goes to all tasks. Only lines whose hash it holds are suspects; only they are dealt out, as
SHA-256 of the key, to be confirmed exactly and to find the first document. Documents without a suspect never move.

The filters lose no repeat and make false suspects only, so the result is exact at any filling. They have 16 bits a line
up to ``max_bits`` (128 MiB each); a corpus of many more lines fills them, and then more lines are dealt out, up to all
of them, 32 bytes and an id each.

Defined cases: a null or empty text is one empty line; keys under ``min_chars`` code points always stay; rows of the same
``doc_id`` are one document, so its own repeats stay; null ids are one document after all others; an empty table gives an
empty table. Columns n_lines and n_dropped of the input are replaced; other columns go along.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.llm.common import text_of
from factorloom.session import materialise

BLANKS = b" \t\n\x0b\x0c\r"
PIECE = 1 << 13  # bytes of a filter that are merged together


def keys_of(text: str, min_chars: int) -> list[bytes]:
    """The key of each line; empty where it is too short to count."""
    keys = [line.strip(BLANKS) for line in text.encode().lower().split(b"\n")]
    return [k if len(k) >= 4 * min_chars or (len(k) >= min_chars and len(k.decode()) >= min_chars) else b"" for k in keys]


def places(h: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """``probes`` bit numbers for each hash, one row each; ``bits`` is a power of two."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    with np.errstate(over="ignore"):
        return (h[:, None] + step[:, None] * np.arange(probes, dtype=np.uint64)) & np.uint64(bits - 1)


def has(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def put(bitmap: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(bitmap, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


class Seen:
    """The two filters of one task."""

    def __init__(self, bits: int, probes: int):
        self.bits, self.probes = bits, probes
        self.once, self.twice = np.zeros(bits // 8, dtype=np.uint8), np.zeros(bits // 8, dtype=np.uint8)

    def add(self, h: np.ndarray) -> None:
        """``h``: hashes of keys, each once per document."""
        values, counts = np.unique(h, return_counts=True)
        at = places(values, self.bits, self.probes)
        put(self.twice, at[(counts > 1) | has(self.once, at)])
        put(self.once, at)

    def pieces(self) -> Iterator[tuple[int, bytes, bytes]]:
        size = min(PIECE, self.bits // 8)
        full = self.once.reshape(-1, size)
        for k in np.flatnonzero(full.any(axis=1)):
            yield int(k), zlib.compress(full[k].tobytes(), 1), zlib.compress(self.twice.reshape(-1, size)[k].tobytes(), 1)


def hashes_of(keys: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), dtype=np.uint64, count=len(keys))


def filled(texts: DataFrame, bits: int, probes: int, min_chars: int) -> DataFrame:
    """Pieces of every task's filters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(bits, probes)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                keys = []
                for text in batch.column(0).slice(lo, 500):
                    keys += set(keys_of(text.as_py(), min_chars)) - {b""}
                seen.add(hashes_of(keys))
        rows = []
        for row in seen.pieces():
            rows.append(row)
            if len(rows) == 256:
                yield as_batch(rows)
                rows = []
        yield as_batch(rows)

    return texts.mapInArrow(run, "piece int, once binary, twice binary")


def as_batch(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
    piece, once, twice = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())],
                                      names=["piece", "once", "twice"])


def merged(pieces: DataFrame) -> DataFrame:
    """One row per piece: what was seen again in one task, or in two. A task holds its own pieces only, however many
    tasks have filled them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for piece, *both in zip(*(c.to_pylist() for c in batch.columns)):
                once, twice = (np.frombuffer(zlib.decompress(x), dtype=np.uint8) for x in both)
                if piece in held:
                    before, again = held[piece]
                    again |= twice | (before & once)
                    before |= once
                else:
                    held[piece] = once.copy(), twice.copy()
        for lo in range(0, len(held), 256):
            some = sorted(held)[lo:lo + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()),
                                              pa.array([zlib.compress(held[k][1].tobytes(), 1) for k in some], pa.binary())],
                                             names=["piece", "twice"])

    return pieces.repartition("piece").mapInArrow(run, "piece int, twice binary")


def seen_again(texts: DataFrame, bits: int, probes: int, min_chars: int) -> np.ndarray:
    """The second filter; ``bits`` / 8 bytes reach the driver whatever the number of rows."""
    bitmap = np.zeros(bits // 8, dtype=np.uint8)
    size = min(PIECE, bits // 8)
    for row in merged(filled(texts, bits, probes, min_chars)).toLocalIterator():
        bitmap[row.piece * size:(row.piece + 1) * size] = np.frombuffer(zlib.decompress(row.twice), dtype=np.uint8)
    return bitmap


def with_suspects(own: DataFrame, again, bits: int, probes: int, min_chars: int, suspected: bool) -> DataFrame:
    """``own`` (row_, id_, text_), the documents with suspects or those without; suspects_ are SHA-256 of keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = again.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found, keys = [], [keys_of(t.as_py(), min_chars) for t in part.column(2)]
                flat = [k for ks in keys for k in ks]
                hit = has(bitmap, places(hashes_of(flat), bits, probes)) if flat else np.zeros(0, dtype=bool)
                at = 0
                for ks in keys:
                    found.append([hashlib.sha256(k).digest() for k in {k for k, h in zip(ks, hit[at:at + len(ks)]) if h and k}])
                    at += len(ks)
                take = pa.array([bool(f) == suspected for f in found])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.binary()))],
                                                 names=[*part.schema.names, "suspects_"]).filter(take)

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("suspects_", T.ArrayType(T.BinaryType()))]))


def without(text: str, drops: str, min_chars: int) -> Column:
    """The text less the lines whose key's SHA-256 is among ``drops``, and the numbers of lines before and dropped."""
    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def of(text: pd.Series, drops: pd.Series) -> pd.DataFrame:
        out = []
        for t, gone in zip(text, drops):
            kept = lines = t.split("\n")
            if gone is not None and len(gone):
                gone = {bytes(x) for x in gone}
                kept = [line for line, k in zip(lines, keys_of(t, min_chars)) if not k or hashlib.sha256(k).digest() not in gone]
            out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"])

    return of(text, drops)


def drop_repeated(docs: DataFrame, min_chars: int = 10, bits_per_line: int = 16, max_bits: int = 1 << 30) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``text`` less the repeated lines, and n_lines (before), n_dropped."""
    spark = docs.sparkSession
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row_"),
                      F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id")).alias("id_"), text_of().alias("text_"))
    n_lines = own.select(F.sum(F.length("text_") - F.length(F.replace("text_", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = min(max_bits, 1 << max(16, int(bits_per_line * n_lines).bit_length()))
    probes = max(1, min(4, round(0.69 * bits / max(1, n_lines))))
    again = spark.sparkContext.broadcast(seen_again(own.select("text_"), bits, probes, min_chars))

    suspects = materialise(with_suspects(own, again, bits, probes, min_chars, True))
    each = suspects.select("id_", F.explode("suspects_").alias("key"))
    first = each.groupBy("key").agg(F.min("id_").alias("first"), F.max("id_").alias("last")).where("first < last").select("key", "first")
    drops = each.join(first, "key").where("id_ > first").groupBy("id_").agg(F.collect_set("key").alias("drops_"))
    moved = suspects.drop("suspects_").join(drops, suspects["id_"].eqNullSafe(drops["id_"]), "left").select("row_", "text_", "drops_")
    stayed = with_suspects(own, again, bits, probes, min_chars, False).select("row_", "text_", F.lit(None).cast("array<binary>").alias("drops_"))
    done = moved.unionByName(stayed).withColumn("done_", without("text_", "drops_", min_chars))
    wide = {c: F.col(f"row_.`{c}`") for c in rest} | {"text": F.col("done_.text")}
    return done.select(*[wide[c].alias(c) for c in docs.columns if c in wide], "done_.n_lines", "done_.n_dropped")
