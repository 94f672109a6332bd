"""A Merkle manifest of a table, in blocks laid out by van Emde Boas.

Leaves stand in the order of their key inside each group (source). Every ``ARITY`` consecutive nodes become the hash of
their digests until one remains, the group's subroot; the subroots, by group, likewise give the root.

A group's tree is cut into aligned subtrees of ``height`` levels of edges. Each is one row, whose nodes stand in a byte
array in van Emde Boas order: the tree is split at half its levels, the upper part is stored first, then the lower parts
from left to right, each laid out the same way. A node's place follows from its level and index by arithmetic alone
(``address``), for building and for finding siblings, whatever the size of a cache line or page. Block roots are the
leaves of the next layer of blocks; layers follow until every group has one block. Subroots are one more such tree.

Positions come from slices: rows are range-partitioned on (group, key, leaf), written, numbered inside each slice and
shifted by what the slices before hold, so no group's rows meet in one task. A block has at most ``ARITY ** height`` leaves.

Defined cases: a null field is hashed as ``-``; a null key comes first in its group, the null group first of all; rows of
equal keys follow by leaf digest, and equal rows are interchangeable; an empty text is the field ``0:``; an empty table has
no blocks and gives no rows. Only the named columns are read, so further columns of any name don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.session import materialise

ARITY, HEIGHT, DIGEST = 3, 7, 32
BLOCK = "group string, no long, layer int, n long, blocks long, ids array<string>, claims binary, nodes binary, root binary"


def digest_of(*fields: Column) -> Column:
    """Hex digest of fields, each as its UTF-8 length, a colon and its value, or ``-`` if null."""
    parts = []
    for f in fields:
        s = f.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def hashed(digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(digests).hex().encode()).digest()


def size_of(levels: int) -> int:
    """Nodes of a whole tree with so many levels of nodes."""
    return (ARITY ** levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Place of the nodes ``index`` of level ``depth`` (0: the root) in a tree of ``levels``."""
    base = np.zeros_like(index)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        depth, below = depth - top, ARITY ** (depth - top)
        base = base + size_of(top) + (index // below) * size_of(levels - top)
        index, levels = index % below, levels - top
    return base


@lru_cache(maxsize=256)
def places(levels: int, depth: int, n: int) -> np.ndarray:
    return address(levels, depth, np.arange(n, dtype=np.int64)) * DIGEST


def levels_of(n: int, blocks: int, height: int) -> int:
    """Levels of a block: all of them if others stand beside it, else as many as its ``n`` leaves need."""
    levels = 1
    while (ARITY ** (levels - 1) < n) if blocks == 1 else levels <= height:
        levels += 1
    return levels


def laid_out(leaves: list[bytes], levels: int) -> bytes:
    """The nodes of a block above its ``leaves``; places of nodes that don't exist stay zero."""
    out = bytearray(size_of(levels) * DIGEST)
    row = leaves
    for depth in range(levels - 1, -1, -1):
        for at, x in zip(places(levels, depth, len(row)).tolist(), row):
            out[at:at + DIGEST] = x
        if depth:
            row = [hashed(row[k:k + ARITY]) for k in range(0, len(row), ARITY)]
    return bytes(out)


def siblings(nodes: bytes, levels: int, n: int, index: int) -> list[tuple[bytes, bytes]]:
    """(digests left, digests right) of leaf ``index`` among its run, from the leaves up to below the root."""
    out = []
    for depth in range(levels - 1, 0, -1):
        at, first = places(levels, depth, n), index - index % ARITY
        node = [nodes[at[k]:at[k] + DIGEST] for k in range(first, min(first + ARITY, n))]
        out.append((b"".join(node[:index - first]), b"".join(node[index - first + 1:])))
        index, n = index // ARITY, -(-n // ARITY)
    return out


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with their place ``at`` (from 0) in the group by ``order``, and the group's size ``all``."""
    laid = materialise(rows.repartitionByRange(group, *order).withColumn("slice", F.spark_partition_id()))
    held = laid.groupBy(group, "slice").agg(F.count(F.lit(1)).alias("rows"))
    same = Window.partitionBy(group)  # a group has one row per slice that it touches
    ahead = same.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = held.select(F.col(group).alias("group_"), F.col("slice").alias("slice_"), F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("shift"),
                         F.sum("rows").over(same).alias("all"))
    local = F.row_number().over(Window.partitionBy(group, "slice").orderBy(*order)) - 1
    met = F.col(group).eqNullSafe(F.col("group_")) & (F.col("slice") == F.col("slice_"))
    return (laid.withColumn("local", local.cast("long")).join(shifts, met)
            .select(*rows.columns, (F.col("local") + F.col("shift")).alias("at"), "all"))


def blocks_of(rows: DataFrame, layer: int, height: int) -> DataFrame:
    """``rows`` (group, at, all, id, leaf, claim) as blocks."""
    width = ARITY ** height

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("at")
        blocks = -(-int(part["all"].iloc[0]) // width)
        leaves = [bytes(x) for x in part["leaf"]]
        nodes = laid_out(leaves, levels_of(len(leaves), blocks, height))
        return pd.DataFrame([(part["group"].iloc[0], int(key[1]), layer, len(leaves), blocks, list(part["id"]),
                              b"".join(bytes(x) for x in part["claim"]), nodes, nodes[:DIGEST])],
                            columns=[c.split()[0] for c in BLOCK.split(", ")])

    return rows.groupBy("group", F.floor(F.col("at") / width).alias("no")).applyInPandas(run, BLOCK)


@dataclass
class Manifest:
    """Layers of blocks, from the leaves of the groups up to the root; ``top`` is the first layer over subroots."""
    layers: list[DataFrame]
    top: int
    height: int


def layered(rows: DataFrame, layers: list[DataFrame], height: int) -> DataFrame:
    """Add layers of blocks over numbered ``rows`` until every group has one block; the last layer."""
    while True:
        layers.append(materialise(blocks_of(rows, len(layers), height)))
        if (layers[-1].agg(F.max("blocks")).first()[0] or 1) == 1:
            return layers[-1]
        rows = layers[-1].select("group", F.col("no").alias("at"), F.col("blocks").alias("all"), F.lit(None).cast("string").alias("id"),
                                 F.col("root").alias("leaf"), F.lit(b"").alias("claim"))


def build(leaves: DataFrame, height: int = HEIGHT) -> Manifest:
    """``leaves``: group, key, leaf and claim (hex digests; claim is that of the copy to be verified against the
    manifest, leaf itself if there is none) and id, a string that goes along."""
    own = leaves.select("group", "key", "id", F.unhex("leaf").alias("leaf"), F.unhex("claim").alias("claim"))
    layers: list[DataFrame] = []
    subroots = layered(numbered(own, "group", ["key", "leaf", "claim"]).drop("key"), layers, height)
    top = len(layers)
    # one more tree, whose leaves are named after their groups
    over = subroots.select(F.lit("").alias("whole"), F.col("group").alias("id"), F.col("root").alias("leaf"), F.lit(b"").alias("claim"))
    rows = numbered(over, "whole", ["id"]).withColumnRenamed("whole", "group")
    layered(rows, layers, height)
    return Manifest(layers, top, height)


PATH = "left array<binary>, right array<binary>, subroot binary, root binary"


def paths(blocks: DataFrame, above: DataFrame | None, height: int, top: bool) -> DataFrame:
    """The way up of every leaf of ``blocks``: (group, no) of what it is the root of, digests left and right by level.

    ``above``: the way of each block's own root; none for the last layer.
    """
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for b in frame.itertuples(index=False):
                nodes, levels = bytes(b.nodes), levels_of(b.n, b.blocks, height)
                rows = []
                for k in range(b.n):
                    mine = siblings(nodes, levels, b.n, k)
                    left, right = [x for x, _ in mine], [x for _, x in mine]
                    if b.left is not None:
                        left, right = left + [bytes(x) for x in b.left], right + [bytes(x) for x in b.right]
                    root = b.root_ if b.root_ is not None else b.root
                    first = b.no * ARITY ** height + k
                    # the subroots' own tree names its leaves after groups
                    rows.append((b.ids[k], 0, left, right, bytes(b.nodes[(at := places(levels, levels - 1, b.n)[k]):at + DIGEST]), root) if top
                                else (b.group, first, left, right, b.subroot, root))
                    if len(rows) == 2000:
                        yield pd.DataFrame(rows, columns=["group", "no", "left", "right", "subroot", "root"])
                        rows = []
                yield pd.DataFrame(rows, columns=["group", "no", "left", "right", "subroot", "root"])

    met = with_way(blocks, above).select("group", "no", "n", "blocks", "ids", "nodes", "root", "left", "right", "subroot", "root_")
    return met.mapInPandas(run, f"group string, no long, {PATH}")


def with_way(blocks: DataFrame, above: DataFrame | None) -> DataFrame:
    if above is None:
        return blocks.selectExpr("*", "cast(null AS array<binary>) AS left", "cast(null AS array<binary>) AS right",
                                 "cast(null AS binary) AS subroot", "cast(null AS binary) AS root_")
    way = above.select(F.col("group").alias("group_"), F.col("no").alias("no_"), "left", "right", "subroot", F.col("root").alias("root_"))
    return blocks.join(way, F.col("group").eqNullSafe(F.col("group_")) & (F.col("no") == F.col("no_"))).drop("group_", "no_")


PROOF = ("id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, "
         "siblings array<string>")


def proofs(manifest: Manifest, with_siblings: bool = False) -> DataFrame:
    """One row per leaf: its id, its sibling digests up to the root (their hash; themselves if asked for), the root folded
    from the leaf's claim with them, and whether that is the root."""
    height = manifest.height
    above = None
    for k in range(len(manifest.layers) - 1, 0, -1):
        above = materialise(paths(manifest.layers[k], above, height, k == manifest.top))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PROOF.split(", ")]
        for frame in frames:
            for b in frame.itertuples(index=False):
                nodes, claims, levels = bytes(b.nodes), bytes(b.claims), levels_of(b.n, b.blocks, height)
                upper = [(bytes(x), bytes(y)) for x, y in zip(b.left, b.right)]
                at, root, subroot, rows = places(levels, levels - 1, b.n), bytes(b.root_), bytes(b.subroot).hex(), []
                for k in range(b.n):
                    way = siblings(nodes, levels, b.n, k) + upper
                    proof = [x + y for x, y in way]
                    claim = claims[k * DIGEST:(k + 1) * DIGEST]
                    for x, y in way:
                        claim = hashed([x, claim, y])
                    each = [p.hex()[i:i + 2 * DIGEST] for p in proof for i in range(0, 2 * len(p), 2 * DIGEST)] if with_siblings else None
                    rows.append((b.ids[k], nodes[at[k]:at[k] + DIGEST].hex(), subroot, root.hex(), hashed(proof).hex(), claim.hex(),
                                 claim == root, each))
                    if len(rows) == 2000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                yield pd.DataFrame(rows, columns=names)

    return with_way(manifest.layers[0], above).mapInPandas(run, PROOF)
