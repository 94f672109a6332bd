"""Links inside buckets, and connected components of link tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import mix
from factorloom.llm.packs import dealt, each_part
from factorloom.session import discard, materialise

BUCKETS = pa.schema([("bucket", pa.int64()), ("node", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
CHECKED = 1 << 15  # rows of groups
ELEMENTS = 1 << 20  # of groups that are looked at together
PAIRS = 1 << 20  # meetings at shared elements, or in sets
ROWS = 50_000  # of a batch that a task gives out
SALT, LOW = np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << 32) - 1)


def _mark(links: DataFrame) -> tuple:
    """The number of links and a sum over them, which tell whether a step has changed any."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) as (node, root), the least node of its component, for every node but the roots.

    Alternating large-star and small-star steps: each is one aggregate (combined before it is shuffled) and one join, and
    every step's links are written, so the lineage stays short. The number of steps grows with the logarithm of the
    links; links that leave nothing to move end it.
    """
    links = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct())
    mark = _mark(links)
    while True:
        both = links.unionByName(links.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("m")).select("node", F.least("m", "node").alias("m"))
        large = both.join(least, "node").where("root > node").select(F.col("root").alias("node"), F.col("m").alias("root"))
        large = large.where("node <> root").distinct()
        lower = large.groupBy("node").agg(F.min("root").alias("m"))
        small = large.join(lower, "node").select("node", "root", "m")
        moved = (small.where("root <> m").select(F.col("root").alias("node"), F.col("m").alias("root"))
                 .unionByName(small.select("node", F.col("m").alias("root"))).distinct())
        moved = materialise(moved)
        mark, last = _mark(moved), mark
        discard(links)  # what was read from it is written
        if mark == last:
            return moved
        links = moved


def classed(df: DataFrame, column: str, classes: DataFrame | None, name: str) -> DataFrame:
    """``df`` with the root of ``column`` as ``name``."""
    if classes is None:
        return df.withColumn(name, F.col(column))
    held = classes.select(F.col("node").alias("node_"), F.col("root").alias("root_"))
    return (df.join(held, F.col(column) == F.col("node_"), "left").withColumn(name, F.coalesce("root_", column))
            .drop("node_", "root_"))


def joined_classes(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` (of ``components``) after more ``links``: only their roots are linked anew."""
    across = classed(classed(links.select("a", "b"), "a", classes, "root_a"), "b", classes, "root_b").where("root_a <> root_b")
    moved = components(across.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")))
    return materialise(classed(classes.withColumnRenamed("root", "old"), "old", moved, "root").select("node", "root")
                       .unionByName(moved.join(classes, "node", "left_anti")))


def spark_hash(*values: np.ndarray) -> np.ndarray:
    """``F.xxhash64`` of columns of longs."""
    p1, p2, p3, p4, p5 = map(np.uint64, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, k: x << np.uint64(k) | x >> np.uint64(64 - k)
    h = np.uint64(42)
    with np.errstate(over="ignore"):
        for x in values:
            h = h + p5 + np.uint64(8) ^ turned(x.view(np.uint64) * p2, 31) * p1
            h = turned(h, 27) * p1 + p4
            h = (h ^ h >> np.uint64(33)) * p2
            h = (h ^ h >> np.uint64(29)) * p3
            h = h ^ h >> np.uint64(32)
    return h.view(np.int64)


def first_of(*keys: np.ndarray) -> np.ndarray:
    """Where rows that are in order of ``keys`` begin anew."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]) - 1, bool)
    for x in keys:
        new |= x[1:] != x[:-1]
    return np.flatnonzero(np.append(True, new))


def of_each(begins: np.ndarray, n: int) -> np.ndarray:
    """For ``n`` rows the number of their group."""
    return np.repeat(np.arange(len(begins)), np.diff(np.append(begins, n)))


def stretches(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places [start, start + size) of each, and the number it belongs to."""
    number = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(number)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes), number


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Rows in order of their first column as tables of ``rows`` or more that no group of it goes beyond."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held)
            key = table.column(0).to_numpy()
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            n = 0 if cut else -n  # a group that is larger is looked at again when it has doubled
    if held:
        yield pa.Table.from_batches(held)


def met(buckets: DataFrame) -> DataFrame:
    """What is to compare in ``buckets`` (``BUCKETS``, packed by bucket), each of which has one node as representative, the least by hash
    (so a node meets others elsewhere). kind 0: its pairs with the others, a and b, the number c of buckets, and the places [i, j] of a
    and [k, l] of b. kind 1: the others where they are two or more: c is the node, b tells equal sets of nodes, a is the least node
    of the set by hash, which sets that overlap have in common often, and [i, j] are the node's places. A row may come in parts."""

    def parts(bucket: np.ndarray, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        order = np.lexsort((node, bucket))
        bucket, node, lo, hi = bucket[order], node[order], lo[order], hi[order]
        begins = first_of(bucket, node)
        bucket, node, lo, hi = bucket[begins], node[begins], np.minimum.reduceat(lo, begins), np.maximum.reduceat(hi, begins)
        begins = first_of(bucket)
        sizes = np.diff(np.append(begins, len(bucket)))
        several = np.repeat(sizes > 1, sizes)
        bucket, node, lo, hi, sizes = bucket[several], node[several], lo[several], hi[several], sizes[sizes > 1]
        if not len(bucket):
            return
        begins = np.cumsum(sizes) - sizes
        number = np.repeat(np.arange(len(sizes)), sizes)
        mark = spark_hash(node, bucket)
        least = np.flatnonzero(mark == np.minimum.reduceat(mark, begins)[number])
        rep = least[first_of(number[least])]
        others = np.ones(len(node), bool)
        others[rep] = False
        x, y = np.flatnonzero(others), rep[number[others]]
        x, y = np.where(node[x] > node[y], x, y), np.where(node[x] > node[y], y, x)
        order = np.lexsort((node[y], node[x]))
        x, y = x[order], y[order]
        at = first_of(node[x], node[y])
        yield (np.zeros(len(at), np.int32), node[x[at]], node[y[at]], np.diff(np.append(at, len(x))), np.minimum.reduceat(lo[x], at),
               np.maximum.reduceat(hi[x], at), np.minimum.reduceat(lo[y], at), np.maximum.reduceat(hi[y], at))
        left = np.flatnonzero(others & (sizes > 2)[number])
        if len(left):
            marks, at = mix(node[left].view(np.uint64) ^ SALT), first_of(number[left])
            of = of_each(at, len(left))
            with np.errstate(over="ignore"):
                same, low = np.add.reduceat(marks, at)[of], np.minimum.reduceat(marks, at)[of]
            order = np.lexsort((node[left], same))
            left, same, low = left[order], same[order].view(np.int64), low[order].view(np.int64)
            at = first_of(same, node[left])
            places = np.minimum.reduceat(lo[left], at), np.maximum.reduceat(hi[left], at)
            yield (np.ones(len(at), np.int32), low[at], same[at], node[left[at]], *places, *(np.zeros(len(at), np.int32),) * 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in each_part(batches, BUCKETS):
            for found in parts(*(table.column(x).to_numpy() for x in ("bucket", "node", "lo", "hi"))):
                for k in range(0, len(found[0]), ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(x[k:k + ROWS]) for x in found], names=["kind", "a", "b", "c", "i", "j", "k", "l"])

    return dealt(buckets).mapInArrow(run, "kind int, a long, b long, c long, i int, j int, k int, l int")


def sharing(group: np.ndarray, class_: np.ndarray, open_: np.ndarray, elements: np.ndarray, sizes: np.ndarray, block: int, lacks: int) -> np.ndarray:
    """Codes i * n + j of the pairs i > j of n nodes of one ``group`` that may be similar, across classes or with one of them
    ``open_``. ``elements`` are the nodes' elements, one node after the other, ``sizes`` of each. In every ``block`` of one of two
    similar nodes the other holds all elements but ``lacks`` at most; a stretch of half a block is inside every block. So the nodes
    share one of the ``lacks`` + 1 elements of such a stretch that are rarest in their group, and a common line is passed over."""
    n = len(sizes)
    node = np.repeat(np.arange(n), sizes)
    # the element in its group by 32 bits of a hash, which at worst takes two for one and so adds pairs; and the node
    key = mix(group[node].astype(np.uint64) << np.uint64(32) | elements.view(np.uint32)) & ~LOW | node.astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    new = np.append(True, key[1:] >> np.uint64(32) != key[:-1] >> np.uint64(32))
    of = np.empty(len(key), np.int64)
    of[order] = np.cumsum(new) - 1  # number of the element
    once = np.append(True, key[1:] != key[:-1])
    holder, begins = (key[once] & LOW).astype(np.int64), np.flatnonzero(new[once])
    times = np.diff(np.append(begins, len(holder)))
    half = block // 2
    if lacks + 1 <= half:
        whole = sizes // half
        at, _ = stretches(np.cumsum(sizes) - sizes, whole * half)
        rarest = np.argpartition(times[of[at]].reshape(-1, half), lacks, axis=1)[:, :lacks + 1]
        at = at.reshape(-1, half)[np.arange(len(rarest))[:, None], rarest].ravel()
    else:
        at = np.arange(len(key))
    low, high = np.minimum.reduceat(class_[holder], begins), np.maximum.reduceat(class_[holder], begins)
    wanted = (times > 1) & ((low != high) | np.logical_or.reduceat(open_[holder], begins))
    at = at[wanted[of[at]]]
    code = np.unique(of[at] * n + node[at])
    of, node = code // n, code % n
    found = [np.zeros(0, np.int64)]
    ends, k = np.cumsum(times[of]), 0
    while k < len(of):
        stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, side="right")))
        to, number = stretches(begins[of[k:stop]], times[of[k:stop]])
        x, y = node[k:stop][number], holder[to]
        some = (x != y) & ((class_[x] != class_[y]) | open_[x] | open_[y])
        x, y = x[some], y[some]
        found.append(np.unique(np.maximum(x, y) * n + np.minimum(x, y)))
        k = stop
    return np.unique(np.concatenate(found))


def left_over(met_: DataFrame, nodes: DataFrame, block: int, lacks: int) -> DataFrame:
    """The pairs (a, b) of nodes that are in one set of ``met_``'s kind 1 and may be similar, across classes or where one's places
    there are not covered. ``nodes`` has node, class, first, last, runs."""
    sets = met_.where("kind = 1").select(F.col("a").alias("group"), F.col("b").alias("set"), F.col("c").alias("node"), F.col("i").alias("lo"), F.col("j").alias("hi"))
    wide = (sets.select("group", "node").distinct().join(nodes, "node")
            .select("group", F.lit(0).alias("kind"), "node", "class", F.coalesce("first", F.lit(1)).alias("lo"), F.coalesce("last", F.lit(0)).alias("hi"), "runs"))
    rows = wide.unionByName(sets.select("group", F.lit(1).alias("kind"), "node", F.col("set").alias("class"), "lo", "hi", F.lit(None).cast("binary").alias("runs")))

    def slices(table: pa.Table) -> Iterator[pa.Table]:
        """Whole groups of about ``ELEMENTS`` elements."""
        table = table.combine_chunks()
        begins = first_of(table.column("group").to_numpy())
        ends = np.append(begins[1:], table.num_rows)
        total = np.cumsum(np.add.reduceat(np.append(pc.fill_null(pc.binary_length(table.column("runs")), 0).to_numpy(), 0), begins) // 4)
        k = 0
        while k < len(begins):
            stop = max(k + 1, int(np.searchsorted(total, (total[k - 1] if k else 0) + ELEMENTS, side="right")))
            yield table.slice(int(begins[k]), int(ends[stop - 1] - begins[k]))
            k = stop

    def pairs(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        group, kind, node, class_, lo, hi = (table.column(x).to_numpy() for x in ("group", "kind", "node", "class", "lo", "hi"))
        group = of_each(first_of(group), len(group))
        one, many = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)  # nodes of groups, and of sets
        names, local = np.unique(node, return_inverse=True)
        code = group * len(names) + local
        by = one[np.argsort(code[one], kind="stable")]
        of = by[np.searchsorted(code[by], code[many])]  # each row's node in its group
        # without places that are covered first is 1 and last 0
        bare = (lo[many] < lo[of]) | (hi[many] > hi[of]) | (lo[of] > hi[of])
        order = np.lexsort((of, class_[many]))
        sets, of, bare = class_[many][order], of[order], bare[order]
        at = first_of(sets, of)
        sets, of, bare = sets[at], of[at], np.logical_or.reduceat(bare, at)
        at = first_of(sets)
        number = of_each(at, len(sets))
        is_open = np.minimum.reduceat(class_[of], at) != np.maximum.reduceat(class_[of], at)
        is_open |= np.logical_or.reduceat(bare, at)
        open_ = is_open[number]
        if not open_.any():
            return
        number, of, bare = number[open_], of[open_], bare[open_]
        used, at = np.unique(of, return_inverse=True)
        any_bare = np.bincount(at, weights=bare) > 0
        runs = table.column("runs").chunk(0).take(pa.array(used))
        elements, sizes = np.frombuffer(b"".join(runs.to_pylist()), np.int32), runs_sizes(runs)
        code = sharing(group[used], class_[used], any_bare, elements, sizes, block, lacks)
        x, y = code // len(used), code % len(used)
        # those that are in one set indeed, with a reason to be compared there
        order = np.lexsort((number, at))
        at, number, bare = at[order], number[order], bare[order]
        begins, m = np.searchsorted(at, np.arange(len(used) + 1)), int(number.max()) + 1
        place = at * m + number
        x, y = np.where(np.diff(begins)[x] <= np.diff(begins)[y], (x, y), (y, x))  # x is in fewer sets
        ends, k = np.cumsum(np.diff(begins)[x]), 0
        while k < len(x):
            stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, side="right")))
            i, j = x[k:stop], y[k:stop]
            to, pair = stretches(begins[i], begins[i + 1] - begins[i])
            other = np.minimum(np.searchsorted(place, j[pair] * m + number[to]), len(place) - 1)
            good = (place[other] == j[pair] * m + number[to]) & (bare[to] | bare[other] | (class_[used[i[pair]]] != class_[used[j[pair]]]))
            some = np.unique(pair[good])
            a, b = node[used[i[some]]], node[used[j[some]]]
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b))], names=["a", "b"])
            k = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, CHECKED):
            if table.num_rows:
                for some in slices(table):
                    yield from pairs(some)

    return (rows.repartition("group").sortWithinPartitions("group", "kind").select("group", "kind", "node", "class", "lo", "hi", "runs")
            .mapInArrow(run, "a long, b long").distinct())


def runs_sizes(runs: pa.Array) -> np.ndarray:
    return np.diff(np.frombuffer(runs.buffers()[1], np.int32)[runs.offset:runs.offset + len(runs) + 1]) // 4


def link_buckets(buckets: DataFrame, runs: DataFrame, verify: Callable[[DataFrame], DataFrame],
                 covered: Callable[[DataFrame | None], DataFrame], block: int, lacks: int) -> tuple[DataFrame | None, DataFrame | None]:
    """Verified links between the nodes of ``buckets`` (bucket, node, and its places [lo, hi] there; packed by bucket), and their components; None
    where there are none. ``runs`` has each node's elements, ``verify`` keeps the true ones of pairs (a, b) and may add columns,
    ``covered`` gives the stretch that links cover as node, first, last.

    First a representative of each bucket is compared with its other nodes: with the partner that shares most such buckets, then
    with those across classes, and those of one class unless the places that their buckets stand for are covered in both. So a bucket
    of copies is done after one comparison a node. Of all other pairs of a bucket those are compared then that are still across classes or
    not covered, and share an element that is rare among nodes they meet, as similar ones do (``sharing``); which do is found inside
    the tasks, and no others become rows. So no two similar nodes of a bucket end in different classes.
    """
    both = materialise(met(buckets))
    links, classes, cover = None, None, materialise(covered(None))

    def bare(df: DataFrame, node: str, lo: str, hi: str, name: str) -> DataFrame:
        """``df`` with whether [lo, hi] of the node is not covered."""
        held = cover.select(F.col("node").alias("node_"), F.col("first").alias("first_"), F.col("last").alias("last_"))
        within = F.coalesce((F.col(lo) >= F.col("first_")) & (F.col(hi) <= F.col("last_")), F.lit(False))
        return df.join(held, F.col(node) == F.col("node_"), "left").withColumn(name, ~within).drop("node_", "first_", "last_")

    def wanted(pairs: DataFrame) -> DataFrame:
        """The pairs across classes, and those with places that are not covered."""
        pairs = classed(classed(pairs, "a", classes, "class_a"), "b", classes, "class_b")
        pairs = bare(bare(pairs, "a", "a_lo", "a_hi", "bare_a"), "b", "b_lo", "b_hi", "bare_b")
        return pairs.where("class_a <> class_b OR bare_a OR bare_b").drop("class_a", "class_b", "bare_a", "bare_b")

    def add(pairs: DataFrame) -> None:
        nonlocal links, classes, cover
        new = materialise(verify(pairs.select("a", "b")))
        if new.limit(1).count():
            links = new if links is None else links.unionByName(new)
            classes = components(new) if classes is None else joined_classes(classes, new)
            cover = materialise(covered(links))

    pairs = materialise(wanted(both.where("kind = 0").groupBy("a", "b").agg(
        F.sum("c").alias("shared"), F.min("i").alias("a_lo"), F.max("j").alias("a_hi"), F.min("k").alias("b_lo"), F.max("l").alias("b_hi"))))
    best = pairs.groupBy("a").agg(F.max_by("b", F.struct("shared", "b")).alias("b"))
    add(best)
    add(wanted(pairs.join(best, ["a", "b"], "left_anti")))
    nodes = classed(runs.join(cover, "node", "left"), "node", classes, "class")
    add(left_over(both, nodes, block, lacks).join(pairs.select("a", "b"), ["a", "b"], "left_anti"))
    discard(both)
    return links, classes
