"""Jaccard join of word n-gram sets by a min-hash forest.

A text's set holds the hashes of its runs of five words. Every tree of the forest gives a set a label of min-hashes; sorted
labels are a trie, whose nodes are the prefixes that labels share. Matched prefixes start long, where partners are near
certain, and are shortened level by level until 1 - (1 - s^depth)^trees, the chance that sets of similarity s share a
prefix in some tree, reaches the target recall (which also covers what the sketch below may lose). How far a prefix is
shortened depends on what stands below it: a trie node whose only child holds the same sets is skipped, and once a
node's sets are all of one class nothing above it compares them again; only nodes where classes meet are opened.

Two bits of every min-hash are a sketch; a candidate whose sketches differ in more bits than those of similar sets do (but
for a chance of ``LOSS``) is left where it is met, every other is verified on the whole sets. Inside a trie node sets are
compared with one representative first (one order by hash for all trees), so a large group of near copies is one class soon.
Below the shortest prefixes all pairs that are still of different classes are compared, in blocks: first the sketches, then
the whole sets of those with a partner left. Pairs stay inside the tasks; only links that join classes leave them. That gives the classes; then the sets of a class are counted against each other
exactly, in blocks of about ``BLOCK`` elements, and only each node's count leaves a block.

The result is a row per document with its class (the least doc_id of the documents linked with it, over others too) and
its links: all other documents whose text is similar, copies of its own text among them. Equal sets are one node, and a
node's partners count with all their documents, so the links of the two ends agree.

Words are runs without white space. A text of one to four words has one run of all its words; a text without words (null,
empty) is in a class of its own. Rows that repeat are copies; rows with a null doc_id join classes, whose id is the least
that is not null. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.llm.common import SIMILARITY, as_long, mix, shingle_hashes, text_of
from factorloom.llm.graph import classed, components
from factorloom.session import discard, materialise

TREES, DEEPEST, STEP, RECALL = 16, 8, 4, 0.999
CHUNK = 1024  # runs hashed at a time
LOSS = 1e-4
BLOCK = 1 << 20  # elements of a class's or a trie node's block
SKETCHES, PAIRS = 4096, 1 << 16  # sketches of a trie node's block, and pairs of them compared at a time
ROWS = 400  # texts whose results a task holds at a time


def allowed(similarity: float, hashes: int, loss: float = LOSS) -> int:
    """Least number of differing sketch bits that sets of that similarity exceed with a chance of ``loss`` at most: each of
    the hashes differs with 1 - similarity, and then each of its two bits with a half."""
    chance = [0.0] * (2 * hashes + 1)
    for k in range(hashes + 1):
        differ = math.comb(hashes, k) * (1 - similarity) ** k * similarity ** (hashes - k)
        for bits in range(2 * k + 1):
            chance[bits] += differ * math.comb(2 * k, bits) / 4.0 ** k
    tail, bits = 0.0, 2 * hashes
    while tail + chance[bits] <= loss:
        tail += chance[bits]
        bits -= 1
    return bits


def depths(similarity: float, trees: int = TREES, deepest: int = DEEPEST, step: int = STEP, recall: float = RECALL) -> list[int]:
    """Prefix lengths from the longest to the first that reaches the recall, the sketch's loss taken off."""
    out, depth, kept = [], deepest, 1 - LOSS
    while True:
        out.append(depth)
        if (1 - (1 - similarity ** depth) ** trees) * kept >= recall or depth == 1:
            return out
        depth = max(1, depth - step)


class Forest:
    """Labels of sets: hashes of each tree's prefixes."""

    def __init__(self, trees: int, lengths: list[int]):
        self.trees, self.lengths = trees, lengths
        n = trees * max(lengths)
        with np.errstate(over="ignore"):
            self.times = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
            self.plus = mix(self.times + np.uint64(0x5851F42D4C957F2D))
            self.tree = mix(np.arange(1, trees + 1, dtype=np.uint64))

    def prefixes(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """trees x lengths hashes, and the sketch: two bits of each min-hash."""
        with np.errstate(over="ignore"):
            least = np.full(len(self.times), np.iinfo(np.uint64).max, dtype=np.uint64)
            for k in range(0, len(runs), CHUNK):
                hashed = self.times[:, None] * runs[k:k + CHUNK]
                hashed += self.plus[:, None]
                np.minimum(least, hashed.min(axis=1), out=least)
            label, held, out = least.reshape(self.trees, -1), self.tree.copy(), {}
            for d in range(label.shape[1]):
                held = mix(held * np.uint64(0xD6E8FEB86659FD93) + label[:, d])
                if d + 1 in self.lengths:
                    out[d + 1] = held
            pairs = mix(least) & np.uint64(3)
            bits = np.packbits(np.concatenate([pairs & np.uint64(1), pairs >> np.uint64(1)]).astype(np.uint8))
            return np.stack([out[x] for x in self.lengths], axis=1), np.resize(bits, -(-len(bits) // 8) * 8).view(np.int64)


def set_of(text: str) -> np.ndarray:
    return np.unique(shingle_hashes(text))


def set_id(runs: np.ndarray) -> bytes:
    """16 bytes that tell sets apart: two sums over differently scrambled elements."""
    with np.errstate(over="ignore"):
        sums = [mix(runs + np.uint64(salt)).sum(dtype=np.uint64) for salt in (0x1234567, 0xABCDEF1)]
        return np.array([*sums], dtype=">u8").tobytes()


def sliced(rows: DataFrame, schema: str, make: Callable[[list[str]], list[pa.Array]]) -> DataFrame:
    """``rows`` (text last) with the text replaced by the columns of ``schema``, made for ``ROWS`` texts at a time."""
    new = T._parse_datatype_string(schema)  # noqa: SLF001

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                made = make([x.as_py() for x in part.column(part.num_columns - 1)])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], *made], names=[*part.schema.names[:-1], *(f.name for f in new)])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *new.fields]))


def long_lists(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*arrays, np.zeros(0, np.int64)]), pa.int64()))


def labelled(docs: DataFrame, trees: int, lengths: list[int], text: str = "text") -> DataFrame:
    """doc_id, node, size, prefixes (by tree, then length; empty for a text without words), sketch."""
    def make(texts: list[str]) -> list[pa.Array]:
        forest, nodes, sizes, paths, sketches = Forest(trees, lengths), [], [], [], []
        for x in texts:
            runs = set_of(x)
            prefixes, sketch = forest.prefixes(runs)
            nodes.append(set_id(runs))
            sizes.append(len(runs))
            paths.append(as_long(prefixes).ravel() if len(runs) else np.zeros(0, np.int64))
            sketches.append(sketch)
        return [pa.array(nodes, pa.binary()), pa.array(sizes, pa.int32()), long_lists(paths), long_lists(sketches)]

    return sliced(docs.select("doc_id", text_of(text).alias("text_")), "node binary, size int, prefixes array<long>, sketch array<long>", make)


def trie(nodes: DataFrame, lengths: list[int]) -> DataFrame:
    """level, bucket, node: the sets below every trie node with two or more (level 0 has the longest prefixes), but for
    those whose parent holds the same sets."""
    k = len(lengths)
    rows = nodes.where("size > 0").select("node", F.explode(F.expr(
        f"transform(sequence(0, size(prefixes) div {k} - 1), t -> slice(prefixes, t * {k} + 1, {k}))")).alias("path"))
    shared = (rows.groupBy(F.col("path")[k - 1].alias("bucket")).agg(F.min("node").alias("low"), F.max("node").alias("high"))
              .where("low <> high").select("bucket"))
    # only sets that share the shortest prefix can share a longer one
    rows = materialise(rows.withColumn("bucket", F.col("path")[k - 1]).join(shared, "bucket", "left_semi").select("node", "path"))
    each = rows.select("node", F.posexplode("path").alias("level", "bucket"), F.col("path"))
    parent = F.get("path", F.col("level") + 1)
    counts = each.groupBy("level", "bucket").agg(F.count(F.lit(1)).alias("n"), F.first(parent).alias("parent")).where("n > 1")
    above = counts.select((F.col("level") - 1).alias("level"), F.col("bucket").alias("parent"), F.col("n").alias("whole"))
    own = counts.join(above, ["level", "parent"], "left").where("whole IS NULL OR n < whole").select("level", "bucket")
    return each.drop("path").join(own, ["level", "bucket"], "left_semi")


def forest_links(tries: DataFrame, levels: int, outline: DataFrame, near: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame],
                 across: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame | None, DataFrame | None]:
    """Verified links between sets below a common trie node, and their components; None where there are none.

    From the longest prefixes to the shortest, the sets of a node where classes meet are compared with one representative,
    so near copies are of one class soon. Sets that share a longer prefix share the shortest one as well: there all that are
    still of different classes are compared, inside the tasks (``across``). ``near`` says of two rows of ``outline`` (by
    node), given their prefixes, whether they are worth verifying.
    """
    links, classes = None, None

    def add(found: DataFrame) -> None:
        nonlocal links, classes
        new = materialise(found)
        if new.limit(1).count():
            links = new if links is None else links.unionByName(new)
            before, classes = classes, components(links)
            if before is not None:
                discard(before)

    for level in range(levels):
        below = tries.where(F.col("level") == level).select("bucket", "node")
        for whole in (False, True) if level + 1 == levels else (False,):
            placed = classed(below, "node", classes, "class")
            sizes = placed.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("n"))
            mixed = sizes.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").select("bucket")
            opened = placed.join(mixed, "bucket")
            if whole:
                opened = materialise(opened.join(outline, "node"))
                add(across(opened))
            else:
                opened = materialise(opened.join(sizes, ["bucket", "class"]).join(outline.drop("prefix"), "node"))
                first = F.min_by(F.struct(*opened.columns), F.struct("n", F.xxhash64("node"), "node")).alias("r")
                reps = opened.groupBy("bucket").agg(first).select("bucket", *[F.col(f"r.{c}").alias(f"rep_{c}") for c in opened.columns if c != "bucket"])
                pairs = (opened.join(reps, (opened["bucket"] == reps["bucket"]) & (F.col("class") != F.col("rep_class")) & near("", "rep_"))
                         .select(F.greatest("node", "rep_node").alias("a"), F.least("node", "rep_node").alias("b")).distinct())
                add(verify(pairs))
            discard(opened)
    return links, classes


def dealt(rows: DataFrame, weight: Column, block: int) -> DataFrame:
    """``rows`` by (bucket, x, y): a bucket is cut into blocks of about ``block`` by hash, and each pair of blocks is a group."""
    blocks = rows.groupBy("bucket").agg(F.ceil(F.sum(weight) / block).alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    return (rows.join(blocks, "bucket").withColumn("own", own).withColumn("other", other)
            .select("bucket", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", *[c for c in rows.columns if c != "bucket"]))


class Group:
    """The rows of one (bucket, x, y): what tells which of its pairs are worth verifying. Those that share a prefix in an
    earlier tree meet there."""

    def __init__(self, rows: dict[str, np.ndarray], similarity: float, most: int):
        self.classes, self.sizes, self.sketches, self.prefixes = (rows[c] for c in ("class_", "size", "sketch", "prefix"))
        x, y = rows["x"][0], rows["y"][0]
        self.same, self.mine, self.theirs = x == y, np.flatnonzero(rows["own"] == x), np.flatnonzero(rows["own"] == y)
        self.tree = int(np.flatnonzero(self.prefixes[0] == rows["bucket"][0])[0])
        self.similarity, self.most = similarity, most

    @staticmethod
    def columns(rows: pa.Table) -> dict[str, np.ndarray]:
        flat = {c: rows.column(c).to_numpy() for c in ("bucket", "x", "y", "own", "class_")}
        wide = {c: rows.column(c).combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1) for c in ("sketch", "prefix")}
        return flat | {"size": rows.column("size").to_numpy().astype(np.int64), "sketch": wide["sketch"].view(np.uint64), "prefix": wide["prefix"]}

    def pairs(self, some: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): rows of ``some`` and of the other side, of different classes, worth verifying here."""
        j = self.theirs
        a, b = self.sizes[some][:, None], self.sizes[j][None]
        if self.same:
            good = j[None] > some[:, None]
        else:
            good = np.ones((len(some), len(j)), bool)
        good &= (classes[some][:, None] != classes[j][None]) & (np.minimum(a, b) >= self.similarity * np.maximum(a, b) - 1e-9)
        if good.any():
            differ = np.bitwise_count(self.sketches[some][:, None] ^ self.sketches[j][None]).sum(axis=2, dtype=np.int32)
            good &= differ <= self.most
        one, two = np.nonzero(good)
        one, two = some[one], j[two]
        if self.tree and len(one):
            here = ~(self.prefixes[one, :self.tree] == self.prefixes[two, :self.tree]).any(axis=1)
            one, two = one[here], two[here]
        return one, two


def by_group(batches: Iterator[pa.RecordBatch], work: Callable[[dict[str, np.ndarray], pa.Table], pa.Table | None]) -> Iterator[pa.RecordBatch]:
    """``work`` on the rows of each (bucket, x, y), as columns and as a table; they lie together, and may go on in the next batch."""
    rest = None

    def done(rows: pa.Table, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal rest
        held, made, lo = Group.columns(rows), [], 0
        keys = np.stack([held[c] for c in ("bucket", "x", "y")])
        for hi in [*(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), *([rows.num_rows] if last else [])]:
            out = work({c: v[lo:hi] for c, v in held.items()}, rows.slice(lo, hi - lo))
            made += [out] if out is not None else []
            lo = hi
        rest = rows.slice(lo)
        if made:
            yield from pa.concat_tables(made).combine_chunks().to_batches()

    for batch in batches:
        if batch.num_rows:
            rows = pa.Table.from_batches([batch])
            yield from done(rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks(), False)
    if rest is not None and rest.num_rows:
        yield from done(rest, True)


def sifted(opened: DataFrame, similarity: float, most: int, block: int = SKETCHES) -> DataFrame:
    """The rows of ``opened`` with a partner of another class in their bucket that is worth verifying."""
    names = ["bucket", "node", "class_", "size", "sketch", "prefix"]
    rows = opened.withColumn("class_", F.xxhash64("class")).select(*names)

    def work(columns: dict[str, np.ndarray], part: pa.Table) -> pa.Table | None:
        group, found = Group(columns, similarity, most), np.zeros(part.num_rows, bool)
        step = max(1, PAIRS // max(1, len(group.theirs)))
        for lo in range(0, len(group.mine), step):
            one, two = group.pairs(group.mine[lo:lo + step], group.classes)
            found[one] = found[two] = True
        return part.select(names).filter(pa.array(found)) if found.any() else None

    groups = dealt(rows, F.lit(1), block).repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    return groups.mapInArrow(lambda batches: by_group(batches, work), rows.schema).dropDuplicates(["bucket", "node"])


def met(rows: DataFrame, runs: DataFrame, similarity: float, most: int, block: int = BLOCK) -> DataFrame:
    """(a, b): links between the sets of a bucket that make one class of all its similar ones; ``rows`` as of ``sifted``.

    A group's sets are verified one against all others of other classes; a link joins their classes there, and pairs of
    one class are not looked at again, so a group gives fewer links than it has rows.
    """
    def work(columns: dict[str, np.ndarray], part: pa.Table) -> pa.Table | None:
        group, classes = Group(columns, similarity, most), columns["class_"].copy()
        lists = part.column("runs").combine_chunks()
        ends = np.concatenate([[0], np.cumsum(group.sizes)])
        known, flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        mask, links = np.zeros(len(known), bool), []
        for i in group.mine.tolist():
            _, others = group.pairs(np.array([i]), classes)
            if not len(others):
                continue
            mine = flat[ends[i]:ends[i + 1]]
            mask[mine] = True
            sizes = group.sizes[others]
            hits = mask[np.concatenate([flat[ends[j]:ends[j + 1]] for j in others.tolist()])]
            mask[mine] = False
            common = np.add.reduceat(hits, np.cumsum(sizes) - sizes, dtype=np.int64)
            for j in others[common >= similarity * (len(mine) + sizes - common) - 1e-9].tolist():
                if classes[i] != classes[j]:
                    links.append((i, j))
                    classes[classes == classes[j]] = classes[i]
        if not links:
            return None
        node, (one, two) = part.column("node"), zip(*links)
        return pa.table({"a": node.take(pa.array(one)), "b": node.take(pa.array(two))})

    groups = dealt(rows.join(runs, "node"), F.col("size").cast("long"), block).repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
    return groups.mapInArrow(lambda batches: by_group(batches, work), "a binary, b binary").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def partners(mine: list[np.ndarray], theirs: list[np.ndarray], copies: np.ndarray, others: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """For each set of ``mine`` the documents of the similar ones of ``theirs``, and the other way round; no set is empty."""
    flat = np.concatenate(theirs)
    sizes = np.array([len(x) for x in theirs])
    starts = np.cumsum(sizes) - sizes
    known, flat = np.unique(flat, return_inverse=True)
    here, there = np.zeros(len(mine), np.int64), np.zeros(len(theirs), np.int64)
    for k, x in enumerate(mine):
        at = np.minimum(np.searchsorted(known, x), len(known) - 1)
        mask = np.zeros(len(known), bool)
        mask[at[known[at] == x]] = True
        common = np.add.reduceat(mask[flat], starts, dtype=np.int64)
        near = common >= similarity * (len(x) + sizes - common) - 1e-9
        here[k] = others[near].sum()
        there[near] += copies[k]
    return here, there


def linked(runs: DataFrame, known: DataFrame, similarity: float, block: int = BLOCK) -> DataFrame:
    """node, linked: the documents of the other nodes of its class whose sets are similar. ``known``: node, root, copies.

    A class is cut into blocks by hash, each pair of blocks is a group. Similar sets are of one class, so none is missed.
    """
    held = runs.join(known.select("node", "root", "copies"), "node")
    sizes = held.groupBy("root").agg(F.ceil(F.sum(F.size("runs").cast("long")) / block).alias("blocks"), F.count(F.lit(1)).alias("n"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = (held.join(sizes.where("n > 1").drop("n"), "root").withColumn("own", own).withColumn("other", other)
             .select("root", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "copies", "runs"))

    def count(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, x, y = key
        first = rows["own"].to_numpy() == x
        one, two = rows[first], rows[~first]
        docs = [part["copies"].to_numpy(dtype=np.int64) for part in (one, two)]
        if x == y:
            return pd.DataFrame({"node": one["node"], "n": partners(list(one["runs"]), list(one["runs"]), docs[0], docs[0], similarity)[0] - docs[0]})
        if not len(one) or not len(two):
            return pd.DataFrame({"node": [], "n": []})
        here, there = partners(list(one["runs"]), list(two["runs"]), *docs, similarity)
        return pd.DataFrame({"node": [*one["node"], *two["node"]], "n": np.concatenate([here, there])})

    return (dealt.groupBy("root", "x", "y").applyInPandas(count, "node binary, n long")
            .groupBy("node").agg(F.sum("n").alias("linked")))


def join(docs: DataFrame, similarity: float = SIMILARITY, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL,
         text: str = "text", counted: bool = True) -> DataFrame:
    """doc_id, class_id, n_links (other documents with a similar or the same text), n_copies per row of docs; without
    n_links where they are not ``counted``."""
    lengths = depths(similarity, trees, deepest, recall=recall)
    labels = materialise(labelled(docs, trees, lengths, text))
    nodes = labels.groupBy("node").agg(F.first("size").alias("size"), F.first("prefixes").alias("prefixes"), F.first("sketch").alias("sketch"),
                                       F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("least_id"))
    tries = materialise(trie(nodes, lengths))
    # the sets themselves, of the nodes that have candidates; a node's first document stands for it
    wanted = materialise(tries.select("node").distinct())
    first = labels.select("node", "doc_id").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))

    def sets(texts: list[str]) -> list[pa.Array]:
        held = [set_of(x) for x in texts]
        return [pa.array([set_id(x) for x in held], pa.binary()), long_lists([as_long(x) for x in held])]

    named = first.select(F.col("doc_id").alias("first_id"))
    shown = docs.join(named, F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi").select(text_of(text).alias("text_"))
    runs = materialise(sliced(shown, "node binary, runs array<long>", sets).join(wanted, "node", "left_semi").dropDuplicates(["node"]))
    shortest = F.expr(f"transform(sequence(1, {trees}), t -> prefixes[t * {len(lengths)} - 1])").alias("prefix")
    outline = materialise(nodes.select("node", "size", "sketch", shortest).join(wanted, "node", "left_semi"))

    most = allowed(similarity, trees * deepest)

    def near(one: str, two: str) -> Column:
        a, b = F.col(f"{one}size"), F.col(f"{two}size")
        differ = sum((F.bit_count(F.col(f"{one}sketch")[k].bitwiseXOR(F.col(f"{two}sketch")[k])) for k in range(-(-trees * deepest // 32))), F.lit(0))
        return (F.least(a, b) >= F.lit(similarity) * F.greatest(a, b) - 1e-9) & (differ <= most)

    def verify(pairs: DataFrame) -> DataFrame:
        both = (pairs.join(runs.withColumnsRenamed({"node": "b", "runs": "runs_b"}), "b")
                .join(runs.withColumnsRenamed({"node": "a", "runs": "runs_a"}), "a"))
        both = both.withColumn("common", F.size(F.array_intersect("runs_a", "runs_b")))
        whole = F.size("runs_a") + F.size("runs_b") - F.col("common")
        return both.where(F.col("common") >= F.lit(similarity) * whole - 1e-9).select("a", "b")

    def across(opened: DataFrame) -> DataFrame:
        return met(materialise(sifted(opened, similarity, most)), runs, similarity, most)

    links, classes = forest_links(tries, len(lengths), outline, near, verify, across)
    known = nodes.select("node", "copies", "least_id")
    if links is None:
        known = known.withColumn("root", F.col("node")).withColumn("linked", F.lit(0).cast("long"))
    else:
        known = classed(known, "node", classes, "root")
        if counted:
            known = materialise(known)
            several = known.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("root")
            known = known.join(linked(runs, known.join(several, "root", "left_semi"), similarity), "node", "left")
        else:
            known = known.withColumn("linked", F.lit(None).cast("long"))
        known = known.withColumn("linked", F.coalesce("linked", F.lit(0)))
    known = materialise(known)
    roots = known.groupBy("root").agg(F.min("least_id").alias("class_id"))
    known = known.join(roots, "root").select("node", "copies", "linked", "class_id")
    with_class = labels.select("doc_id", "node", "size").join(known, "node")
    alone = F.col("size") == 0
    out = with_class.select(
        "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(alone, F.lit(0)).otherwise(F.col("linked") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.when(alone, F.lit(1)).otherwise(F.col("copies")).cast("long").alias("n_copies"))
    return out if counted else out.drop("n_links")


def one_of_each(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` without the documents whose class has one with a smaller doc_id; a repeated row stays once, a document
    without doc_id stays."""
    found = materialise(join(docs.select("doc_id", "text"), counted=False, **settings))
    rest = docs.join(found.where("doc_id <> class_id").select("doc_id").distinct(), "doc_id", "left_anti")
    repeated = found.where("doc_id = class_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id")
    if not repeated.limit(1).count():
        return rest
    once = rest.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return rest.join(repeated, "doc_id", "left_anti").unionByName(once)
