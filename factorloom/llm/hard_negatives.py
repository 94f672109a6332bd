"""Hard negatives by exact inner products over Hilbert-ordered blocks with zone maps.

Rows are ordered along a Hilbert curve over the leading principal axes of a bounded sample, cut into blocks of ``BLOCK``
rows and written as Parquet, one row per block: its vectors, and per dimension the smallest and largest component (the
zone map). By interval arithmetic an anchor's product with any row of a block lies between the sums of the lesser and of
the greater of anchor x smallest and anchor x largest. A search for the best rows of an anchor first reads the block the
anchor stands in, whose results are the mark to beat, and then only blocks whose bounds (and smallest id, among equal
products) can beat it and meet the wanted window of scores. Bounds only rule out what cannot be in the result: it is exact,
and the sample decides nothing but the order.

Two searches follow each other: the best ``positives`` rows of the anchor's label, then, for each of them, the best
``negatives`` rows of other labels in the window that its score spans. Anchors travel in chunks, zone maps in slices, and
blocks meet the chunks that chose them in an equi-join on the block's number; no step holds all rows of a label or block.

Defined cases: rows with a null id or label, a null vector or a null component take no part; of rows with one id the one
with the smallest (label, vector) does; shorter vectors are filled up with zeros, an empty one scores 0; equal scores go by
the smaller id; scores beyond a long are cut to its ends; an empty table, or an anchor without a partner, gives no rows. Only
the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.session import materialise

BLOCK, CHUNK, SLICE = 512, 256, 1024
SAMPLE, AXES, BITS = 10_000, 8, 7
EXACT = float(1 << 53)
LONG = (1 << 63) - 1
BLOCKS = "no long, home long, n int, ids binary, labels binary, anchors binary, vectors binary, lo binary, hi binary, min_id long, kinds binary"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position along the Hilbert curve of points given by cell numbers of ``bits`` bits per axis (Skilling 2004)."""
    x = cells.astype(np.int64).copy()
    axes = x.shape[1]
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(axes):
            turn = (x[:, i] & q) != 0
            swap = np.where(turn, 0, (x[:, 0] ^ x[:, i]) & low)
            x[:, 0] ^= np.where(turn, low, swap)
            x[:, i] ^= swap
    for i in range(1, axes):
        x[:, i] ^= x[:, i - 1]
    flip = np.zeros(len(x), dtype=np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[:, -1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip[:, None]
    key = np.zeros(len(x), dtype=np.int64)
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[:, i] >> bit) & 1)
    return key


@dataclass
class Curve:
    """Where cells lie: principal axes of a sample, two standard deviations to both sides."""
    mean: np.ndarray
    axes: np.ndarray
    spread: np.ndarray

    @staticmethod
    def fitted(sample: np.ndarray) -> Curve:
        mean = sample.mean(axis=0)
        values, vectors = np.linalg.eigh(np.atleast_2d(np.cov(sample, rowvar=False, ddof=0)))
        lead = np.argsort(values)[::-1][:AXES]
        return Curve(mean, vectors[:, lead], np.sqrt(np.maximum(values[lead], 1e-12)))

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        at = (vectors - self.mean) @ self.axes / self.spread  # standard deviations
        cells = np.clip((at + 2) / 4 * (1 << BITS), 0, (1 << BITS) - 1)
        return hilbert(cells, BITS)


def matrix(vectors, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims), dtype=np.int64)
    for k, v in enumerate(vectors):
        out[k, :len(v)] = v
    return out


def packed(x, kind=np.int64) -> bytes:
    return np.ascontiguousarray(x, dtype=kind).tobytes()


def longs(raw: bytes, *shape: int) -> np.ndarray:
    x = np.frombuffer(raw, dtype=np.int64)
    return x.reshape(shape) if shape else x


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b``."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    wide = a.astype(object) @ b.astype(object).T
    return np.clip(wide, -LONG - 1, LONG).astype(np.int64)


def bounds(anchors: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Interval of the products of each anchor with any point between ``lo`` and ``hi`` (one row per block)."""
    a, lo, hi = (x.astype(np.float64) for x in (anchors, lo, hi))
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    least, most = up @ lo.T + down @ hi.T, up @ hi.T + down @ lo.T
    slack = np.abs(a) @ np.maximum(np.abs(lo), np.abs(hi)).T
    slack = np.where(slack < EXACT, 0.0, slack * 1e-9)
    return least - slack, most + slack


def blocks_of(rows: DataFrame, curve: Curve, dims: int) -> DataFrame:
    """``rows`` (id, label, vector, anchor) as blocks along the curve."""
    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(key=curve.keys(matrix(frame["vector"], dims)))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, seq = None, 0
        for frame in frames:
            held = frame if held is None or held.empty else pd.concat([held, frame])
            while len(held) >= BLOCK:
                yield block(held.iloc[:BLOCK], seq)
                held, seq = held.iloc[BLOCK:], seq + 1
        if held is not None and len(held):
            yield block(held, seq)

    def block(part: pd.DataFrame, seq: int) -> pd.DataFrame:
        v, home = matrix(part["vector"], dims), int(part["home"].iloc[0])
        return pd.DataFrame([((home << 32) + seq, home, len(part), packed(part["id"]), packed(part["label"]), packed(part["anchor"]), packed(v),
                              packed(v.min(axis=0)), packed(v.max(axis=0)), int(part["id"].min()), packed(np.unique(part["label"])))],
                            columns=[c.split()[0] for c in BLOCKS.split(", ")])

    ordered = (rows.mapInPandas(keyed, "id long, label long, vector array<long>, anchor boolean, key long")
               .repartitionByRange("key", "id").sortWithinPartitions("key", "id"))
    return ordered.withColumn("home", F.spark_partition_id().cast("long")).mapInPandas(cut, BLOCKS)


@dataclass
class Wanted:
    """What the anchors of a chunk look for, ``slots`` windows each: scores from ``lo`` to ``hi``, of the same label or of
    another, better than (``score``, ``id``) where ``known``."""
    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    known: np.ndarray
    score: np.ndarray
    id: np.ndarray

    SCHEMA = "ids binary, labels binary, vectors binary, lo binary, hi binary, known binary, score binary, id binary"
    NAMES = ("ids", "labels", "vectors", "lo", "hi", "known", "score", "id")

    @staticmethod
    def of(row, dims: int, prefix: str = "") -> Wanted:
        raw = [bytes(getattr(row, prefix + c)) for c in Wanted.NAMES]
        n = len(raw[0]) // 8
        return Wanted(longs(raw[0]), longs(raw[1]), longs(raw[2], n, dims), *[longs(x, n, -1) for x in raw[3:]])

    def taken(self, which: np.ndarray) -> tuple[bytes, ...]:
        return tuple(packed(getattr(self, c)[which]) for c in self.NAMES)

    @staticmethod
    def joined(parts: list[Wanted]) -> Wanted:
        return Wanted(*[np.concatenate([getattr(p, c) for p in parts]) for c in Wanted.NAMES])


def best(wanted: Wanted, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, count: int, same: bool):
    """For each anchor and window, the ``count`` best rows of a block: (anchor's place, window, scores, ids)."""
    scores = products(wanted.vectors, vectors)
    for k in range(len(wanted.ids)):
        fits = ((labels == wanted.labels[k]) if same else (labels != wanted.labels[k])) & (ids != wanted.ids[k])
        for w in range(wanted.lo.shape[1]):
            s = scores[k]
            ok = fits & (s >= wanted.lo[k, w]) & (s <= wanted.hi[k, w])
            if wanted.known[k, w]:
                ok &= (s > wanted.score[k, w]) | ((s == wanted.score[k, w]) & (ids <= wanted.id[k, w]))
            at = np.flatnonzero(ok)
            if len(at):
                at = at[np.lexsort((ids[at], -s[at]))[:count]]
                yield k, w, s[at], ids[at]


def marked(wanted: Wanted, block, dims: int, count: int, same: bool) -> Wanted:
    """``wanted`` with the mark that the rows of ``block`` set."""
    for k, w, s, i in best(wanted, longs(bytes(block.ids)), longs(bytes(block.labels)), longs(bytes(block.vectors), -1, dims), count, same):
        if len(s) == count:
            wanted.known[k, w], wanted.score[k, w], wanted.id[k, w] = 1, s[-1], i[-1]
    return wanted


def chunked(parts: Iterator[Wanted]) -> Iterator[pd.DataFrame]:
    held: list[Wanted] = []
    for part in parts:
        held.append(part)
        if sum(len(p.ids) for p in held) >= CHUNK:
            yield chunk(held)
            held = []
    if held:
        yield chunk(held)


def chunk(held: list[Wanted]) -> pd.DataFrame:
    whole = Wanted.joined(held)
    return pd.DataFrame([whole.taken(np.arange(len(whole.ids)))], columns=list(Wanted.NAMES))


def searched(chunks: DataFrame, blocks: DataFrame, n_blocks: int, dims: int, count: int, same: bool) -> DataFrame:
    """(anchor, slot, score, id) of rows among which each window's ``count`` best are."""
    slices = max(1, -(-n_blocks // SLICE))

    def sliced(part: pd.DataFrame) -> pd.DataFrame:
        kinds = [longs(bytes(x)) for x in part["kinds"]]
        return pd.DataFrame([(int(part["slice"].iloc[0]), packed(part["no"]), b"".join(map(bytes, part["lo"])), b"".join(map(bytes, part["hi"])),
                              packed(part["min_id"]), packed(np.concatenate(kinds)), packed(np.repeat(np.arange(len(kinds)), list(map(len, kinds)))))],
                            columns=["slice", "nos", "z_lo", "z_hi", "min_ids", "kinds", "kind_of"])

    def chosen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                wanted, nos = Wanted.of(r, dims), longs(bytes(r.nos))
                least, most = bounds(wanted.vectors, longs(bytes(r.z_lo), -1, dims), longs(bytes(r.z_hi), -1, dims))
                kinds, kind_of, min_ids = longs(bytes(r.kinds)), longs(bytes(r.kind_of)), longs(bytes(r.min_ids))
                fits = np.zeros((len(wanted.ids), len(nos)), dtype=bool)
                for label in np.unique(wanted.labels):
                    fits[np.ix_(wanted.labels == label, np.unique(kind_of[(kinds == label) == same]))] = True
                meets = np.zeros_like(fits)
                for w in range(wanted.lo.shape[1]):
                    lo, hi, known, score, least_id = (x[:, w:w + 1] for x in (wanted.lo, wanted.hi, wanted.known, wanted.score, wanted.id))
                    meets |= ((least <= hi) & (most >= lo) & (lo <= hi)
                              & ((known == 0) | (most > score) | ((most >= score) & (min_ids[None, :] <= least_id))))
                fits &= meets
                out = [(int(nos[z]), *wanted.taken(np.flatnonzero(fits[:, z]))) for z in np.flatnonzero(fits.any(axis=0))]
                for lo in range(0, len(out), 64):
                    yield pd.DataFrame(out[lo:lo + 64], columns=["no", *(f"w_{c}" for c in Wanted.NAMES)])

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for r in frame.itertuples(index=False):
                wanted = Wanted.of(r, dims, "w_")
                found = best(wanted, longs(bytes(r.ids)), longs(bytes(r.labels)), longs(bytes(r.vectors), -1, dims), count, same)
                rows = [(int(wanted.ids[k]), w, int(x), int(y)) for k, w, s, i in found for x, y in zip(s, i)]
                yield pd.DataFrame(rows, columns=["anchor", "slot", "score", "id"])

    zones = blocks.select(F.pmod(F.xxhash64("no"), F.lit(slices)).alias("slice"), "no", "lo", "hi", "min_id", "kinds")
    maps = zones.groupBy("slice").applyInPandas(sliced, "slice long, nos binary, z_lo binary, z_hi binary, min_ids binary, kinds binary, kind_of binary")
    meet = chunks.withColumn("slice", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long")))).join(maps, "slice")
    choice = meet.mapInPandas(chosen, "no long, " + ", ".join(f"w_{c} binary" for c in Wanted.NAMES))
    return choice.join(blocks.select("no", "ids", "labels", "vectors"), "no").mapInPandas(read, "anchor long, slot int, score long, id long")


def leading(found: DataFrame, count: int) -> DataFrame:
    """The ``count`` best of each window, ranked."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def first_wanted(ids, labels, vectors, limits=None) -> Wanted:
    shape = (len(ids), 1) if limits is None else limits[0].shape
    lo, hi = (np.full(shape, -LONG - 1), np.full(shape, LONG)) if limits is None else limits
    return Wanted(ids, labels, vectors, lo, hi, *[np.zeros(shape, dtype=np.int64) for _ in range(3)])


def anchor_ids(ids: str, anchors: str) -> Column:
    @F.pandas_udf("array<long>")
    def of(ids: pd.Series, anchors: pd.Series) -> pd.Series:
        return pd.Series([longs(bytes(i))[longs(bytes(a)) != 0].tolist() for i, a in zip(ids, anchors)])

    return of(ids, anchors)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3,
         window: Callable[[int], tuple[int, int]] = lambda p: (-(-50 * p // 100), 95 * p // 100)) -> DataFrame:
    """``rows``: id, label, vector (array of longs). One row per anchor, positive and negative.

    ``window`` gives the scores, both ends included, that a positive's score allows its negatives.
    """
    own = (rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("vector").cast("array<long>").alias("vector"))
           .where("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)"))
    single = own.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("m")).select("id", "m.label", "m.vector")
    flagged = single.withColumn("anchor", F.coalesce(is_anchor, F.lit(False)))
    dims, count = own.agg(F.max(F.size("vector")), F.count(F.lit(1))).first()
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if dims is None:
        return rows.sparkSession.createDataFrame([], empty)
    dims = max(1, dims)
    share = max(1, count // SAMPLE)
    sample = own.where(F.pmod(F.xxhash64("id"), F.lit(share)) == 0).select("vector").limit(3 * SAMPLE).collect()
    sample = sample or own.select("vector").limit(SAMPLE).collect()
    blocks = materialise(blocks_of(flagged, Curve.fitted(matrix([r.vector for r in sample], dims).astype(float)), dims))
    n_blocks = blocks.count()

    def own_block(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def parts():
            for frame in frames:
                for b in frame.itertuples(index=False):
                    which = np.flatnonzero(longs(bytes(b.anchors)))
                    if len(which):
                        found = first_wanted(longs(bytes(b.ids))[which], longs(bytes(b.labels))[which], longs(bytes(b.vectors), -1, dims)[which])
                        yield marked(found, b, dims, positives, True)
        yield from chunked(parts())

    chunks = blocks.select("ids", "labels", "vectors", "anchors").mapInPandas(own_block, Wanted.SCHEMA)
    best_rows = materialise(leading(searched(chunks, blocks, n_blocks, dims, positives, True), positives))
    spans = best_rows.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("p"))  # positives at most
    spans = spans.select(F.col("anchor").alias("id"), F.col("p.score").alias("scores"))

    def windows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def parts():
            for frame in frames:
                for b in frame.itertuples(index=False):
                    ids, scores = longs(bytes(b.ids)), dict(zip(map(int, b.wanted), b.scores))
                    which = np.array([k for k, i in enumerate(ids.tolist()) if i in scores], dtype=np.int64)
                    lo, hi = np.ones((len(which), positives), dtype=np.int64), np.zeros((len(which), positives), dtype=np.int64)
                    for row, k in enumerate(which):
                        for w, p in enumerate(scores[int(ids[k])]):
                            lo[row, w], hi[row, w] = np.clip(window(int(p)), -LONG - 1, LONG) if abs(int(p)) > LONG // 100 else window(int(p))
                    found = first_wanted(ids[which], longs(bytes(b.labels))[which], longs(bytes(b.vectors), -1, dims)[which], (lo, hi))
                    yield marked(found, b, dims, negatives, False)
        yield from chunked(parts())

    homes = blocks.select("no", F.explode(anchor_ids("ids", "anchors")).alias("id")).join(spans, "id")
    # as many anchors as a block has at most
    asked = homes.groupBy("no").agg(F.collect_list(F.struct("id", "scores")).alias("q")).select("no", F.col("q.id").alias("wanted"), F.col("q.scores").alias("scores"))
    chunks = blocks.select("no", "ids", "labels", "vectors").join(asked, "no").mapInPandas(windows, Wanted.SCHEMA)
    found = leading(searched(chunks, blocks, n_blocks, dims, negatives, False), negatives)
    pos = best_rows.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(pos, ["anchor", "slot"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
