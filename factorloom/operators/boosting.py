"""Boosted trees for many models at once, from histograms that Spark adds up.

Walk-forward splits, folds, candidates and horizons train on overlapping rows of one panel. The panel is binned and written
once, in blocks; a model is a rule over a row's date, label exit and kind (which rows train it, with what weight), so no
row is copied per model. A task reads blocks in place from Arrow batches, whose bytes Spark bounds, one after another. Each level of each tree is one pass: tasks add up gradients by (model, node, feature, bin), the
sums meet by (model, node), where the best split is found, and only splits reach the driver. All models advance in the same
pass, so its cost is that of one scan and not of one job chain per model. Margins are written every ``KEEP`` rounds; passes
between add the trees grown since.

Gradients are rounded to 2**-26 before they are added, so sums do not depend on the order of tasks. Equal gains go to the
first feature and the lowest cut. Cuts are quantiles of rows that every model may train on, so no model sees later values.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from factorloom.functions.columns import finite
from factorloom.session import discard, materialise

KEEP = 8  # rounds between two writings of the margins
UNIT = float(1 << 26)
NEVER = 1 << 30  # the exit day of a label that is never realised
HALF_LIFE = 365.25  # days; 252 sessions a year, and a half-life of 252 sessions
# A reader holds a row group's blocks at once.
WRITTEN = {"parquet.block.row.count.limit": 16, "compression": "lz4_raw"}
SENT = 64 << 20  # bytes of trees that one scoring pass sends to the tasks
BLOCKS = "kind binary, day binary, exit binary, label binary, weight binary, uid binary, bins binary, of binary, margin binary"


@dataclass(frozen=True)
class Params:
    depth: int = 3
    rate: float = 0.1
    min_child_weight: float = 1.0
    gamma: float = 0.0
    alpha: float = 0.0
    lam: float = 1.0
    subsample: float = 1.0
    colsample: float = 1.0
    bins: int = 256


# The searched ranges (low, high, log scale), depths and bin counts.
SEARCHED = {"rate": (0.01, 0.05, True), "min_child_weight": (10, 150, True), "gamma": (1e-4, 1, True), "subsample": (0.6, 0.95, False),
            "colsample": (0.5, 0.95, False), "alpha": (1e-4, 20, True), "lam": (1, 100, True)}
SEARCHED_DEPTH, SEARCHED_BINS = (2, 5), (128, 256, 512)
SEED = 42


def drawn(count: int, first: Params, seed: int = SEED) -> list[Params]:
    """``first`` and seeded draws over all nine parameters."""
    draw = random.Random(seed)
    out = [first]
    for _ in range(count - 1):
        values = {k: lo * (hi / lo) ** draw.random() if log else draw.uniform(lo, hi) for k, (lo, hi, log) in SEARCHED.items()}
        out.append(Params(depth=draw.randint(*SEARCHED_DEPTH), bins=draw.choice(SEARCHED_BINS), **values))
    return out


@dataclass(frozen=True)
class Model:
    """A model and its rows: dated from ``start`` to before ``until``, label realised before ``realised``, of one ``kind``.

    Days are numbers since 1970-01-01. ``reference`` makes a row's weight halve with every year of age; ``hold`` is the
    span (first day, day after the last, day by which labels are realised) whose loss is measured after every round.
    """
    name: str
    start: int
    until: int
    realised: int
    kind: int = 0
    reference: int | None = None
    hold: tuple[int, int, int] | None = None
    params: Params = field(default_factory=Params)
    squared: bool = False
    seed: int = SEED


@dataclass
class Tree:
    """Nodes in heap order; a leaf has feature -1."""
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    @staticmethod
    def empty(depth: int) -> Tree:
        n = (2 << depth) - 1
        return Tree(np.full(n, -1, dtype=np.int32), np.zeros(n, dtype=np.int32), np.zeros(n), np.zeros(n))

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The node each row ends in; ``bins`` is features x rows."""
        return next(Route([self]).places(bins))[0]


class Route:
    """Trees' ways from bins to nodes. Whether a bin passes the splits of the trees' first levels on its feature is a table of
    bits by bin, so a row's outcome is one look-up per feature for all trees together; a table gives each tree's node for
    its bits. Further levels are looked up row by row."""
    TOP, BITS = 3, 63

    def __init__(self, trees: Sequence[Tree]):
        self.groups: list[tuple[dict, list[tuple]]] = []
        used = 0
        for tree in trees:
            levels = int(math.log2(len(tree.feature) + 1)) - 1
            node, splits = np.arange(len(tree.feature), dtype=np.intp), tree.feature >= 0
            left = np.where(splits, 2 * node + 1, node)
            top = [j for j in range((1 << min(levels, self.TOP)) - 1) if splits[j]]
            if not self.groups or used + len(top) > self.BITS:
                self.groups.append(({}, []))
                used = 0
            bits, ways = self.groups[-1]
            for i, j in enumerate(top):
                bits.setdefault(int(tree.feature[j]), []).append((int(tree.cut[j]), 1 << (used + i)))
            outcome = np.arange(1 << len(top))
            after = np.zeros(len(outcome), dtype=np.intp)
            for _ in range(min(levels, self.TOP)):
                went = np.zeros(len(outcome), dtype=np.intp)
                for i, j in enumerate(top):
                    went[after == j] = (outcome >> i & 1)[after == j]
                after = left[after] + went
            cut = np.where(splits, tree.cut, np.iinfo(np.int32).max)  # no bin lies beyond a leaf's
            ways.append((used, len(outcome) - 1, after, levels, np.maximum(tree.feature, 0).astype(np.intp), cut, left, tree.value))
            used += len(top)
        for bits, _ in self.groups:
            for f, tests in bits.items():
                table = np.zeros(max(cut for cut, _ in tests) + 2, dtype=np.int64)
                for cut, bit in tests:
                    table[cut + 1:] |= bit
                bits[f] = table

    def _outcomes(self, bins: np.ndarray) -> Iterator[tuple[np.ndarray | int, tuple]]:
        for bits, ways in self.groups:
            passed = None
            for f, table in bits.items():
                found = table.take(bins[f], mode="clip")  # higher bins pass all that the last one does
                passed = found if passed is None else np.bitwise_or(passed, found, out=passed)
            for way in ways:
                yield (0 if passed is None else passed >> way[0] & way[1]), way

    def places(self, bins: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per tree the node each row ends in, and the nodes' values; ``bins`` is features x rows."""
        n = bins.shape[1]
        for outcome, (_, _, after, levels, feature, cut, left, value) in self._outcomes(bins):
            node = np.full(n, after[0]) if isinstance(outcome, int) else after.take(outcome)
            for _ in range(levels - self.TOP):
                node = left.take(node) + (bins[feature.take(node), np.arange(n)] > cut.take(node))
            yield node, value

    def add(self, out: np.ndarray, bins: np.ndarray) -> None:
        """Add every tree's values to ``out``, in their order."""
        n = bins.shape[1]
        for outcome, (_, _, after, levels, feature, cut, left, value) in self._outcomes(bins):
            if levels <= self.TOP:
                out += value[after[0]] if isinstance(outcome, int) else value.take(after).take(outcome)
                continue
            node = np.full(n, after[0]) if isinstance(outcome, int) else after.take(outcome)
            for _ in range(levels - self.TOP):
                node = left.take(node) + (bins[feature.take(node), np.arange(n)] > cut.take(node))
            out += value.take(node)


@dataclass
class Forest:
    """A fitted model: its base and trees, with cuts as values."""
    name: str
    base: float
    trees: list[Tree]
    cuts: list[np.ndarray]
    losses: list[float]
    stopped: bool = False

    def raw(self, x: np.ndarray) -> np.ndarray:
        bins = binned(x, self.cuts)
        out = np.full(len(x), self.base)
        Route(self.trees).add(out, bins)
        return out

    def best_rounds(self) -> int:
        """Trees at the least held-out loss, one at least; ``losses`` starts with none."""
        return max(1, int(np.argmin(self.losses[1:])) + 1) if len(self.losses) > 1 else len(self.trees)

    def importance(self, count: int) -> np.ndarray:
        """Mean gain of a feature's splits, as shares."""
        total, times = np.zeros(count), np.zeros(count)
        for tree in self.trees:
            used = tree.feature >= 0
            np.add.at(total, tree.feature[used], tree.gain[used])
            np.add.at(times, tree.feature[used], 1)
        mean = total / np.maximum(times, 1)
        return mean / mean.sum() if mean.sum() > 0 else mean


def binned(x: np.ndarray, cuts: Sequence[np.ndarray]) -> np.ndarray:
    """The number of cuts below each value, features x rows; missing and infinite values count as 0."""
    clean = np.where(np.isfinite(x), x, 0.0)
    return np.array([np.searchsorted(c, clean[:, k], side="left") for k, c in enumerate(cuts)], dtype=np.uint16).reshape(len(cuts), len(x))


def chance(uid: np.ndarray, salt: int) -> np.ndarray:
    """A number from 0 to 1 per row and salt."""
    x = uid.view(np.uint64) ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))).astype(np.float64) / 2.0 ** 64


def slopes(model: Model, f: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the squared or pseudo-Huber loss."""
    z = f - y
    if model.squared:
        return z, np.ones_like(z)
    s = 1 + z * z
    root = np.sqrt(s)
    return z / root, 1 / (s * root)


def loss(model: Model, f: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (f - y) ** 2 if model.squared else np.sqrt(1 + (f - y) ** 2) - 1


class Block:
    """The arrays of one written block, read in place from a row of an Arrow batch; bins are features x rows, margins
    models x rows, of the models ``of`` that use rows of the block (none before margins are first written: they are 0)."""

    def __init__(self, batch: pa.RecordBatch, row: int, features: int):
        read = lambda name, kind: np.frombuffer(batch.column(name)[row].as_buffer(), dtype=kind)
        self.kind, self.day, self.exit = (read(c, np.int32) for c in ("kind", "day", "exit"))
        self.label, self.weight = read("label", np.float64), read("weight", np.float64)
        self.uid = read("uid", np.int64)
        self.bins = read("bins", np.uint16).reshape(features, -1).astype(np.intp)  # as indices, once for all models
        self.kinds, self.dates, self.ends = ((x.min(initial=NEVER), x.max(initial=-NEVER)) for x in (self.kind, self.day, self.exit))
        self.of = {k: i for i, k in enumerate(read("of", np.int32).tolist())}
        self.margin = read("margin", np.float64).reshape(len(self.of), len(self.day))

    def _rows(self, m: Model, lo: int, hi: int, realised: int) -> slice | np.ndarray:
        """Rows of the model's kind dated from ``lo`` to before ``hi`` and realised in time: a slice where they lie together."""
        if not len(self.day) or self.ends[0] >= realised or self.dates[1] < lo or self.dates[0] >= hi:
            return slice(0, 0)
        if self.kinds == (m.kind, m.kind) and self.ends[1] < realised and self.dates[0] >= lo and self.dates[1] < hi:
            return slice(0, len(self.day))
        at = np.flatnonzero((self.kind == m.kind) & (self.day >= lo) & (self.day < hi) & (self.exit < realised))
        return slice(at[0], at[-1] + 1) if len(at) and at[-1] - at[0] + 1 == len(at) else at if len(at) else slice(0, 0)

    def training(self, m: Model) -> tuple[slice | np.ndarray, np.ndarray]:
        """Rows that train ``m`` and their weights."""
        at = self._rows(m, m.start, m.until, m.realised)
        return at, self.weight[at] if m.reference is None else self.weight[at] * np.exp2(-((m.reference - self.day[at]) / HALF_LIFE))

    def held(self, m: Model) -> slice | np.ndarray:
        return self._rows(m, *m.hold)

    def uses(self, m: Model) -> bool:
        return bool(len(self.day[self._rows(m, m.start, m.until, m.realised)]) or m.hold and len(self.day[self.held(m)]))

    def scores(self, k: int, at: slice | np.ndarray, bins: np.ndarray, trees: Route) -> np.ndarray:
        """Margins of the rows ``at``, whose bins are ``bins``."""
        out = self.margin[self.of[k]][at].copy() if self.of else np.zeros(bins.shape[1])
        trees.add(out, bins)
        return out


def soft(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0.0)


def best_split(p: Params, g: np.ndarray, h: np.ndarray, cuts: Sequence[int], most: int, allowed: np.ndarray):
    """(gain, feature, cut, left g, left h) of a node's histograms (features x bins); gain 0 if none helps.

    ``cuts``: cut points per feature; ``most``: those of the finest binning, of which a coarser one uses every n-th.
    """
    left_g, left_h = g.cumsum(axis=1)[:, :-1], h.cumsum(axis=1)[:, :-1]
    all_g, all_h = g[0].sum(), h[0].sum()
    right_g, right_h = all_g - left_g, all_h - left_h
    score = lambda a, b: soft(a, p.alpha) ** 2 / (b + p.lam)
    gain = 0.5 * (score(left_g, left_h) + score(right_g, right_h) - score(all_g, all_h)) - p.gamma
    step = max(1, most // p.bins)
    place = np.arange(gain.shape[1])
    usable = (place[None, :] < np.asarray(cuts)[:, None]) & (place % step == step - 1)[None, :] & allowed[:, None]
    usable &= (left_h >= p.min_child_weight) & (right_h >= p.min_child_weight)
    gain = np.where(usable, gain, -np.inf)
    if not gain.size or gain.max() <= 0:
        return 0.0, -1, 0, 0.0, 0.0
    f, c = divmod(int(gain.argmax()), gain.shape[1])
    return float(gain[f, c]), f, c, float(left_g[f, c]), float(left_h[f, c])


class Booster:
    """Models that grow together; ``advance`` may be called again, with fewer of them."""

    def __init__(self, rows: DataFrame, features: Sequence[str], models: Sequence[Model], label: str = "label",
                 keys: Sequence[str] = ("d", "symbol"), kind: str | None = None, weight: str | None = None):
        """``rows``: d, label_exit_date, label and features; ``kind`` (int) and ``weight`` may name columns."""
        self.models, self.features, self.rounds, self.kept = list(models), list(features), 0, 0
        self.most = max(m.params.bins for m in self.models)
        day = lambda c: F.datediff(F.col(c), F.lit("1970-01-01").cast("date"))
        own = rows.where(finite(F.col(label).cast("double")).isNotNull()).select(
            (F.col(kind) if kind else F.lit(0)).cast("int").alias("kind"), day("d").alias("day"),
            F.coalesce(day("label_exit_date"), F.lit(NEVER)).alias("exit"), F.col(label).cast("double").alias("label"),
            (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("weight"), F.xxhash64(*keys).alias("uid"),
            *[F.coalesce(finite(F.col(f).cast("double")), F.lit(0.0)).alias(f"x{k}") for k, f in enumerate(self.features)])
        self.cuts = self._cuts(own)
        self.blocks = materialise(self._blocks(own), **WRITTEN)
        sums = self._passed(self._means)
        base = [sums.get((k, 0), (0.0, 0.0))[:2] for k in range(len(self.models))]
        self.forests = [Forest(m.name, y / w if w else 0.0, [], self.cuts, []) for m, (y, w) in zip(self.models, base)]

    def _cuts(self, own: DataFrame) -> list[np.ndarray]:
        known = own.where(F.col("exit") < min(m.realised for m in self.models))
        levels = [i / self.most for i in range(1, self.most)]
        asked = [F.percentile_approx(f"x{k}", levels, 10_000).alias(f"x{k}") for k in range(len(self.features))]
        found = known.agg(F.count(F.lit(1)).alias("n"), *asked).first()
        if not found["n"]:
            found = own.agg(F.count(F.lit(1)).alias("n"), *asked).first()
        return [np.unique(np.array(found[f"x{k}"] or [0.0], dtype=float)) for k in range(len(self.features))]

    def _blocks(self, own: DataFrame) -> DataFrame:
        cuts = self.cuts

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if not len(frame):
                    continue
                bins = binned(frame[[f"x{k}" for k in range(len(cuts))]].to_numpy(dtype=float), cuts)
                raw = lambda c, kind: frame[c].to_numpy(dtype=kind).tobytes()
                yield pd.DataFrame([(raw("kind", np.int32), raw("day", np.int32), raw("exit", np.int32), raw("label", np.float64),
                                     raw("weight", np.float64), raw("uid", np.int64), bins.tobytes(),
                                     b"", b"")], columns=[c.split()[0] for c in BLOCKS.split(", ")])

        # in order of the exit, most blocks have rows of few models, or all their rows in a model
        return own.sortWithinPartitions("kind", "exit").mapInPandas(run, BLOCKS)

    def _means(self):
        models, features = self.models, len(self.features)

        def add(block: Block, put) -> None:
            for k, m in enumerate(models):
                at, w = block.training(m)
                if len(w):
                    put(k, 0, np.rint(np.array([(w * block.label[at]).sum(), w.sum()]) * UNIT))

        return add, lambda k, node, sums: (sums[0] / UNIT, sums[1] / UNIT, 0.0, -1, 0, 0.0, 0.0)

    def _passed(self, work) -> dict[tuple[int, int], tuple]:
        """One pass: ``add`` puts arrays by (model, node) for each block, they are added up, ``end`` makes one row of each sum."""
        add, end = work()
        features = len(self.features)

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], np.ndarray] = {}

            def put(k: int, node: int, x: np.ndarray) -> None:
                if (k, node) in held:
                    held[k, node] += x
                else:
                    held[k, node] = x.copy()

            for batch in batches:
                for row in range(batch.num_rows):
                    add(Block(batch, row, features), put)
            keys = list(held)
            for lo in range(0, len(keys), 64):
                part = keys[lo:lo + 64]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in part], pa.int32()), pa.array([node for _, node in part], pa.int32()),
                                                  pa.array([held[key].tobytes() for key in part], pa.binary())], ["model", "node", "sums"])

        def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[tuple[int, int], np.ndarray] = {}
            for frame in frames:
                for k, node, sums in zip(frame["model"], frame["node"], frame["sums"]):
                    x = np.frombuffer(bytes(sums))
                    held[k, node] = held[k, node] + x if (k, node) in held else x
            yield pd.DataFrame([(k, node, *end(k, node, x)) for (k, node), x in held.items()],
                               columns=["model", "node", "g", "h", "gain", "feature", "cut", "left_g", "left_h"])

        met = self.blocks.mapInArrow(gather, "model int, node int, sums binary").repartition("model", "node").mapInPandas(
            meet, "model int, node int, g double, h double, gain double, feature int, cut int, left_g double, left_h double")
        return {(r[0], r[1]): tuple(r[2:]) for r in met.collect()}  # a row per model and open node

    def _since(self) -> list[Route]:
        return [Route(f.trees[self.kept:]) for f in self.forests]

    def _level(self, level: int, growing: dict[int, Tree], measured: Sequence[int]):
        models, base, since, features, cuts = self.models, [f.base for f in self.forests], self._since(), len(self.features), self.cuts
        width, most, turn = max(map(len, cuts)) + 1, self.most, self.rounds
        first = (1 << level) - 1
        routes = {k: Route([tree]) for k, tree in growing.items()}

        def add(block: Block, put) -> None:
            for k, route in routes.items():
                m = models[k]
                at, w = block.training(m)
                if len(w) and m.params.subsample < 1:
                    taken = chance(block.uid[at], m.seed + 1_000_003 * turn) < m.params.subsample
                    at, w = np.arange(len(block.day))[at][taken], w[taken]
                if not len(w):
                    continue
                bins, node = block.bins[:, at], None
                if level:
                    node = next(route.places(bins))[0] - first
                    here = node >= 0  # rows in leaves above stay out
                    if not here.all():
                        at, w, node, bins = np.arange(len(block.day))[at][here], w[here], node[here], bins[:, here]
                    if not len(w):
                        continue
                slope = [np.rint(x * w * UNIT) for x in slopes(m, base[k] + block.scores(k, at, bins, since[k]), block.label[at])]
                sums, begin = np.empty((1 << level, 2, features, width)), None if node is None else node * width
                for f in range(features):
                    cell = bins[f] if begin is None else begin + bins[f]
                    for i, x in enumerate(slope):
                        sums[:, i, f] = np.bincount(cell, x, width << level).reshape(-1, width)
                for n in (0,) if node is None else np.flatnonzero(np.bincount(node)).tolist():
                    put(k, n, sums[n].ravel())
            for k in measured:
                at = block.held(models[k])
                y = block.label[at]
                if len(y):
                    f = base[k] + block.scores(k, at, block.bins[:, at], since[k])
                    put(k, -1, np.array([np.rint(loss(models[k], f, y) * UNIT).sum(), float(len(y)) * UNIT]))

        def end(k: int, node: int, sums: np.ndarray) -> tuple:
            if node < 0:
                return sums[0] / UNIT, sums[1] / UNIT, 0.0, -1, 0, 0.0, 0.0
            g, h = sums.reshape(2, features, width) / UNIT
            m = models[k]
            allowed = np.ones(features, dtype=bool)
            if m.params.colsample < 1:
                keys = [random.Random(f"{m.seed} {turn} {f}").random() for f in range(features)]
                allowed[:] = False
                allowed[np.argsort(keys)[:max(1, int(m.params.colsample * features))]] = True
            gain, f, c, left_g, left_h = best_split(m.params, g, h, list(map(len, cuts)), most, allowed)
            return float(g[0].sum()), float(h[0].sum()), gain, f, c, left_g, left_h

        return add, end

    def advance(self, rounds: int, names: Sequence[str] | None = None, patience: int | None = None) -> list[Forest]:
        """Grow ``rounds`` more trees of the models named (all if none are). With ``patience``, a model with a held span
        stops once its loss has not improved for so many rounds."""
        mine = [k for k, m in enumerate(self.models) if names is None or m.name in set(names)]
        for _ in range(rounds):
            live = [k for k in mine if not self.forests[k].stopped]
            if not live:
                break
            growing = {k: Tree.empty(self.models[k].params.depth) for k in live}
            whole, measured = dict(growing), [k for k in live if self.models[k].hold]
            for level in range(max(t.params.depth for t in (self.models[k] for k in live))):
                found = self._passed(lambda: self._level(level, growing, measured if level == 0 else ()))
                first = (1 << level) - 1
                for (k, node), (g, h, gain, f, c, left_g, left_h) in found.items():
                    if node < 0:
                        self._note(k, g / h, patience)
                        continue
                    p, tree, at = self.models[k].params, growing[k], first + node
                    leaf = lambda a, b: -p.rate * float(soft(np.array(a), p.alpha)) / (b + p.lam)
                    tree.value[at] = leaf(g, h)
                    if f >= 0:
                        tree.feature[at], tree.cut[at], tree.gain[at] = f, c, gain
                        tree.value[2 * at + 1], tree.value[2 * at + 2] = leaf(left_g, left_h), leaf(g - left_g, h - left_h)
                growing = {k: t for k, t in growing.items() if level + 1 < self.models[k].params.depth and (t.feature[first:] >= 0).any()}
                if not growing:
                    break
            for k in range(len(self.models)):
                grown = k in whole and not self.forests[k].stopped
                self.forests[k].trees.append(whole[k] if grown else Tree.empty(0))
            self.rounds += 1
            if self.rounds - self.kept >= KEEP:
                self._keep()
        return self.forests

    def _note(self, k: int, value: float, patience: int | None) -> None:
        forest = self.forests[k]
        forest.losses.append(value)
        if patience and len(forest.losses) - 1 - int(np.argmin(forest.losses)) >= patience:
            forest.stopped = True

    def _keep(self) -> None:
        """Write the margins with the trees grown since they were written."""
        since, features, models = self._since(), len(self.features), self.models

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                *kept, of, margin = batch.schema
                for row in range(batch.num_rows):
                    block = Block(batch, row, features)
                    every, used = slice(None), [k for k, m in enumerate(models) if block.uses(m)]
                    scores = np.array([block.scores(k, every, block.bins, since[k]) for k in used])
                    yield pa.RecordBatch.from_arrays([*batch.slice(row, 1).columns[:len(kept)], pa.array([np.array(used, np.int32).tobytes()], of.type),
                                                      pa.array([scores.tobytes()], margin.type)], batch.schema.names)

        fresh = materialise(self.blocks.mapInArrow(run, BLOCKS), **WRITTEN)
        discard(self.blocks)
        self.blocks, self.kept = fresh, self.rounds

    def close(self) -> list[Forest]:
        discard(self.blocks)
        return self.forests


def truncated(forest: Forest, trees: int) -> Forest:
    return replace(forest, trees=forest.trees[:trees])


def predict(rows: DataFrame, forests: Sequence[Forest], features: Sequence[str], by: str = "name", output: str = "prediction") -> DataFrame:
    """``rows`` with the prediction of the forest that column ``by`` names; rows of no forest are left out.

    Forests go to the tasks in passes of a bounded size, each over its own rows.
    """
    passes: list[list[Forest]] = []
    held = SENT
    for f in forests:
        size = sum(t.feature.nbytes * 6 for t in f.trees) + 8 * sum(map(len, f.cuts))
        if held + size > SENT:
            passes.append([])
            held = 0
        passes[-1].append(f)
        held += size

    def scored(part: list[Forest]) -> DataFrame:
        table = {f.name: f for f in part}

        @F.pandas_udf("double")
        def score(name: pd.Series, *columns: pd.Series) -> pd.Series:
            x = np.column_stack([c.to_numpy(dtype=float, na_value=np.nan) for c in columns])
            out = np.full(len(x), np.nan)
            for key, at in name.groupby(name).indices.items():
                out[at] = table[key].raw(x[at])
            return pd.Series(out)

        return rows.where(F.col(by).isin(list(table))).withColumn(output, score(by, *[F.col(f).cast("double") for f in features]))

    out = scored(passes[0])
    for part in passes[1:]:
        out = out.unionByName(scored(part))
    return out


def importance_rows(spark, forests: Sequence[Forest], features: Sequence[str]) -> DataFrame:
    rows = [(f.name, x, float(v)) for f in forests for x, v in zip(features, f.importance(len(features)))]
    return spark.createDataFrame(rows, "name string, feature string, importance double")
