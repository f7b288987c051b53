"""Boosting of two classes over rows that are cut into bins once.

The method and its choices are MLlib's ``GBTClassifier``: its cut points, which MLlib is
asked for, its columns drawn for each node, its least rows, gains, leaves and step sizes,
so the trees are the same but for the rounding of sums: it decides between splits of equal
gain, and with weights MLlib takes it for a variance of pure nodes. What differs is what a
pass costs. A row is a few small codes
(columns with few bins share one) beside its margin; a level counts the smaller child of
each split and subtracts it from the parent for the larger one. What comes back from a task
is one table of sums for each counted node, added up in the order of the tasks.

``boost`` keeps the rows where they are: every level is a job over them. ``boost_here`` grows
the same trees inside one task from rows that it is given, for tables that fit in one.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsewide.session import scratch_path

#: Codes of columns that share one: few enough for the sums of a level to stay in a core's cache.
_SHARED_CODES = 256
#: Rounds after which the rows' margins are written, as MLlib does, so that lineage stays short.
_WRITE_EVERY = 10
#: Files of the training table that one task takes, where there are more of them than cores.
_FILES_PER_TASK = 4
#: Below this a variance is none: the machine epsilon, as in MLlib, and the rounding of sums beside the mean square.
_EPS, _ROUNDING = 2.220446049250313e-16, 1e-12
#: Rows of the second class count as so much more in a sum that holds both counts.
_SECOND = float(2**26)


# --- bins -------------------------------------------------------------------------


@dataclass(frozen=True)
class Binning:
    """Cut points of numbers, sizes of all slots, and how slots share codes."""

    cuts: tuple[np.ndarray | None, ...]  # None for categories, whose values are their bins
    sizes: tuple[int, ...]
    group: tuple[int, ...]
    stride: tuple[int, ...]
    codes: tuple[int, ...]  # of each group

    @property
    def most(self) -> int:
        return max(self.sizes)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes, one line for each group, of rows by slots."""
        out = np.zeros((len(self.codes), len(x)), np.int64)
        for s, cuts in enumerate(self.cuts):
            at = x[:, s].astype(np.int64) if cuts is None else np.searchsorted(cuts, x[:, s], side="left")
            out[self.group[s]] += at * self.stride[s]
        return out.astype(np.uint8 if max(self.codes) <= 256 else np.uint16 if max(self.codes) <= 65536 else np.int32)

    def by_slot(self, sums: np.ndarray, g: int, out: np.ndarray) -> None:
        """Split a group's sums (node, code) into those of its slots (node, slot, bin)."""
        for s, size in enumerate(self.sizes):
            if self.group[s] == g:
                out[:, s, :size] = sums.reshape(len(sums), -1, size, self.stride[s]).sum(axis=(1, 3))


def binning(cuts: Sequence[np.ndarray | None], sizes: Sequence[int]) -> Binning:
    """Let slots share codes, the smallest first."""
    group, stride, codes = [0] * len(sizes), [1] * len(sizes), []
    for s in sorted(range(len(sizes)), key=lambda s: sizes[s]):
        if codes and codes[-1] * sizes[s] <= _SHARED_CODES:
            stride[s] = codes[-1]
            codes[-1] *= sizes[s]
        else:
            codes.append(sizes[s])
        group[s] = len(codes) - 1
    return Binning(tuple(cuts), tuple(sizes), tuple(group), tuple(stride), tuple(codes))


def find_binning(df: DataFrame, estimator: GBTClassifier) -> Binning:
    """MLlib's own cut points for the training rows ``df``; its checks of labels and inputs hold."""
    jvm = df.sparkSession._jvm
    static = lambda name: jvm.java.lang.Class.forName(f"org.apache.spark.{name}$").getField("MODULE$").get(None)
    estimator._transfer_params_to_java()
    java = estimator._java_obj
    rows = static("ml.util.DatasetUtils").extractInstances(java, df._jdf, jvm.scala.Option.apply(2))
    column = df._jdf.schema().apply(estimator.getFeaturesCol())
    algo = jvm.org.apache.spark.mllib.tree.configuration.Algo
    strategy = java.getOldBoostingStrategy(jvm.org.apache.spark.ml.util.MetadataUtils.getCategoricalFeatures(column), algo.Classification())
    tree = strategy.treeStrategy().copy()
    tree.setAlgo(algo.Regression())
    tree.setImpurity(static("mllib.tree.impurity.Variance"))
    metadata = jvm.org.apache.spark.ml.tree.impl.DecisionTreeMetadata.buildMetadata(rows, tree, 1, estimator.getFeatureSubsetStrategy())
    found = static("ml.tree.impl.RandomForest").findSplits(rows, metadata, estimator.getSeed())
    cuts = [
        None if metadata.isCategorical(s) else np.array([split.threshold() for split in found[s]], float)
        for s in range(metadata.numFeatures())
    ]
    sizes = [metadata.numBins()[s] if c is None else len(c) + 1 for s, c in enumerate(cuts)]
    return binning(cuts, sizes)


def packed(df: DataFrame, found: Binning, label: str, features: str, mark: str | None = None) -> RDD:
    """Rows as ``(codes, labels, marks)``, one element for each task; a label that is no class is -1."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = df.rdd.getNumPartitions()
    wanted = cores * math.ceil(parts / (_FILES_PER_TASK * cores))  # every core gets as many
    known = F.when(F.col(label).isin(*range(128)), F.col(label)).otherwise(-1).cast("tinyint")
    marked = F.col(mark) if mark else F.lit(False)
    rows = df.select(vector_to_array(features).alias("x"), known.alias("y"), marked.cast("tinyint").alias("m"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, labels, marks = [], [], []
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(found.sizes))
            codes.append(found.encode(x))
            labels.append(b.column(1).to_numpy())
            marks.append(b.column(2).to_numpy())
        if codes:
            one = [np.concatenate(codes, axis=1), np.concatenate(labels), np.concatenate(marks)]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array([a.tobytes()], pa.binary()) for a in one], pa.array([one[0].dtype.str])], names=["c", "y", "m", "t"])

    def unpack(r):
        y = np.frombuffer(r["y"], np.int8)
        return np.frombuffer(r["c"], r["t"]).reshape(-1, len(y)), y, np.frombuffer(r["m"], np.int8)

    dealt = rows.coalesce(wanted) if parts > wanted else rows
    return dealt.mapInArrow(pack, "c binary, y binary, m binary, t string").rdd.map(unpack)


# --- the columns drawn for each node, as Spark draws them ---------------------------

_32, _64 = (1 << 32) - 1, (1 << 64) - 1


class _Longs:
    """``java.util.Random``, of which only ``nextLong`` is needed."""

    def __init__(self, seed: int):
        self.state = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1)

    def _next(self) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        bits = self.state >> 16
        return bits - (1 << 32) if bits >> 31 else bits

    def next(self) -> int:
        return ((self._next() << 32) + self._next()) & _64


def _murmur(words: Sequence[np.ndarray], seed: np.ndarray | int) -> np.ndarray:
    """Murmur3 of eight bytes, given as two words of 32 bits."""
    m = np.uint64(_32)
    rotl = lambda v, r: ((v << np.uint64(r)) | (v >> np.uint64(32 - r))) & m
    h = np.zeros_like(words[0]) + np.uint64(seed) if isinstance(seed, int) else seed
    for k in words:
        k = rotl((k * np.uint64(0xCC9E2D51)) & m, 15)
        h = rotl(h ^ ((k * np.uint64(0x1B873593)) & m), 13)
        h = (h * np.uint64(5) + np.uint64(0xE6546B64)) & m
    h = h ^ np.uint64(8)
    h = ((h ^ (h >> np.uint64(16))) * np.uint64(0x85EBCA6B)) & m
    h = ((h ^ (h >> np.uint64(13))) * np.uint64(0xC2B2AE35)) & m
    return h ^ (h >> np.uint64(16))


def draw_slots(seeds: Sequence[int], n: int, k: int) -> np.ndarray:
    """For each seed ``k`` of ``n`` slots by Spark's reservoir over its XORShift generator."""
    seed = np.array(seeds, np.uint64)
    swapped = seed.byteswap()  # the bytes are hashed from the highest on, in little-endian words
    words = [swapped & np.uint64(_32), swapped >> np.uint64(32)]
    low = _murmur(words, 0x3C074A61)
    state = (_murmur(words, low) << np.uint64(32)) | low

    def bits(state, number):
        state = state ^ (state << np.uint64(21))
        state = state ^ (state >> np.uint64(35))
        state = state ^ (state << np.uint64(4))
        return state, state & np.uint64((1 << number) - 1)

    drawn = np.tile(np.arange(k), (len(seed), 1))
    for item in range(k, n):
        state, high = bits(state, 26)
        state, rest = bits(state, 27)
        at = (((high << np.uint64(27)) + rest).astype(float) * 2.0**-53 * (item + 1)).astype(np.int64)
        there = np.flatnonzero(at < k)
        drawn[there, at[there]] = item
    return drawn


# --- one tree -----------------------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    depth: int
    least: int  # rows of a child at least
    per_node: int  # slots drawn for a node
    rate: float
    rounds: int
    seed: int
    weights: tuple[float, float] | None = None  # of the two classes


def settings_of(estimator: GBTClassifier, found: Binning, weights: tuple[float, float] | None = None) -> Settings:
    """The estimator's settings; the share of columns is a fraction, as ``model.build`` gives it."""
    drawn = math.ceil(float(estimator.getFeatureSubsetStrategy()) * len(found.sizes))
    return Settings(
        estimator.getMaxDepth(), estimator.getMinInstancesPerNode(), drawn, estimator.getStepSize(), estimator.getMaxIter(),
        estimator.getSeed(), weights)


class Growth:
    """A tree as it grows: the sums of a level's nodes go in, the tests that move rows on come out.

    Nodes are numbered by level. A test is a table over the codes of one group, so rows are
    moved by look-ups. ``wanted`` are the nodes of the level that rows are counted in.
    """

    def __init__(self, found: Binning, settings: Settings, number: int):
        self.found, self.settings = found, settings
        self.number, self.random = number, _Longs(settings.seed + number)
        self.levels: list[tuple] = []  # what moves rows: see move()
        self.splits: list[dict] = []  # what the model says of them
        self.predictions = np.zeros(1)
        self.stats = np.full((1, 4), np.nan)  # rows, weight, sum, sum of squares of each node
        self.first, self.n = 0, 1  # the level's nodes
        self.order = np.zeros(1, np.int64)  # its nodes in the order in which MLlib takes them
        self.wanted = np.zeros(1, np.int64)  # place of each node among the counted, or -1
        self.parents = None
        self.done = False

    def add(self, squares: np.ndarray, counts: np.ndarray, weights: np.ndarray, sums: np.ndarray) -> None:
        """Decide the level from the counted nodes' sums (node, slot, bin) and all nodes' squares."""
        found, least = self.found, self.settings.least
        if self.parents is None:
            tables = [counts, weights, sums]
            self.stats[0, :3] = [t[0, 0].sum() for t in tables]
            self.predictions[0] = self.stats[0, 2] / self.stats[0, 1]
        else:
            held, pairs, side = self.parents
            tables = []
            for parent, counted in zip(held, (counts, weights, sums)):
                both = np.zeros((self.n // 2, 2, *parent.shape[1:]))
                both[pairs, side], both[pairs, 1 - side] = counted, parent - counted
                tables.append(both.reshape(self.n, *parent.shape[1:]))
            empty = tables[0] == 0
            tables[1][empty] = tables[2][empty] = 0.0  # not the rounding of a difference
        here = slice(self.first, self.first + self.n)
        self.stats[here, 3] = squares
        rows, weight, total, _ = self.stats[here].T
        impurity = (squares - total * total / weight) / weight
        mixed = np.abs(impurity) >= _EPS + _ROUNDING * squares / weight
        order = self.order[mixed[self.order]]
        chosen, slot, k, gain, lefts, sorts = self._best(tables, order, least)
        n = len(chosen)
        # the tests, as tables over the codes of the slot's group
        group, table = np.full(self.n, -1), np.zeros((self.n, max(found.codes)), bool)
        left = np.full(self.n, -1)
        left[chosen] = self.first + self.n + 2 * np.arange(n)
        cats = []
        for i, node in enumerate(chosen):
            s = slot[i]
            size, group[node] = found.sizes[s], found.group[s]
            if found.cuts[s] is None:
                cats.append(sorts[s][node, : k[i] + 1])
                to_left = np.isin(np.arange(size), cats[-1])
            else:
                cats.append(None)
                to_left = np.arange(size) <= k[i]
            codes = found.codes[found.group[s]]
            table[node, :codes] = to_left[np.arange(codes) // found.stride[s] % size]
        self.levels.append((self.first, group, table, left))
        self.splits.append({"node": chosen + self.first, "slot": slot, "k": k, "cats": cats, "gain": gain, "impurity": impurity})
        # their children
        whole = np.column_stack([rows, weight, total])[chosen]
        children = np.stack([lefts, whole - lefts], axis=1).reshape(2 * n, 3)
        self.stats = np.vstack([self.stats, np.column_stack([children, np.full(2 * n, np.nan)])])
        self.predictions = np.concatenate([self.predictions, children[:, 2] / children[:, 1]])
        at = np.full(self.n, -1)
        at[chosen] = np.arange(n)
        taken = [c for node in order if at[node] >= 0 for c in (2 * at[node], 2 * at[node] + 1)]
        self.order = np.array(taken[::-1], np.int64)
        # the smaller child is counted, if one of the two has rows enough for a split
        sizes = children[:, 0].reshape(n, 2)
        pairs = np.flatnonzero(sizes.max(axis=1, initial=0) >= 2 * least)
        side = (sizes[pairs, 1] < sizes[pairs, 0]).astype(int)
        self.wanted = np.full(2 * n, -1)
        self.wanted[2 * pairs + side] = np.arange(len(pairs))
        self.parents = [t[chosen[pairs]] for t in tables], pairs, side
        self.first, self.n = self.first + self.n, 2 * n
        self.done = not len(pairs) or len(self.levels) == self.settings.depth

    def _best(self, tables, order, least):
        """The nodes that are split, their slots, cuts and gains, the sums of their left children,
        and the order of categories by node."""
        found, n_slots = self.found, len(self.found.sizes)
        if self.settings.per_node < n_slots:
            drawn = draw_slots([self.random.next() for _ in order], n_slots, self.settings.per_node)
        else:
            drawn = np.tile(np.arange(n_slots), (len(order), 1))
        sorts = {}
        if any(c is None for c in found.cuts):
            tables = [t.copy() for t in tables]
        for s, size in enumerate(found.sizes):
            if found.cuts[s] is None:
                # categories go by their mean, absent ones last
                _, w, t = (x[:, s, :size] for x in tables)
                mean = np.full(w.shape, np.inf)
                np.divide(t, w, out=mean, where=w > 0)
                sorts[s] = np.argsort(mean, axis=1, kind="stable")
                for x in tables:
                    x[:, s, :size] = np.take_along_axis(x[:, s, :size], sorts[s], axis=1)
        c, w, t = (np.cumsum(x, axis=2) for x in tables)
        whole = [x[:, :, -1:] for x in (c, w, t)]
        c, w, t = c[:, :, :-1], w[:, :, :-1], t[:, :, :-1]
        valid = (c >= least) & (whole[0] - c >= least)
        gain = np.full(c.shape, -np.inf)
        at = np.nonzero(valid)
        one, total, sum_one, sum_all = w[at], whole[1][at[0], at[1], 0], t[at], whole[2][at[0], at[1], 0]
        other, sum_other = total - one, sum_all - sum_one
        if self.number:
            gain[at] = (sum_one * sum_one / one + sum_other * sum_other / other - sum_all * sum_all / total) / total
        else:
            # of 1 and -1 the squares are the weights: as MLlib rounds, which decides between mirrored splits
            variance = lambda weight, s: (weight - s * s / weight) / weight
            gain[at] = (
                variance(total, sum_all) - one / total * variance(one, sum_one) - other / total * variance(other, sum_other))
        if not gain.shape[2] or not len(order):
            none = np.zeros(0, np.int64)
            return none, none, none, np.zeros(0), np.zeros((0, 3)), sorts
        k = gain.argmax(axis=2)
        best = np.take_along_axis(gain, k[:, :, None], axis=2)[:, :, 0]
        mine = np.take_along_axis(best[order], drawn, axis=1)
        first = mine.argmax(axis=1)  # the first drawn of equals
        splits = np.flatnonzero(mine[np.arange(len(order)), first] > 0)
        splits = splits[np.argsort(order[splits])]
        chosen, slot = order[splits], drawn[splits, first[splits]]
        cut = k[chosen, slot]
        lefts = np.column_stack([x[chosen, slot, cut] for x in (c, w, t)])
        return chosen, slot, cut, best[chosen, slot], lefts, sorts


def move(place: np.ndarray, codes: np.ndarray, level: tuple) -> np.ndarray:
    """Rows of a level's split nodes go on to the children; all others stay where they are."""
    first, group, table, left = level
    if len(group) == 1:
        return np.where(table[0][codes[group[0]]], left[0], left[0] + 1) if left[0] >= 0 else place
    at = np.flatnonzero(place >= first)
    node = place[at] - first
    split = left[node] >= 0
    if not split.all():
        at, node = at[split], node[split]
    went = table[node, codes[group[node], at]]
    place = place.copy()
    place[at] = left[node] + 1 - went
    return place


def level_sums(found: Binning, codes, labels, target, weights, place, first: int, wanted: np.ndarray) -> tuple:
    """Squares of all nodes of a level, and counts, weights and sums of the wanted ones."""
    n, most = int(wanted.max()) + 1, found.most
    weight = None if weights is None else np.where(labels > 0, weights[1], weights[0])
    value = target if weight is None else weight * target
    rows = None
    if len(wanted) == 1:
        squares, node = np.array([value @ target]), np.zeros(len(labels), np.int64)
    else:
        inside = np.flatnonzero(place >= first)
        at = place[inside] - first
        squares = np.bincount(at, value[inside] * target[inside], len(wanted))
        node = wanted[at]
        kept = node >= 0
        rows, node = inside[kept], node[kept]
        value = value[rows]
    both = None if weights is None else 1.0 + _SECOND * (labels if rows is None else labels[rows])
    counts, sums, seconds = (np.zeros((n, len(found.sizes), most)) for _ in range(3))
    for g, size in enumerate(found.codes):
        key = node * size + (codes[g] if rows is None else codes[g][rows])
        shape = (n, size)
        found.by_slot(np.bincount(key, value, n * size).reshape(shape), g, sums)
        number = np.bincount(key, both, n * size).astype(float, copy=False).reshape(shape)
        if both is not None:
            second = np.floor(number / _SECOND)
            number -= second * _SECOND
            found.by_slot(second, g, seconds)
        found.by_slot(number, g, counts)
    if weights is None:
        return squares, counts, counts, sums
    return squares, counts, weights[0] * (counts - seconds) + weights[1] * seconds, sums


def target_of(labels: np.ndarray, margin: np.ndarray | None) -> np.ndarray:
    """What a tree is fitted to: the classes as -1 and 1, later the gradient of the logistic loss."""
    sign = 2.0 * labels - 1.0
    return sign if margin is None else 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin))


def loss_sum(labels: np.ndarray, margin: np.ndarray, floor: float) -> tuple[float, int]:
    """Sum of the log-loss and its rows; other labels than 0 and 1 have none."""
    known = (labels == 0) | (labels == 1)
    p0 = 1.0 / (1.0 + np.exp(2.0 * margin[known]))
    p = np.where(labels[known] == 0, p0, 1.0 - p0)
    return float(-np.log(np.clip(p, floor, 1.0 - floor)).sum()), int(known.sum())


# --- boosting -----------------------------------------------------------------------


def boost_here(found: Binning, settings: Settings, rows: Sequence[tuple], floor: float) -> tuple[float, int]:
    """Boost on blocks of (codes, labels, marks) inside this process: loss sum and number of
    the marked rows, which grow no tree."""
    blocks, late = ([(c[:, (m > 0) == side], y[(m > 0) == side]) for c, y, m in rows] for side in (False, True))
    margins, held = None, [np.zeros(len(y)) for _, y in late]
    for number in range(settings.rounds):
        tree = Growth(found, settings, number)
        targets = [target_of(y, None if margins is None else margins[i]) for i, (_, y) in enumerate(blocks)]
        places = [np.zeros(len(y), np.int64) for _, y in blocks]
        while not tree.done:
            parts = [
                level_sums(found, c, y, t, settings.weights, p, tree.first, tree.wanted)
                for (c, y), t, p in zip(blocks, targets, places)
            ]
            tree.add(*[sum(x[1:], x[0]) for x in zip(*parts)])
            places = [move(p, c, tree.levels[-1]) for (c, _), p in zip(blocks, places)]
        scale = settings.rate if number else 1.0
        step = scale * tree.predictions
        if margins is None:
            margins = [np.zeros(len(y)) for _, y in blocks]
        margins = [m + step[p] for m, p in zip(margins, places)]
        for i, (c, y) in enumerate(late):
            place = np.zeros(len(y), np.int64)
            for level in tree.levels:
                place = move(place, c, level)
            held[i] += step[place]
    found_losses = [loss_sum(y, m, floor) for (_, y), m in zip(late, held)]
    return sum(x for x, _ in found_losses), sum(n for _, n in found_losses)


def boost(found: Binning, settings: Settings, rows: RDD, floor: float | None = None) -> tuple[list[Growth], tuple[float, int] | None]:
    """Boost on an RDD of (codes, labels, marks): the trees, and with ``floor`` loss sum and
    number of the marked rows, which grow no tree.
    """
    weights = settings.weights

    def start(r):
        return (*r, np.zeros(len(r[1])))

    def counter(levels, first, wanted, is_first):
        def count(r):
            codes, labels, marks, margin = r
            if marks.any():
                early = marks == 0
                codes, labels, margin = codes[:, early], labels[early], margin[early]
            place = np.zeros(len(labels), np.int64)
            for level in levels:
                place = move(place, codes, level)
            return level_sums(found, codes, labels, target_of(labels, None if is_first else margin), weights, place, first, wanted)
        return count

    def mover(levels, step):
        def add(r):
            codes, labels, marks, margin = r
            place = np.zeros(len(labels), np.int64)
            for level in levels:
                place = move(place, codes, level)
            return codes, labels, marks, margin + step[place]
        return add

    def late_loss(r):
        _, labels, marks, margin = r
        return loss_sum(labels[marks > 0], margin[marks > 0], floor)

    state, before = rows.map(start).persist(StorageLevel.MEMORY_AND_DISK), None
    trees, written = [], None
    for number in range(settings.rounds):
        if number and number % _WRITE_EVERY == 0:
            state.checkpoint()
        tree = Growth(found, settings, number)
        while not tree.done:
            parts = state.map(counter(tree.levels, tree.first, tree.wanted, number == 0)).collect()
            tree.add(*[sum(x[1:], x[0]) for x in zip(*parts)])
            if before is not None:
                before.unpersist()
                before = None
        if number and number % _WRITE_EVERY == 0:
            _delete(state, written)
            written = state.getCheckpointFile()
        trees.append(tree)
        step = (settings.rate if number else 1.0) * tree.predictions
        before, state = state, state.map(mover(tree.levels, step)).persist(StorageLevel.MEMORY_AND_DISK)
    losses = None if floor is None else [sum(x) for x in zip(*state.map(late_loss).collect())]
    for rdd in (before, state):
        if rdd is not None:
            rdd.unpersist()
    _delete(state, written)
    return trees, losses and tuple(losses)


def _delete(rdd: RDD, path: str | None) -> None:
    if path:
        folder = rdd.ctx._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(rdd.ctx._jsc.hadoopConfiguration()).delete(folder, True)


# --- MLlib's form of the model --------------------------------------------------------

_NODE = (
    "treeID int, nodeData struct<id int, prediction double, impurity double, impurityStats array<double>, rawCount bigint, "
    "gain double, leftChild int, rightChild int, split struct<featureIndex int, leftCategoriesOrThreshold array<double>, numCategories int>>"
)


def _node_rows(tree_id: int, tree: Growth) -> list[tuple]:
    """A tree as MLlib saves it: nodes from the root on, the left side first. A split whose
    leaves say the same is a leaf. The squares of leaves of the last level are not known."""
    found, tests, impurity = tree.found, {}, {}
    for level, (first, _, _, left) in zip(tree.splits, tree.levels):
        impurity |= dict(enumerate(level["impurity"].tolist(), first))
        for i, node in enumerate(level["node"].tolist()):
            s, cats = int(level["slot"][i]), level["cats"][i]
            given = [float(found.cuts[s][level["k"][i]])] if cats is None else [float(c) for c in cats]
            tests[node] = int(left[node - first]), float(level["gain"][i]), (s, given, -1 if cats is None else found.sizes[s])
    out: list[list] = []

    def walk(node: int) -> int:
        number = len(out)
        rows, *stats = tree.stats[node].tolist()
        row = [number, float(tree.predictions[node]), impurity.get(node, -1.0), stats, int(rows), -1.0, -1, -1, (-1, [], -1)]
        out.append(row)
        if node in tests:
            left, gain, split = tests[node]
            one, other = walk(left), walk(left + 1)
            if out[one][6] < 0 and out[other][6] < 0 and out[one][1] == out[other][1]:
                row[1] = out[one][1]
                del out[number + 1 :]
            else:
                row[5:] = gain, one, other, split
        return number

    walk(0)
    return [(tree_id, tuple(row)) for row in out]


def to_model(spark: SparkSession, estimator: GBTClassifier, trees: Sequence[Growth]) -> GBTClassificationModel:
    """The trees as MLlib's model, by way of its saved form."""
    path = scratch_path(spark)
    given = {p.name: v for p, v in estimator._paramMap.items()}
    default = {p.name: v for p, v in estimator._defaultParamMap.items()}

    def described(kind: str, uid: str, names: set[str] | None, **more) -> str:
        some = lambda params: {k: v for k, v in params.items() if names is None or k in names}
        return json.dumps({
            "class": f"org.apache.spark.ml.{kind}", "timestamp": 0, "sparkVersion": spark.version, "uid": uid,
            "paramMap": some(given), "defaultParamMap": some(default), **more})

    of_tree = {"cacheNodeIds", "checkpointInterval", "featuresCol", "impurity", "labelCol", "leafCol", "maxBins", "maxDepth",
               "maxMemoryInMB", "minInfoGain", "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "seed"}
    head = described(
        "classification.GBTClassificationModel", estimator.uid, None, numFeatures=len(trees[0].found.sizes), numTrees=len(trees))
    each = [
        (i, described("regression.DecisionTreeRegressionModel", f"{estimator.uid}_{i}", of_tree), estimator.getStepSize() if i else 1.0)
        for i in range(len(trees))
    ]
    nodes = [r for i, tree in enumerate(trees) for r in _node_rows(i, tree)]
    spark.createDataFrame([(head,)], "value string").coalesce(1).write.text(path + "/metadata")
    spark.createDataFrame(each, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(path + "/treesMetadata")
    spark.createDataFrame(nodes, _NODE).coalesce(1).write.parquet(path + "/data")
    return GBTClassificationModel.load(path)
