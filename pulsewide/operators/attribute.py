"""Additive attribution of a boosted-tree classifier in log-odds.

Exact path-dependent Shapley values (Lundberg et al., 2018). Players are the
original columns: a number and its mark of absence count as one. For a leaf the
contributions depend only on which of its columns send the row towards it. Rows are
taken in blocks; a block goes through the trees one by one, and for each leaf the
patterns that occur in the block are computed once. The ensemble has a fixed size
(rounds x leaves) and is handed to the tasks; rows never meet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsewide.operators.matrix import FEATURES
from pulsewide.operators.model import BINARY, Classifier
from pulsewide.operators.ordering import percentile_map
from pulsewide.operators.split import sample_at_most
from pulsewide.session import scratch_path

SHAP = "shap"
#: Numbers of model input that a block of rows has at most (one row at least).
BLOCK_NUMBERS = 4_000_000
#: Rows of a block that go through a tree at once, and columns of a leaf up to which all
#: patterns are worked out and not only those that occur (their bits fit a byte).
SLICE_ROWS, TABLE_COLUMNS = 16_384, 8


@dataclass(frozen=True)
class Split:
    slot: int
    threshold: float
    left_levels: tuple[float, ...] | None


@dataclass(frozen=True)
class Leaf:
    """A leaf with, for each column on its path, the tests to pass and the cover share."""

    value: float
    players: tuple[int, ...]
    cover: tuple[float, ...]
    tests: tuple[tuple[tuple[int, bool], ...], ...]   # per player: (split number, goes left)


@dataclass(frozen=True)
class Tree:
    splits: tuple[Split, ...]
    leaves: tuple[Leaf, ...]


@dataclass(frozen=True)
class Explainer:
    columns: tuple[str, ...]
    trees: tuple[Tree, ...]

    @property
    def base_value(self) -> float:
        """Expected log-odds: every leaf weighted by its share of the training weight."""
        return sum(l.value * math.prod(l.cover) for t in self.trees for l in t.leaves)


def make_explainer(spark: SparkSession, classifier: Classifier) -> Explainer:
    """Explainer of a binary classifier; the node rows come from its saved form."""
    if classifier.mode != BINARY:
        raise ValueError("attribution needs the binary model")
    by_tree = _nodes(spark, classifier)
    slots = classifier.matrix.layout.slots
    weights = classifier.model.treeWeights
    trees = tuple(_tree(by_tree[t], slots, 2.0 * weights[t]) for t in sorted(by_tree))
    return Explainer(tuple(classifier.matrix.layout.columns), trees)


def _nodes(spark: SparkSession, classifier: Classifier) -> dict[int, dict[int, object]]:
    """The node rows of every tree, from the model's saved form."""
    path = scratch_path(spark)
    classifier.model.write().save(path)
    by_tree: dict[int, dict[int, object]] = {}
    for r in spark.read.parquet(path + "/data").select("treeID", "nodeData.*").collect():
        by_tree.setdefault(r["treeID"], {})[r["id"]] = r
    return by_tree


def _tree(nodes: dict[int, object], slots: Sequence[int], scale: float) -> Tree:
    """Paths of one tree; MLlib's log-odds are twice the weighted sum of tree outputs."""
    splits: list[Split] = []
    leaves: list[Leaf] = []

    def walk(node, path):
        if node["leftChild"] < 0:
            leaves.append(_leaf(node["prediction"] * scale, path))
            return
        s = node["split"]
        given = list(s["leftCategoriesOrThreshold"])
        categorical = s["numCategories"] >= 0
        number = len(splits)
        splits.append(Split(
            s["featureIndex"],
            math.nan if categorical else given[0],
            tuple(given) if categorical else None,
        ))
        weight = node["impurityStats"][0]
        for child, left in ((nodes[node["leftChild"]], True), (nodes[node["rightChild"]], False)):
            share = child["impurityStats"][0] / weight
            walk(child, [*path, (slots[s["featureIndex"]], number, left, share)])

    walk(nodes[0], [])
    return Tree(tuple(splits), tuple(leaves))


def _leaf(value: float, path: Sequence[tuple]) -> Leaf:
    players = sorted({step[0] for step in path})
    mine = {p: [s for s in path if s[0] == p] for p in players}
    return Leaf(
        value,
        tuple(players),
        tuple(math.prod(s[3] for s in mine[p]) for p in players),
        tuple(tuple((s[1], s[2]) for s in mine[p]) for p in players),
    )


def _coalition_weights(d: int) -> np.ndarray:
    """Shapley weight of a coalition of size k among d players: k! (d-k-1)! / d!"""
    return np.array([1.0 / (d * math.comb(d - 1, k)) for k in range(d)])


def contributions(passed: np.ndarray, cover: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Contribution of each column of a path for many leaves and patterns at once.

    ``passed`` is (patterns x columns) of 0 and 1, ``cover`` (leaves x columns),
    ``value`` (leaves); the result is (leaves x columns x patterns). Knowing a
    column multiplies the leaf's weight by ``passed``, not knowing it by
    ``cover``. The coefficient of y^k in the product of (cover + passed y) over
    the other columns is the total over coalitions of size k.
    """
    patterns, d = passed.shape
    leaves = len(value)
    weights = _coalition_weights(d)
    result = np.empty((leaves, d, patterns))
    for i in range(d):
        poly = np.zeros((d, leaves, patterns))
        poly[0] = 1.0
        for size, j in enumerate(j for j in range(d) if j != i):
            shifted = poly[: size + 1] * passed[:, j]
            poly[: size + 1] *= cover[:, j, None]
            poly[1 : size + 2] += shifted
        total = np.tensordot(weights, poly, axes=1)
        result[:, i] = value[:, None] * (passed[:, i] - cover[:, i, None]) * total
    return result


def _codes_found(code: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pattern codes of a block, and each row's place among them."""
    if 1 << d > len(code):
        return np.unique(code, return_inverse=True)
    here = np.bincount(code, minlength=1 << d) > 0
    return np.flatnonzero(here), (np.cumsum(here) - 1)[code]


def _tables(leaves: Sequence[Leaf]) -> dict[int, np.ndarray]:
    """For each leaf of few columns, by its place, the contributions (columns x patterns) of every pattern."""
    found: dict[int, np.ndarray] = {}
    for d in sorted({len(leaf.players) for leaf in leaves} & set(range(1, TABLE_COLUMNS + 1))):
        mine = [i for i, leaf in enumerate(leaves) if len(leaf.players) == d]
        bits = ((np.arange(1 << d)[:, None] >> np.arange(d)) & 1).astype(float)
        tables = contributions(bits, np.array([leaves[i].cover for i in mine]), np.array([leaves[i].value for i in mine]))
        found.update(zip(mine, tables))
    return found


def _passed(tests: tuple, goes: dict, known: dict) -> np.ndarray:
    """The rows that pass the tests of one column; leaves share the first of them."""
    if tests not in known:
        n, side = tests[-1]
        last = goes[side][n]
        known[tests] = last if len(tests) == 1 else _passed(tests[:-1], goes, known) & last
    return known[tests]


def attribute_block(x: np.ndarray, explainer: Explainer) -> np.ndarray:
    """Contributions (columns x rows) of a block of model inputs (rows x slots).

    The patterns of a leaf are worked out once for the block; its rows are looked up in
    slices that stay in the processor's cache.
    """
    rows = x.shape[0]
    inputs = np.ascontiguousarray(x.T)
    total = np.zeros((len(explainer.columns), rows))
    for tree in explainer.trees:
        tables = _tables(tree.leaves)
        for at in range(0, rows, SLICE_ROWS):
            _add_tree(inputs[:, at : at + SLICE_ROWS], tree, tables, total[:, at : at + SLICE_ROWS])
    return total


def _add_tree(inputs: np.ndarray, tree: Tree, tables: dict[int, np.ndarray], total: np.ndarray) -> None:
    """Add a tree's contributions to the rows of a slice."""
    left = [
        inputs[s.slot] <= s.threshold if s.left_levels is None
        else np.isin(inputs[s.slot], s.left_levels)
        for s in tree.splits
    ]
    goes, known = {True: left, False: [~m for m in left]}, {}
    for i, leaf in enumerate(tree.leaves):
        if not leaf.players:
            continue
        wide = i not in tables
        code = np.zeros(inputs.shape[1], dtype=np.int64 if wide else np.uint8)
        for p, tests in enumerate(leaf.tests):
            code |= _passed(tests, goes, known).astype(code.dtype) << code.dtype.type(p)
        if wide:
            found, place = _codes_found(code, len(leaf.players))
            bits = ((found[:, None] >> np.arange(len(leaf.players))) & 1).astype(float)
            table = contributions(bits, np.array([leaf.cover]), np.array([leaf.value]))[0]
        else:
            table, place = tables[i], code.astype(np.intp)
        for p, player in enumerate(leaf.players):
            total[player] += table[p].take(place)


def attribute(
    df: DataFrame, classifier: Classifier, explainer: Explainer, keep: Sequence[str], name: str = SHAP
) -> DataFrame:
    """Columns ``keep`` plus the array of contributions, in ``explainer.columns`` order."""
    ready = classifier.matrix.transform(df).select(*keep, vector_to_array(FEATURES).alias("__x"))
    schema = ready.drop("__x").schema.add(name, T.ArrayType(T.DoubleType()))

    def finish(block: list[pa.RecordBatch]) -> pa.RecordBatch:
        whole = pa.Table.from_batches(block).combine_chunks().to_batches()[0]
        x = whole.column(whole.num_columns - 1).flatten().to_numpy().reshape(whole.num_rows, -1)
        phi = attribute_block(x, explainer).T
        offsets = np.arange(0, phi.size + 1, phi.shape[1], dtype=np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(phi.ravel()))
        kept = [whole.column(i) for i in range(whole.num_columns - 1)]
        return pa.RecordBatch.from_arrays([*kept, lists], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the explainer travels with the function; Spark broadcasts a large one
        block, rows = [], 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            block.append(batch)
            rows += batch.num_rows
            width = len(batch.column(batch.num_columns - 1).flatten()) // batch.num_rows
            if rows * width >= BLOCK_NUMBERS:
                yield finish(block)
                block, rows = [], 0
        if block:
            yield finish(block)

    return ready.mapInArrow(run, schema)


#: Columns whose coalitions are enumerated at most, and rows for which that is done at once.
MAX_ENUMERATED, ENUMERATED_ROWS = 12, 2048


def tree_worths(node: tuple, x: np.ndarray, slots: Sequence[int]) -> tuple[int, dict]:
    """A tree's expected value for every coalition of the columns it tests: ``(their bits, {bits known: value})``.

    ``node`` is a leaf's value, or (slot, threshold, left levels, left weight share, left,
    right). A part of the tree depends only on the columns that it tests itself, so it is
    walked once for each coalition of those and not of all columns.
    """
    if len(node) == 1:
        return 0, {0: node[0]}
    slot, threshold, levels, share, left, right = node
    (left_mask, one), (right_mask, other) = tree_worths(left, x, slots), tree_worths(right, x, slots)
    own = 1 << slots[slot]
    mask = left_mask | right_mask | own
    goes_left = x[slot] <= threshold if levels is None else np.isin(x[slot], levels)
    found, s = {}, mask
    while True:
        a, b = one[s & left_mask], other[s & right_mask]
        found[s] = np.where(goes_left, a, b) if s & own else share * a + (1 - share) * b
        if s == 0:
            return mask, found
        s = (s - 1) & mask  # the next smaller subset


def attribute_by_enumeration(
    df: DataFrame, classifier: Classifier, keep: Sequence[str], name: str = SHAP
) -> DataFrame:
    """The same contributions by the definition, for few columns.

    Every coalition of columns has a worth: the log-odds expected of a row of which these
    columns alone are known, walking each tree and weighing both sides of a split on an
    unknown column by their training weights. A contribution is the Shapley average of what
    its column adds to the worth of all coalitions of the others. The cost doubles with
    every column; it is there to check :func:`attribute`, with which it shares no formula.
    """
    d = len(classifier.matrix.layout.columns)
    if d > MAX_ENUMERATED:
        raise ValueError(f"{d} columns have too many coalitions; at most {MAX_ENUMERATED}")
    weights, slots = classifier.model.treeWeights, classifier.matrix.layout.slots
    by_tree = _nodes(df.sparkSession, classifier)

    def plain(nodes: dict[int, object], at: int) -> tuple:
        """A leaf's value, or (slot, threshold, left levels, left weight share, left, right)."""
        n = nodes[at]
        if n["leftChild"] < 0:
            return (n["prediction"],)
        given, share = list(n["split"]["leftCategoriesOrThreshold"]), nodes[n["leftChild"]]["impurityStats"][0] / n["impurityStats"][0]
        test = (None, given) if n["split"]["numCategories"] >= 0 else (given[0], None)
        return (n["split"]["featureIndex"], *test, share, plain(nodes, n["leftChild"]), plain(nodes, n["rightChild"]))

    trees = [(2.0 * weights[t], plain(by_tree[t], 0)) for t in sorted(by_tree)]
    ready = classifier.matrix.transform(df).select(*keep, vector_to_array(FEATURES).alias("__x"))
    schema = ready.drop("__x").schema.add(name, T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ENUMERATED_ROWS):
                b = whole.slice(at, ENUMERATED_ROWS)
                x = b.column(len(keep)).flatten().to_numpy().reshape(b.num_rows, -1).T
                worth = [0.0] * (1 << d)
                for w, tree in trees:
                    mask, known = tree_worths(tree, x, slots)
                    worth = [total + w * known[s & mask] for s, total in enumerate(worth)]
                worth = [total + np.zeros(b.num_rows) for total in worth]
                phi = np.zeros((b.num_rows, d))
                for s in range(1 << d):
                    k = s.bit_count()
                    for i in range(d):
                        if not s >> i & 1:
                            phi[:, i] += (worth[s | 1 << i] - worth[s]) * math.factorial(k) * math.factorial(d - k - 1) / math.factorial(d)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, phi.size + 1, d, dtype=np.int32)), pa.array(phi.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], lists], names=schema.names)

    return ready.mapInArrow(run, schema)


def long_attributions(attributed: DataFrame, explainer: Explainer, keep: Sequence[str], name: str = SHAP) -> DataFrame:
    """One row per row and column: ``(keep..., feature, shap)``."""
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(name)[i].alias(name))
        for i, c in enumerate(explainer.columns)
    ])
    return attributed.select(*keep, F.inline(cells))


def importance(attributed: DataFrame, explainer: Explainer, name: str = SHAP) -> DataFrame:
    """Mean absolute contribution per column, from one aggregation without stacking rows."""
    one = attributed.agg(*[
        F.avg(F.abs(F.col(name)[i])).alias(f"f{i}") for i in range(len(explainer.columns))
    ])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(f"f{i}").alias("mean_abs_shap"))
        for i, c in enumerate(explainer.columns)
    ])))


def top_importance(attributed: DataFrame, explainer: Explainer, k: int = 15) -> DataFrame:
    return importance(attributed, explainer).orderBy(F.desc("mean_abs_shap"), "feature").limit(k)


def directional(
    attributed: DataFrame, explainer: Explainer, features: Sequence[str], buckets: int = 10, name: str = SHAP
) -> DataFrame:
    """Contribution against value: per column and value range, the count and spread.

    ``attributed`` must carry the columns, and is read more than once, so pass
    a materialised table. Ranges are quantiles of the column; rows without a
    value form a range of their own (NULL).
    """
    at = {c: i for i, c in enumerate(explainer.columns)}
    grid = [k / buckets for k in range(1, buckets)]
    edges = percentile_map(attributed, features, grid)
    cells = []
    for c in features:
        value = F.col(c).cast("double")
        place = sum(((value > F.lit(e)).cast("int") for e in sorted(set(edges[c])) if e is not None), F.lit(0))
        cells.append(F.struct(
            F.lit(c).alias("feature"),
            F.when(value.isNotNull(), place).alias("value_range"),
            value.alias("value"),
            F.col(name)[at[c]].alias(name),
        ))
    return (
        attributed.select(F.inline(F.array(*cells)))
        .groupBy("feature", "value_range")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("value").alias("value_min"),
            F.max("value").alias("value_max"),
            F.avg(name).alias("mean_shap"),
            F.min(name).alias("min_shap"),
            F.max(name).alias("max_shap"),
            F.stddev_pop(name).alias("std_shap"),
        )
    )


def points(
    attributed: DataFrame, explainer: Explainer, key: Sequence[str], features: Sequence[str], n: int, seed: int = 42
) -> DataFrame:
    """Value and contribution of a seeded sample of rows, for a scatter per column."""
    at = {c: i for i, c in enumerate(explainer.columns)}
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value"), F.col(SHAP)[at[c]].alias(SHAP))
        for c in features
    ])
    return sample_at_most(attributed, key, n, seed).select(*key, F.inline(cells))


def waterfall(
    attributed: DataFrame, explainer: Explainer, key: str, value, name: str = SHAP
) -> DataFrame:
    """One row's contributions by size, with the running log-odds from the base value."""
    row = attributed.where(F.col(key) == F.lit(value)).select(key, name).first()
    if row is None:
        raise IndexError(f"no row with {key} = {value!r}")
    ranked = sorted(zip(explainer.columns, row[name]), key=lambda p: (-abs(p[1]), p[0]))
    rows, level = [], explainer.base_value
    for rank, (feature, phi) in enumerate(ranked, start=1):
        rows.append((row[key], rank, feature, float(phi), level, level + phi))
        level += phi
    steps = T._parse_datatype_string("rank int, feature string, shap double, from_logodds double, to_logodds double")
    schema = T.StructType([T.StructField(key, attributed.schema[key].dataType), *steps.fields])
    return attributed.sparkSession.createDataFrame(rows, schema)
