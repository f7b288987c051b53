"""Pairwise-complete correlation matrices and the collinearity filter.

Both matrices need, for each pair of columns, sums over the rows where both
hold a value. A pair-per-expression aggregation grows with the square of the
column count, so each task turns its Arrow batches into small column-by-column
matrix products and emits one row per pair; only those partial sums are
shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsewide import schema as S

from pulsewide.operators.ordering import name_at, running_totals
from pulsewide.operators.profile import null_counts, zero_variance
from pulsewide.session import materialise

_MOMENTS = ("n", "da", "db", "daa", "dbb", "dab")
_RANGES = ("lo_a", "hi_a", "lo_b", "hi_b")
_PAIR_MOMENTS = "i int, j int, " + ", ".join(f"{c} double" for c in (*_MOMENTS, *_RANGES))
# rows of a batch that are centred for all pairs at once
_SLICE = 256
# a value with more than this share of all cells is joined by broadcast (so at most 1024 are)
HOT_SHARE = 1 / 1024
# numbers that the ranks every task holds may take in all (8 MB)
HELD_NUMBERS = 1 << 20


def candidates(df: DataFrame, exclude: Sequence[str] = S.META_COLS) -> list[str]:
    """Numeric columns other than the identifying ones."""
    return [f.name for f in df.schema.fields if S.is_numeric(f) and f.name not in exclude]


def matrix_columns(df: DataFrame, cols: Sequence[str], max_null_pct: float = 80.0) -> list[str]:
    """Columns dense enough and not constant, in the given order."""
    dense = {
        r["driver"] for r in null_counts(df, cols).where(F.col("pct_null") <= max_null_pct).collect()
    }
    kept = [c for c in cols if c in dense]
    if not kept:
        return []
    constant = {r["column"] for r in zero_variance(df, kept).where("is_constant").collect()}
    return [c for c in kept if c not in constant]


def _as_matrix(batch: pa.RecordBatch) -> np.ndarray:
    """Columns of a batch as a float matrix with NaN for missing."""
    return np.column_stack([
        np.asarray(c.cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=float)
        for c in batch.columns
    ])


def _plain(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[
        F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, c in enumerate(cols)
    ])


def _triangle(matrices: Sequence[np.ndarray], names: Sequence[str]) -> pa.RecordBatch:
    """Upper triangle of square matrices, one row per pair."""
    i, j = np.triu_indices(matrices[0].shape[0])
    arrays = [pa.array(i, pa.int32()), pa.array(j, pa.int32())]
    arrays += [pa.array(m[i, j], pa.float64()) for m in matrices]
    return pa.RecordBatch.from_arrays(arrays, names=["i", "j", *names])


def _pair_means(rows: DataFrame, k: int) -> np.ndarray:
    """``[i, j]`` is the mean of column i over the rows where column j holds a value too."""
    shift = rows.agg(*[F.avg(f"c{i}") for i in range(k)]).first()
    shift = np.array([x or 0.0 for x in shift])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((k, k)) for _ in range(3)]
        for batch in batches:
            x = _as_matrix(batch) - shift
            here = (~np.isnan(x)).astype(float)
            x = np.where(here > 0, x, 0.0)
            total = [a + b for a, b in zip(total, (here.T @ here, x.T @ here, here.T @ x))]
        yield _triangle(total, ("n", "a", "b"))

    sums = rows.mapInArrow(add_up, "i int, j int, n double, a double, b double").groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "a", "b")])
    means = np.zeros((k, k))
    for r in sums.collect():  # one row per pair of columns
        n = r["n"] or 1.0
        means[r["i"], r["j"]] = shift[r["i"]] + r["a"] / n
        means[r["j"], r["i"]] = shift[r["j"]] + r["b"] / n
    return means


def _pair_moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Centred sums and ranges per pair over its complete rows.

    Each pair is centred at its own means, so a value outside the rows that a
    pair shares has no influence on it, however large.
    """
    k = len(cols)
    rows = _plain(df, cols)
    means = _pair_means(rows, k)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((k, k)) for _ in _MOMENTS]
        low, high = np.full((k, k), np.inf), np.full((k, k), -np.inf)
        for batch in batches:
            whole = _as_matrix(batch)
            for at in range(0, len(whole), _SLICE):
                x = whole[at : at + _SLICE]
                here = ~np.isnan(x)
                both = here[:, :, None] & here[:, None, :]
                d = np.where(both, x[:, :, None] - means, 0.0)  # row, i, j: column i centred for the pair
                e = d.transpose(0, 2, 1)
                parts = (both, d, e, d * d, e * e, d * e)
                sums = [s + p.sum(axis=0) for s, p in zip(sums, parts)]
                low = np.minimum(low, np.where(both, x[:, :, None], np.inf).min(axis=0))
                high = np.maximum(high, np.where(both, x[:, :, None], -np.inf).max(axis=0))
        yield _triangle([*sums, low, high, low.T, high.T], (*_MOMENTS, *_RANGES))

    return rows.mapInArrow(add_up, _PAIR_MOMENTS).groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in _MOMENTS],
        F.min("lo_a").alias("lo_a"), F.max("hi_a").alias("hi_a"), F.min("lo_b").alias("lo_b"), F.max("hi_b").alias("hi_b"),
    )


def _named(pairs: DataFrame, cols: Sequence[str]) -> DataFrame:
    return pairs.withColumns({"col_a": name_at(cols, "i"), "col_b": name_at(cols, "j")})


def _bounded(rho: Column) -> Column:
    return F.when(rho.isNotNull(), F.greatest(F.least(rho, F.lit(1.0)), F.lit(-1.0)))


def pearson(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair over its complete rows: ``(col_a, col_b, rho, n)``.

    Undefined (a constant side, or fewer than two rows) is NULL.
    """
    n = F.col("n")
    cov = F.col("dab") - F.col("da") * F.col("db") / n
    var_a = F.col("daa") - F.col("da") * F.col("da") / n
    var_b = F.col("dbb") - F.col("db") * F.col("db") / n
    spread = (F.col("lo_a") < F.col("hi_a")) & (F.col("lo_b") < F.col("hi_b"))
    rho = F.when((n > 1) & spread, F.try_divide(cov, F.sqrt(var_a) * F.sqrt(var_b)))
    return (
        _named(_pair_moments(df, cols).where("i < j"), cols)
        .select("col_a", "col_b", _bounded(rho).alias("rho"), n.cast("bigint").alias("n"))
    )


# --- Spearman -------------------------------------------------------------------


@dataclass(frozen=True)
class _Masks:
    """Columns grouped by identical missingness, with the row counts that ranks need."""

    of_column: list[int]            # mask class per column
    representative: list[int]       # one column per class
    complete: np.ndarray            # rows where columns i and j both hold a value


def _mask_classes(df: DataFrame, cols: Sequence[str]) -> _Masks:
    """Two columns share a class when both, and both together, are present equally often."""
    k = len(cols)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            here = (~np.isnan(_as_matrix(batch))).astype(float)
            total += here.T @ here
        i, j = np.triu_indices(k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total[i, j])], names=["i", "j", "n"]
        )

    sums = _plain(df, cols).mapInArrow(count, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n"))
    complete = np.zeros((k, k))
    for r in sums.collect():  # one row per pair of columns
        complete[r["i"], r["j"]] = complete[r["j"], r["i"]] = r["n"]
    of_column, representative = [], []
    for c in range(k):
        for m, rep in enumerate(representative):
            if complete[c, c] == complete[rep, rep] == complete[c, rep]:
                of_column.append(m)
                break
        else:
            of_column.append(len(representative))
            representative.append(c)
    return _Masks(of_column, representative, complete)


def _cells(cols: Sequence[str], at: Sequence[int]) -> Column:
    """The values of the columns at these places, as ``(pos, value)``; NaN counts as missing."""
    return F.inline(F.array(*[
        F.struct(
            F.lit(i).alias("pos"),
            F.nanvl(F.col(cols[i]).cast("double"), F.lit(None).cast("double")).alias("value"),
        )
        for i in at
    ]))


def _value_counts(df: DataFrame, cols: Sequence[str], masks: _Masks, at: Sequence[int]) -> DataFrame:
    """``(pos, value, m0..mM)``: in how many rows a value stands, per mask class present there."""
    present = [F.col(cols[rep]).isNotNull() & ~F.isnan(F.col(cols[rep]).cast("double"))
               for rep in masks.representative]
    long = df.select(
        *[p.cast("int").alias(f"m{m}") for m, p in enumerate(present)], _cells(cols, at)
    ).where(F.col("value").isNotNull())
    return long.groupBy("pos", "value").agg(*[F.sum(f"m{m}").alias(f"m{m}") for m in range(len(present))])


def _rank_table(df: DataFrame, cols: Sequence[str], masks: _Masks) -> DataFrame:
    """Centred average ranks ``(pos, value, n, r0..rM)`` of each distinct value of a column.

    ``rM`` is the rank among the rows where mask class M holds a value too,
    minus the mean rank. One aggregation counts every distinct value once per
    mask class, so equal values never travel as separate rows.
    """
    measures = [f"m{m}" for m in range(len(masks.representative))]
    counts = materialise(_value_counts(df, cols, masks, range(len(cols))))
    running = running_totals(counts, "pos", "value", measures)

    def centred(m: int):
        # rows where the column and the class both hold a value
        sizes = masks.complete[:, masks.representative[m]].tolist()
        size = F.get(F.array(*[F.lit(x) for x in sizes]), F.col("pos"))
        upto, own = F.col(f"cum_m{m}"), F.col(f"m{m}")
        # average rank of the tied block minus the mean rank (n + 1) / 2
        return (upto - (own - 1) / 2 - (size + 1) / 2).alias(f"r{m}")

    # a value of a column counts once in the column's own mask class
    own_class = F.get(F.array(*[F.lit(m) for m in masks.of_column]), F.col("pos"))
    n = F.get(F.array(*measures), own_class).alias("n")
    return running.select("pos", "value", n, *measures, *[centred(m) for m in range(len(measures))])


def _cross_products(ranks: list[np.ndarray], masks: _Masks) -> np.ndarray:
    """Sum of products of the two ranks for every pair, given per-class rank matrices.

    ``ranks[m][:, i]`` is the rank of column i under class m, 0 where column i
    or the class is missing.
    """
    k = len(masks.of_column)
    total = np.zeros((k, k))
    members = [[i for i in range(k) if masks.of_column[i] == m] for m in range(len(ranks))]
    for a, left in enumerate(members):
        for b, right in enumerate(members):
            # left columns ranked where class b is present, and the other way round
            total[np.ix_(left, right)] = ranks[b][:, left].T @ ranks[a][:, right]
    return total


def _need_unique(df: DataFrame, row_key: Sequence[str]) -> None:
    """Raise if two rows share a key: their cells would be taken for one row's."""
    again = df.groupBy(*row_key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    if not again.isEmpty():
        raise ValueError(f"rows repeat the key {list(row_key)}")


def _row_hash(row_key: Sequence[str]) -> list[Column]:
    return [F.xxhash64(F.lit(i), *row_key).alias(f"__k{i}") for i in (1, 2)]


def _joined_ranks(
    df: DataFrame, cols: Sequence[str], masks: _Masks, table: DataFrame, row_key: Sequence[str], hot_share: float
) -> DataFrame:
    """``(__k1, __k2, pos, r)`` from the rank table joined to the cells, for tables of any size.

    A value that holds more than ``hot_share`` of the cells is joined by
    broadcast (there can be at most 1 / ``hot_share`` of those), the rest by
    key, so no task receives a hot value.
    """
    n_masks = len(masks.representative)
    rank_cols = [f"r{m}" for m in range(n_masks)]
    packed = table.select("pos", "value", "n", F.array(*rank_cols).alias("__r"))
    n_cells = float(np.trace(masks.complete))
    hot_rows = packed.where(F.col("n") > n_cells * hot_share)
    long = df.select(*_row_hash(row_key), _cells(cols, range(len(cols)))).where(F.col("value").isNotNull())
    met = long.join(F.broadcast(hot_rows.withColumnRenamed("__r", "__h").drop("n")), ["pos", "value"], "left")
    hot = met.where(F.col("__h").isNotNull()).withColumnRenamed("__h", "__r")
    cold = met.where(F.col("__h").isNull()).drop("__h").join(
        packed.where(F.col("n") <= n_cells * hot_share).drop("n"), ["pos", "value"]
    )
    return hot.select("__k1", "__k2", "pos", "__r").unionByName(cold.select("__k1", "__k2", "pos", "__r"))


@dataclass(frozen=True)
class _Held:
    """Ranks of columns with few distinct values, which every task looks up in place."""

    at: list[int]                                      # places of the columns
    ranks: list[tuple[np.ndarray, np.ndarray]]         # sorted values, and their ranks per mask class


def _few_valued(df: DataFrame, cols: Sequence[str], n_masks: int) -> list[int]:
    """Places of the columns with the fewest distinct values, as far as those values and their
    ranks per mask class take at most ``HELD_NUMBERS`` numbers together, by estimated counts."""
    distinct = _plain(df, cols).agg(*[F.approx_count_distinct(f"c{i}") for i in range(len(cols))]).first()
    few, numbers = [], 0
    for i in sorted(range(len(cols)), key=lambda i: distinct[i]):
        numbers += distinct[i] * (n_masks + 1)
        if numbers > HELD_NUMBERS:
            break
        few.append(i)
    return sorted(few)


def _held_ranks(df: DataFrame, cols: Sequence[str], masks: _Masks, at: list[int]) -> _Held:
    """Centred average ranks of all values of the columns at these places."""
    if not at:
        return _Held([], [])
    # bounded by HELD_NUMBERS
    counts = _value_counts(df, cols, masks, at).toArrow()
    pos, value = counts["pos"].to_numpy(), counts["value"].to_numpy()
    own = np.column_stack([counts[f"m{m}"].to_numpy() for m in range(len(masks.representative))]).astype(float)
    ranks = []
    for i in at:
        mine = np.flatnonzero(pos == i)
        mine = mine[np.argsort(value[mine])]
        n = own[mine]
        ranks.append((value[mine], np.cumsum(n, axis=0) - n / 2 - n.sum(axis=0) / 2))
    return _Held(at, ranks)


def _held_values(df: DataFrame, cols: Sequence[str], held: _Held, row_key: Sequence[str]) -> DataFrame:
    """Each row's values of the held columns in the form of a cell, at place -1."""
    values = [F.nanvl(F.col(cols[i]).cast("double"), F.lit(None).cast("double")) for i in held.at]
    return df.select(*_row_hash(row_key), F.lit(-1).alias("pos"), F.array(*values).alias("__r"))


def _by_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same cells, cut so that no row goes on in the next batch."""
    rest = None
    for batch in batches:
        if not len(batch):
            continue
        if rest is not None:
            (batch,) = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()
        k1, k2 = batch.column("__k1").to_numpy(), batch.column("__k2").to_numpy()
        cut = int(np.argmax((k1 == k1[-1]) & (k2 == k2[-1])))
        rest = batch.slice(cut)
        if cut:
            yield batch.slice(0, cut)
    if rest is not None:
        yield rest


def _products(placed: DataFrame, k: int, masks: _Masks, held: _Held = _Held([], [])) -> DataFrame:
    """Rank products of each pair of the ``k`` columns, and the squares of either side:
    ``(i, j, sab, saa, sbb)``. Cells meet again by row, unless a row's values are all held."""
    n_masks = len(masks.representative)
    if len(held.at) < k:
        placed = placed.repartition("__k1", "__k2").sortWithinPartitions("__k1", "__k2")

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares = np.zeros((k, k)), np.zeros((k, n_masks))
        for batch in _by_row(batches):
            k1, k2 = batch.column("__k1").to_numpy(), batch.column("__k2").to_numpy()
            starts = np.ones(len(batch), bool)
            starts[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            row = np.cumsum(starts) - 1
            column = batch.column("pos").to_numpy()
            lists = batch.column("__r")
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            whole = column < 0
            of_whole = np.repeat(whole, np.diff(lists.offsets.to_numpy()))
            here = np.zeros((row[-1] + 1, k), dtype=bool)
            ranks = [np.zeros(here.shape) for _ in range(n_masks)]

            def place(rows, columns, values):
                here[rows, columns] = True
                for m in range(n_masks):
                    ranks[m][rows, columns] = values[:, m]

            place(row[~whole], column[~whole], flat[~of_whole].reshape(-1, n_masks))
            values = flat[of_whole].reshape(-1, max(1, len(held.at)))
            for x, (i, (known, known_ranks)) in enumerate(zip(held.at, held.ranks)):
                there = ~np.isnan(values[:, x])
                place(row[whole][there], i, known_ranks[np.searchsorted(known, values[there, x])])
            for m, rep in enumerate(masks.representative):
                ranks[m][~here[:, rep]] = 0.0
                squares[:, m] += (ranks[m] * ranks[m]).sum(axis=0)
            total += _cross_products(ranks, masks)
        i, j = np.triu_indices(k)
        of = np.array(masks.of_column)
        sums = [total[i, j], squares[i, of[j]], squares[j, of[i]]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(i, pa.int32()), pa.array(j, pa.int32()), *[pa.array(x) for x in sums]],
            names=["i", "j", "sab", "saa", "sbb"],
        )

    return placed.mapInArrow(multiply, "i int, j int, sab double, saa double, sbb double")


# --- ranks where the cells lie ---------------------------------------------------

_PART = "__part"
# mask classes told in one whole number
_WORD = 62


def _presence_words(df: DataFrame, cols: Sequence[str], masks: _Masks) -> list[Column]:
    """Which mask classes are present in a row, as bits of whole numbers."""
    present = [
        (F.col(cols[rep]).isNotNull() & ~F.isnan(F.col(cols[rep]).cast("double"))).cast("bigint")
        for rep in masks.representative
    ]
    words = []
    for w in range(0, len(present), _WORD):
        bits = F.lit(0).cast("bigint")
        for i, p in enumerate(present[w : w + _WORD]):
            bits = bits + F.shiftleft(p, i)
        words.append(bits)
    return words


def _bits(words: Sequence[np.ndarray], n_masks: int) -> np.ndarray:
    """Rows by mask classes, 1 where present."""
    return np.column_stack([(words[m // _WORD] >> (m % _WORD)) & 1 for m in range(n_masks)])


def _counter(n_words: int, n_masks: int, sign: int, name: str):
    """For batches sorted by column and value: add to each cell's balance ``sign`` times the
    rows of its column and partition that came with an earlier value, per mask class."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, upto, before = None, np.zeros(n_masks, np.int64), np.zeros(n_masks, np.int64)
        for b in batches:
            if not len(b):
                continue
            pos, value = b.column("pos").to_numpy(), b.column("value").to_numpy()
            here = _bits([b.column(f"w{i}").to_numpy() for i in range(n_words)], n_masks)
            starts = np.ones(len(b), bool)
            starts[1:] = (pos[1:] != pos[:-1]) | (value[1:] != value[:-1])
            starts[0] = key is None or pos[0] != key[0] or value[0] != key[1]
            at = np.flatnonzero(starts)
            column = np.ones(len(b), bool)
            column[1:] = pos[1:] != pos[:-1]
            column[0] = key is None or pos[0] != key[0]
            inclusive = np.cumsum(here, axis=0)
            own = inclusive[at] - here[at] + upto  # before each block, all columns of the batch
            opened = np.flatnonzero(column)
            base = inclusive[opened] - here[opened] + upto  # the same where its column began
            of_column = np.searchsorted(opened, at, side="right") - 1
            own = own - np.where((of_column >= 0)[:, None], base[np.maximum(of_column, 0)] if len(base) else 0, 0)
            blocks = np.cumsum(starts) - 1
            seen = np.where((blocks >= 0)[:, None], own[np.maximum(blocks, 0)] if len(own) else before, before)
            before = seen[-1]
            upto = inclusive[-1] + upto - (base[-1] if len(base) else 0)
            key = pos[-1], value[-1]
            out = sign * seen
            if name in b.schema.names:
                out = out + b.column(name).flatten().to_numpy().reshape(-1, n_masks)
                columns = [b.column(c) for c in b.schema.names if c != name]
                names = [c for c in b.schema.names if c != name]
            else:
                columns, names = b.columns, b.schema.names
            lists = pa.ListArray.from_arrays(np.arange(len(b) + 1, dtype=np.int32) * n_masks, pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*columns, lists], names=[*names, name])

    return count


def _ranged_cells(
    df: DataFrame, cols: Sequence[str], masks: _Masks, row_key: Sequence[str], at: Sequence[int] | None = None
) -> DataFrame:
    """Cells, of all columns or those at these places, in ranges of column and value, with the balance of smaller less larger cells of
    their own range: ``(__part, __k1, __k2, pos, value, w.., balance)``, written.

    One exchange: a range is sorted upwards and downwards where it lies, so neither way
    looks ahead and both sorts spill. The row's hash is part of the range's bound, so a
    value that holds a third of all cells is spread over ranges.
    """
    words = _presence_words(df, cols, masks)
    n_words, n_masks = len(words), len(masks.representative)
    long = df.select(
        *_row_hash(row_key), *[w.alias(f"w{i}") for i, w in enumerate(words)],
        _cells(cols, range(len(cols)) if at is None else at),
    ).where(F.col("value").isNotNull())
    schema = (
        f"{_PART} int, __k1 bigint, __k2 bigint, " + ", ".join(f"w{i} bigint" for i in range(n_words))
        + ", pos int, value double, balance array<bigint>"
    )
    held = [F.spark_partition_id().alias(_PART), "__k1", "__k2", *[f"w{i}" for i in range(n_words)], "pos", "value"]
    ranged = long.repartitionByRange("pos", "value", "__k1").select(*held)
    upwards = ranged.sortWithinPartitions("pos", "value").mapInArrow(_counter(n_words, n_masks, 1, "balance"), schema)
    downwards = upwards.sortWithinPartitions(F.desc("pos"), F.desc("value"))
    return materialise(downwards.mapInArrow(_counter(n_words, n_masks, -1, "balance"), schema))


def _range_offsets(cells: DataFrame, n_masks: int) -> list[tuple]:
    """What the other ranges add to the balances: ``(__part, pos, lo, hi, inner, at_lo, at_hi, only)``.

    One row comes to the driver for each range and column it holds. Rows between the ends
    of a range have all cells of the ranges before it below them and all of the ranges after
    it above; rows at an end do not count the cells of neighbours that hold the same value.
    """
    m = range(n_masks)
    bit = [F.shiftright(F.col(f"w{i // _WORD}"), i % _WORD).bitwiseAND(F.lit(1)) for i in m]
    balance = [F.get("balance", F.lit(i)) for i in m]
    ends = cells.groupBy(_PART, "pos").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.array(*[F.sum(b) for b in bit]).alias("total"),
        # the balance is lowest at the smallest value: what it does not count is the end itself
        F.array(*[F.min(b) for b in balance]).alias("lowest"), F.array(*[F.max(b) for b in balance]).alias("highest"),
    ).orderBy("pos", _PART).collect()
    out = []
    for pos in sorted({e["pos"] for e in ends}):
        mine = [e for e in ends if e["pos"] == pos]
        totals = np.array([e["total"] for e in mine])
        first = totals + np.array([e["lowest"] for e in mine])    # cells equal to lo
        last = totals - np.array([e["highest"] for e in mine])    # cells equal to hi
        below = np.cumsum(totals, axis=0) - totals
        above = totals.sum(axis=0) - below - totals
        # cells of earlier ranges that equal this range's lo, and of later ones that equal its hi
        tied_lo, tied_hi = np.zeros_like(totals), np.zeros_like(totals)
        for i in range(1, len(mine)):
            if mine[i - 1]["hi"] == mine[i]["lo"]:
                whole = mine[i - 1]["lo"] == mine[i - 1]["hi"]
                tied_lo[i] = last[i - 1] + (tied_lo[i - 1] if whole else 0)
        for i in range(len(mine) - 2, -1, -1):
            if mine[i + 1]["lo"] == mine[i]["hi"]:
                whole = mine[i + 1]["lo"] == mine[i + 1]["hi"]
                tied_hi[i] = first[i + 1] + (tied_hi[i + 1] if whole else 0)
        for e, b, a, tl, th in zip(mine, below, above, tied_lo, tied_hi):
            inner = b - a
            out.append((e[_PART], pos, e["lo"], e["hi"], *[x.tolist() for x in (inner, inner - tl, inner + th, inner - tl + th)]))
    return out


def _placed(cells: DataFrame, n_masks: int) -> DataFrame:
    """``(__k1, __k2, pos, r)``: centred average ranks per mask class, 0 where it is absent.

    The mean of the ranks of tied cells, less the mean rank, is half of the cells below
    less the cells above.
    """
    listed = cells.sparkSession.createDataFrame(
        _range_offsets(cells, n_masks),
        f"{_PART} int, pos int, lo double, hi double, inner array<bigint>, at_lo array<bigint>, at_hi array<bigint>, only array<bigint>",
    )
    low, high = F.col("value") == F.col("lo"), F.col("value") == F.col("hi")
    offset = F.when(low & high, F.col("only")).when(low, F.col("at_lo")).when(high, F.col("at_hi")).otherwise(F.col("inner"))

    def rank(m: int) -> Column:
        there = F.shiftright(F.col(f"w{m // _WORD}"), m % _WORD).bitwiseAND(F.lit(1)) == 1
        return F.when(there, (F.get("balance", F.lit(m)) + F.get("__offset", F.lit(m))) / 2.0).otherwise(0.0)

    # at most one row for each range and column
    met = cells.join(F.broadcast(listed), [_PART, "pos"]).withColumn("__offset", offset)
    return met.select("__k1", "__k2", "pos", F.array(*[rank(m) for m in range(n_masks)]).alias("__r"))


def spearman(
    df: DataFrame, cols: Sequence[str], row_key: Sequence[str], hot_share: float | None = None
) -> DataFrame:
    """Spearman correlation of every pair over its complete rows: ``(col_a, col_b, rho, n)``.

    The ranks of a column depend only on which rows of the *other* column are
    present, so columns with the same missingness share one ranking. Tied
    values get their average rank. ``row_key`` identifies a row; a repeated key
    is an error.

    Columns with few distinct values are ranked from the counts of these, which every task
    holds (``HELD_NUMBERS``). Cells of the others are ranked where one exchange by ranges of
    column and value puts them, and meet their row's held values in a second one. With
    ``hot_share`` all ranks come from a table of distinct values instead, joined by key, or by
    broadcast for values above that share of all cells. The result is the same.
    """
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "col_a string, col_b string, rho double, n bigint")
    _need_unique(df, row_key)
    k, masks = len(cols), _mask_classes(df, cols)
    n_masks = len(masks.representative)
    if hot_share is None:
        held = _held_ranks(df, cols, masks, _few_valued(df, cols, n_masks))
        rest = [i for i in range(k) if i not in held.at]
        parts = [_held_values(df, cols, held, row_key)] if held.at else []
        if rest:
            parts.append(_placed(_ranged_cells(df, cols, masks, row_key, rest), n_masks))
        products = _products(reduce(DataFrame.unionByName, parts), k, masks, held)
    else:
        table = materialise(_rank_table(df, cols, masks))
        products = _products(_joined_ranks(df, cols, masks, table, row_key, hot_share), k, masks)
    complete = [(i, j, int(masks.complete[i, j])) for i in range(k) for j in range(i + 1, k)]
    pairs = df.sparkSession.createDataFrame(complete, "i int, j int, n bigint")
    # one row per pair of columns
    summed = products.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("sab", "saa", "sbb")])
    joined = pairs.join(F.broadcast(summed), ["i", "j"], "left")
    rho = F.try_divide(F.col("sab"), F.sqrt("saa") * F.sqrt("sbb"))
    return _named(joined, cols).select("col_a", "col_b", _bounded(rho).alias("rho"), "n")


# --- use of the matrices ---------------------------------------------------------


def strong_pairs(matrix: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Pairs above the threshold, strongest first; an undefined correlation never counts."""
    return matrix.where(F.abs("rho") > threshold).orderBy(F.desc(F.abs("rho")), "col_a", "col_b")


@dataclass(frozen=True)
class Drop:
    dropped: str
    kept: str
    rho: float
    reason: str


def choose_drops(
    pairs: Sequence[tuple[str, str, float]],
    null_rate: dict[str, float],
    order: Sequence[str],
    priority: Sequence[str] = (),
) -> list[Drop]:
    """Pick one column of each strong pair to drop, the strongest pairs first.

    A pair with a dropped member is settled. Otherwise a priority column beats
    a plain one, then the lower null rate wins, then the smaller name.
    """
    at = {c: i for i, c in enumerate(order)}
    ranked = sorted(pairs, key=lambda p: (-abs(p[2]), at[p[0]], at[p[1]]))
    gone: dict[str, Drop] = {}
    for a, b, rho in ranked:
        if a in gone or b in gone:
            continue
        protected = {a, b} & set(priority)
        if len(protected) == 1:
            (keep,) = protected
            reason = "priority"
        else:
            keep = min((a, b), key=lambda c: (null_rate[c], c))
            reason = "null rate" if null_rate[a] != null_rate[b] else "name"
        lose = b if keep == a else a
        gone[lose] = Drop(lose, keep, abs(rho), reason)
    return list(gone.values())


def collinear_drops(
    df: DataFrame,
    row_key: Sequence[str],
    threshold: float = 0.85,
    priority: Sequence[str] = (),
    cols: Sequence[str] | None = None,
) -> list[Drop]:
    """Columns the collinearity filter removes, with the partner and the reason.

    The matrix is computed on Spark; at most one row per strong pair reaches
    the driver, where the pairs are settled one after the other.
    """
    if not 0.0 < threshold < 1.0:
        raise ValueError(f"no correlation limit between 0 and 1: {threshold!r}")
    cols = list(cols or candidates(df, [*S.META_COLS, *row_key]))
    if len(cols) < 2:
        return []
    strong = strong_pairs(spearman(df, cols, row_key), threshold).collect()
    if not strong:
        return []
    rates = {r["driver"]: r["pct_null"] for r in null_counts(df, cols).collect()}
    return choose_drops([(r["col_a"], r["col_b"], r["rho"]) for r in strong], rates, cols, priority)


def collinearity_filter(
    df: DataFrame, row_key: Sequence[str], threshold: float = 0.85, priority: Sequence[str] = ()
) -> tuple[DataFrame, list[Drop]]:
    drops = collinear_drops(df, row_key, threshold, priority)
    return df.drop(*[d.dropped for d in drops]), drops
