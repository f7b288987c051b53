"""Profile aggregates: missingness, distributions, population comparison, cohorts."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsewide.functions import columns as C
from pulsewide.operators.ordering import (
    column_percentiles,
    name_at,
    numbered_values,
    percentile_map,
    percentiles,
)


# bins of a batch that meet the grid of a density at once
_DENSITY_ROWS = 1024
# bins to a bandwidth, and the powers summed in each
_DENSITY_BINS, _DENSITY_MOMENTS = 8, 10


def _stack(one_row: DataFrame, cols: Sequence[str], fields: Mapping[str, str], name: str) -> DataFrame:
    """One row with ``col|field`` columns to one row per column."""
    return one_row.select(
        F.inline(
            F.array(*[
                F.struct(
                    F.lit(c).alias(name),
                    *[F.col(f"`{c}|{f}`").cast(t).alias(f) for f, t in fields.items()],
                )
                for c in cols
            ])
        )
    )


# --- missingness --------------------------------------------------------------


def null_counts(df: DataFrame, cols: Sequence[str], name: str = "driver") -> DataFrame:
    """``(driver, n_null, n_rows, pct_null)`` from one aggregation over all columns."""
    one = df.agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in cols],
    )
    cells = F.array(*[
        F.struct(F.lit(c).alias(name), F.col(c).alias("n_null"), F.col("__n").alias("n_rows"))
        for c in cols
    ])
    return one.select(F.inline(cells)).withColumn(
        "pct_null", C.guarded_ratio(F.col("n_null") * 100.0, F.col("n_rows"))
    )


def sparsity(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of missing cells in the whole matrix, in percent."""
    return null_counts(df, cols).agg(
        F.sum("n_null").alias("n_null"),
        F.sum("n_rows").alias("n_cells"),
        C.guarded_ratio(F.sum("n_null") * 100.0, F.sum("n_rows")).alias("pct_null"),
    )


def sparsity_tiers(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Number of columns per missingness tier; the 50 % edge is in the upper tier."""
    pct = F.col("pct_null")
    # fixed values: tier names and edges of the published report
    tier = (
        F.when(pct > 90, F.lit("Extreme (>90%)"))
        .when(pct >= 50, F.lit("High (50–90%)"))
        .when(pct >= 10, F.lit("Moderate (10–50%)"))
        .otherwise(F.lit("Low (<10%)"))
    )
    return null_counts(df, cols).groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n_features"))


# --- value profiles -----------------------------------------------------------


def numeric_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Count, range, mean and exact median per column; an all-NULL column keeps its row."""
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [
            F.count(x).alias(f"{c}|n"),
            F.min(x).alias(f"{c}|min"),
            F.max(x).alias(f"{c}|max"),
            F.avg(x).alias(f"{c}|mean"),
        ]
    fields = {"n": "bigint", "min": "double", "max": "double", "mean": "double"}
    base = _stack(df.agg(*aggs), cols, fields, "column")
    medians = column_percentiles(df, cols, [0.5]).select("column", F.col("quantile").alias("median"))
    # one row per column
    return base.join(F.broadcast(medians), "column", "left")


def categorical_profile(df: DataFrame, cols: Sequence[str], preview: int = 8) -> DataFrame:
    """Distinct values per column and the first few of them by name.

    The preview uses a ranked window, which Spark limits map-side to ``preview``
    rows per column before the shuffle.
    """
    levels = level_counts(df, cols)
    totals = levels.groupBy("column").agg(F.count(F.lit(1)).alias("n_distinct"))
    by_name = Window.partitionBy("column").orderBy("level")
    first = (
        levels.withColumn("__r", F.row_number().over(by_name))
        .where(F.col("__r") <= preview)
        .groupBy("column")
        .agg(F.array_join(F.array_sort(F.collect_list("level")), "|").alias("preview"))
    )
    return totals.join(F.broadcast(first), "column")


def level_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, level, n)`` over the non-null values of text columns."""
    cells = F.array(*[
        F.struct(F.lit(i).alias("pos"), F.col(c).cast("string").alias("level")) for i, c in enumerate(cols)
    ])
    return (
        df.select(F.inline(cells))
        .where(F.col("level").isNotNull())
        .groupBy("pos", "level")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(name_at(cols).alias("column"), "level", "n")
    )


def top_levels(df: DataFrame, cols: Sequence[str], k: int = 8) -> DataFrame:
    """The ``k`` most frequent levels per column; equal counts go by name."""
    order = Window.partitionBy("column").orderBy(F.desc("n"), "level")
    return (
        level_counts(df, cols)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
    )


def sparsest(df: DataFrame, cols: Sequence[str], k: int = 30) -> DataFrame:
    return null_counts(df, cols).orderBy(F.desc("pct_null"), "driver").limit(k)


def zero_variance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sample deviation per column and whether it is zero.

    Also flags a column by equal minimum and maximum, where the deviation can
    differ from zero by rounding.
    """
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [
            F.stddev_samp(x).alias(f"{c}|std"),
            ((F.min(x) == F.max(x)) & (F.count(x) > 1)).alias(f"{c}|is_constant"),
        ]
    fields = {"std": "double", "is_constant": "boolean"}
    return _stack(df.agg(*aggs), cols, fields, "column").withColumn(
        "is_constant", F.coalesce("is_constant", F.lit(False))
    )


# --- classes and shares -------------------------------------------------------


def shares(df: DataFrame, group: str, name: str = "n") -> DataFrame:
    """Count and percent share per level; the total is one number from the level rows."""
    counted = df.groupBy(group).agg(F.count(F.lit(1)).alias(name))
    return counted.withColumn("share_pct", F.col(name) * 100.0 / counted.agg(F.sum(name)).scalar())


def max_deviation(df: DataFrame, class_col: str, codes: Sequence[int]) -> DataFrame:
    """Largest distance of a class share from an even split, in percentage points."""
    even = 100.0 / len(codes)
    one = df.agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(F.col(class_col) == c).alias(f"c{c}") for c in codes],
    )
    gaps = [F.abs(C.guarded_ratio(F.col(f"c{c}") * 100.0, F.col("__n")) - even) for c in codes]
    return one.select(F.greatest(*gaps).alias("max_deviation_pp"))


def flag_counts(df: DataFrame, flag: str) -> DataFrame:
    """Count and share of set, unset and missing flags."""
    f = F.col(flag)
    one = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(f == 1).alias("severe"),
        F.count_if(f == 0).alias("normal"),
        F.count_if(f.isNull()).alias("missing"),
    )
    return one.select(
        F.inline(F.array(*[
            F.struct(
                F.lit(name).alias("state"),
                F.col(name).alias("n"),
                C.guarded_ratio(F.col(name) * 100.0, F.col("n")).alias("share_pct"),
            )
            for name in ("severe", "normal", "missing")
        ]))
    )


def exposure(frames: Mapping[str, DataFrame], col: str, threshold: float = 10.0) -> DataFrame:
    """Percent of rows above, at or below, and without a value, per population; 0 in an empty one."""
    x = F.col(col)
    percent = lambda n: C.guarded_ratio(n * 100.0, F.count(F.lit(1)))
    parts = [
        frame.agg(
            F.lit(name).alias("population"),
            percent(F.count_if(x > threshold)).alias("pct_severe"),
            percent(F.count_if(x <= threshold)).alias("pct_normal"),
            percent(F.count_if(x.isNull())).alias("pct_missing"),
        )
        for name, frame in frames.items()
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def date_ranges(df: DataFrame, group: str, date_col: str) -> DataFrame:
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(date_col).alias("first_date"),
        F.max(date_col).alias("last_date"),
    )


def base_rate(df: DataFrame, label: str, n_classes: int = 3) -> DataFrame:
    """Positive share and the log-loss of predicting it for everyone, 0 if all are alike."""
    p = F.col("base_rate")
    part = lambda q: F.when(q > 0, -q * F.ln(q)).when(q == 0, F.lit(0.0))
    return df.agg(F.avg(F.col(label).cast("double")).alias("base_rate")).select(
        "base_rate",
        (part(p) + part(1 - p)).alias("naive_logloss"),
        F.lit(math.log(n_classes)).alias("uniform_logloss"),
    )


# --- trimming and populations -------------------------------------------------


def trim(df: DataFrame, col: str, lo: float = 0.01, hi: float = 0.99) -> DataFrame:
    """Rows whose value lies within its own percentile bounds.

    The two bounds become literals, so the filter reaches the scan.
    """
    bounds = percentile_map(df, [col], [lo, hi])[col]
    return df.where(F.col(col).between(*bounds))


def _stacked_populations(frames: Sequence[DataFrame], cols: Sequence[str]) -> DataFrame:
    """Values of several populations as ``(key, value)``, key = column * populations + population.

    One number per column and population is what travels.
    """
    parts = [
        numbered_values(f, cols).select((F.col("pos") * len(frames) + who).alias("key"), "value")
        for who, f in enumerate(frames)
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def joint_bounds(
    frames: Sequence[DataFrame], cols: Sequence[str], lo: float = 0.01, hi: float = 0.99
) -> dict[str, tuple[float, float]]:
    """Smallest lower and largest upper percentile over several populations, per column."""
    found = percentiles(_stacked_populations(frames, cols), "key", "value", [lo, hi]).collect()
    quantile = {(r["key"], r["prob"]): r["quantile"] for r in found}
    bounds = {}
    for pos, c in enumerate(cols):
        keys = [pos * len(frames) + who for who in range(len(frames))]
        lows = [quantile[k, lo] for k in keys if (k, lo) in quantile]
        highs = [quantile[k, hi] for k in keys if (k, hi) in quantile]
        bounds[c] = (min(lows, default=None), max(highs, default=None))
    return bounds


def joint_trim(frames: Sequence[DataFrame], col: str) -> list[DataFrame]:
    lo, hi = joint_bounds(frames, [col])[col]
    return [f.where(F.col(col).between(F.lit(lo), F.lit(hi))) for f in frames]


def compare_populations(first: DataFrame, second: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, median, population deviation and p95 of two populations, with their distance."""
    both = _stacked_populations([first, second], cols)
    moments = both.groupBy("key").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    order = (
        percentiles(both, "key", "value", [0.5, 0.95])
        .groupBy("key")
        .agg(
            F.max(F.when(F.col("prob") == 0.5, F.col("quantile"))).alias("median"),
            F.max(F.when(F.col("prob") == 0.95, F.col("quantile"))).alias("p95"),
        )
    )
    # one row per column and population
    long = moments.join(F.broadcast(order), "key").unpivot(
        ["key"], ["mean", "median", "std", "p95"], "stat", "value"
    )
    one = lambda who: F.max(F.when(F.col("key") % 2 == who, F.col("value")))
    return (
        long.groupBy(F.floor(F.col("key") / 2).cast("int").alias("pos"), "stat")
        .agg(one(0).alias("first"), one(1).alias("second"))
        .select(
            name_at(cols).alias("column"), "stat", "first", "second",
            F.abs(F.col("first") - F.col("second")).alias("abs_diff"),
        )
    )


def mean_shift(first: DataFrame, second: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Difference of means after the joint trim, absolute and relative to the second."""
    bounds = joint_bounds([first, second], cols)
    parts = [f.select(F.lit(who).alias("who"), *cols) for who, f in enumerate((first, second))]

    def mean(c: str, who: int) -> Column:
        x = F.col(c).cast("double")
        kept = x.between(F.lit(bounds[c][0]), F.lit(bounds[c][1])) & (F.col("who") == who)
        return F.avg(F.when(kept, x))

    one = parts[0].unionByName(parts[1]).agg(*[
        mean(c, who).alias(f"{c}|{name}") for c in cols for who, name in enumerate(("mean_first", "mean_second"))
    ])
    delta = F.abs(F.col("mean_first") - F.col("mean_second"))
    return _stack(one, cols, {"mean_first": "double", "mean_second": "double"}, "column").select(
        "column",
        "mean_first",
        "mean_second",
        delta.alias("delta"),
        # fixed value: 1e-9 keeps the ratio defined at a zero mean
        (delta / (F.abs("mean_second") + 1e-9) * 100).alias("relative_pct"),
    )


# --- distributions ------------------------------------------------------------


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width bins over the data range, the last one closed: ``(bin, lo, hi, n)``.

    Empty bins are listed with 0. A constant column gets a range of width 1.
    """
    x = F.col(col).cast("double")
    lo, hi = df.agg(F.min(x), F.max(x)).first()
    spark = df.sparkSession
    if lo is None:
        return spark.range(0).select(
            F.col("id").alias("bin"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"),
            F.lit(0).cast("bigint").alias("n"),
        )
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    place = F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("bigint")
    counted = df.where(x.isNotNull()).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    # the bin list is as long as the report
    return (
        spark.range(bins).withColumnRenamed("id", "bin")
        .join(F.broadcast(counted), "bin", "left")
        .select(
            "bin",
            (F.lit(lo) + F.col("bin") * width).alias("lo"),
            (F.lit(lo) + (F.col("bin") + 1) * width).alias("hi"),
            F.coalesce("n", F.lit(0)).cast("bigint").alias("n"),
        )
    )


def quantile_edges(df: DataFrame, col: str, q: int) -> list[float]:
    """Distinct edges of ``q`` quantile bins (at most ``q + 1`` numbers)."""
    found = percentile_map(df, [col], [i / q for i in range(q + 1)])[col]
    return sorted({e for e in found if e is not None})


def quantile_bin(col: Column, edges: Sequence[float]) -> Column:
    """Bin number for right-closed intervals, the lowest value included in the first."""
    last = len(edges) - 2
    result = F.when(col <= F.lit(edges[-1]), F.lit(last))
    for i in range(last - 1, -1, -1):
        result = F.when(col <= F.lit(edges[i + 1]), F.lit(i)).otherwise(result)
    return F.when(col >= F.lit(edges[0]), result).cast("int")


def quantile_class_mix(
    df: DataFrame, col: str, class_col: str, codes: Sequence[int], q: int = 8
) -> DataFrame:
    """Class counts per quantile bin of ``col``: ``(bin, lo, hi, label, class_*, total)``."""
    rows = df.where(F.col(col).isNotNull() & F.col(class_col).isin(list(codes)))
    edges = quantile_edges(rows, col, q)
    place = quantile_bin(F.col(col), edges)
    binned = rows.select(place.alias("bin"), F.col(class_col))
    table = cross_tab(binned, "bin", class_col, codes, prefix="class_")
    at = F.array(*[F.lit(e) for e in edges])
    lo, hi = F.get(at, F.col("bin")), F.get(at, F.col("bin") + 1)
    return table.select(
        "bin", lo.alias("lo"), hi.alias("hi"), C.interval_label(lo, hi).alias("label"),
        *[c for c in table.columns if c != "bin"],
    )


def kernel_density(
    frames: Mapping[str, DataFrame], col: str, points: int = 200, cut: float = 3.0
) -> DataFrame:
    """Gaussian density of each population on an even grid: ``(population, k, x, density)``.

    Bandwidth is the sample deviation times ``n ** (-1/5)``; the grid reaches
    ``cut`` bandwidths beyond the data. Values are reduced to the moments of bins an eighth
    of a bandwidth wide, and the grid meets the bins, so the cost of the kernel does not
    depend on how many distinct values there are. The kernel around a bin's centre is
    expanded in ``_DENSITY_MOMENTS`` terms; the terms left out are below 1e-15 of the
    kernel's height.

    A population without two distinct values has no density: it gets one row, in which
    all but its name is NULL.
    """
    names = list(frames)
    x = F.col(col).cast("double")
    parts = [f.select(F.lit(who).alias("who"), x.alias("x")).where(F.col("x").isNotNull()) for who, f in enumerate(frames.values())]
    rows = functools.reduce(DataFrame.unionByName, parts)
    stats = rows.groupBy("who").agg(F.count("x"), F.min("x"), F.max("x"), F.stddev_samp("x")).collect()
    grids, scales = {}, {}
    for who, n, lo, hi, std in stats:
        if n > 1 and lo < hi and std:
            h = std * n ** (-0.2)
            grids[who] = (lo - cut * h, (hi - lo + 2 * cut * h) / (points - 1), h)
            scales[who] = n * h * math.sqrt(2 * math.pi)
    if not grids:
        raise ValueError(f"no population has two distinct values in '{col}'")
    pick = lambda values: F.element_at(F.create_map(*[F.lit(v) for item in values.items() for v in item]), F.col("who"))
    start, height = pick({w: float(g[0]) for w, g in grids.items()}), pick({w: float(g[2]) for w, g in grids.items()})
    away = (F.col("x") - start) / height  # in bandwidths
    placed = (
        rows.where(F.col("who").isin(list(grids)))
        .select("who", away.alias("z")).select("who", "z", F.floor(F.col("z") * _DENSITY_BINS).alias("bin"))
        .select("who", "bin", (F.col("z") - (F.col("bin") + 0.5) / _DENSITY_BINS).alias("t"))
    )
    moments = [f"m{p}" for p in range(_DENSITY_MOMENTS)]
    binned = placed.groupBy("who", "bin").agg(*[F.sum(F.pow("t", F.lit(float(p)))).alias(m) for p, m in enumerate(moments)])
    steps = {w: g[1] / g[2] for w, g in grids.items()}

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {who: np.zeros(points) for who in steps}
        for batch in batches:
            who, bins = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            found = np.stack([c.to_numpy() for c in batch.columns[2:]])
            for w, step in steps.items():
                mine = np.flatnonzero(who == w)
                for k in range(0, len(mine), _DENSITY_ROWS):
                    some = mine[k : k + _DENSITY_ROWS]
                    # beyond 40 bandwidths the kernel is 0 in doubles
                    z = np.clip((np.arange(points) * step)[:, None] - (bins[some] + 0.5) / _DENSITY_BINS, -40.0, 40.0)
                    before, now, total = np.zeros_like(z), np.ones_like(z), np.zeros_like(z)
                    for p in range(_DENSITY_MOMENTS):
                        total += now * (found[p, some] / math.factorial(p))
                        before, now = now, z * now - p * before  # the next Hermite polynomial
                    sums[w] += (np.exp(-0.5 * z * z) * total).sum(axis=1)
        for w, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([w] * points, pa.int32()), pa.array(range(points), pa.int32()), pa.array(total)], names=["who", "k", "s"])

    summed = binned.mapInArrow(add_up, "who int, k int, s double").groupBy("who", "k").agg(F.sum("s").alias("s"))
    densities = summed.select(
        name_at(names, "who").alias("population"),
        "k",
        (start + F.col("k") * pick({w: float(g[1]) for w, g in grids.items()})).alias("x"),
        (F.col("s") / pick({w: float(v) for w, v in scales.items()})).alias("density"),
    )
    flat = [(name, None, None, None) for who, name in enumerate(names) if who not in grids]
    if not flat:
        return densities
    return densities.unionByName(densities.sparkSession.createDataFrame(flat, "population string, k int, x double, density double"))


# --- cross-tabs and cohorts ---------------------------------------------------


def cross_tab(
    df: DataFrame, group: str, class_col: str, codes: Sequence[int], prefix: str = "class_"
) -> DataFrame:
    """Counts per group and class with every class present, and the row total."""
    counted = df.groupBy(group).agg(*[
        F.count_if(F.col(class_col) == c).alias(f"{prefix}{c}") for c in codes
    ])
    total = sum((F.col(f"{prefix}{c}") for c in codes), F.lit(0))
    return counted.withColumn("total", total)


def row_percent(table: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Share of each column in its row, in percent; an empty row gives 0."""
    total = sum((F.col(c) for c in cols), F.lit(0))
    return table.withColumns({
        f"{c}_pct": F.col(c) * 100.0 / F.greatest(total, F.lit(1)) for c in cols
    })


def transpose_row(one_row: DataFrame, name: str = "driver", value: str = "value") -> DataFrame:
    """A one-row statistics table to ``(name, value)`` rows."""
    return one_row.unpivot([], list(one_row.columns), name, value)


def cohorts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows without any activity against rows with some: ``(cohort, n, share_pct)``."""
    active = C.any_not_null(cols)
    return shares(
        df.select(F.when(active, F.lit("partial")).otherwise(F.lit("pure_inactive")).alias("cohort")),
        "cohort",
    )


def split_by_activity(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    active = C.any_not_null(cols)
    return df.where(~active), df.where(active)


def extremes(df: DataFrame, score: str, key: str, high: float = 0.90, low: float = 0.10) -> DataFrame:
    """Highest- and lowest-scored row, and whether they pass the bounds.

    Of equal scores the smallest key is taken; keys may be of any type that sorts.
    """
    scored = df.where(F.col(score).isNotNull())
    bounds = scored.agg(F.max(score).alias("top"), F.min(score).alias("bottom"))
    # one row
    at = scored.join(F.broadcast(bounds), (F.col(score) == F.col("top")) | (F.col(score) == F.col("bottom")))
    one = at.agg(
        *[F.first(c).alias(c) for c in ("top", "bottom")],
        *[F.min(F.when(F.col(score) == F.col(c), F.col(key))).alias(f"key_{c}") for c in ("top", "bottom")],
    )
    line = lambda who, c, passes: F.struct(
        F.lit(who).alias("who"), F.col(f"key_{c}").alias(key), F.col(c).alias(score), passes.alias("passes"))
    return one.select(F.inline(F.array(
        line("high", "top", F.col("top") > high), line("low", "bottom", F.col("bottom") < low))))


def score_summary(df: DataFrame, col: str) -> DataFrame:
    """Mean, median, sample deviation and range of a score column."""
    moments = df.agg(
        F.lit(col).alias("column"),
        F.avg(col).alias("mean"), F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"), F.max(col).alias("max"),
    )
    median = column_percentiles(df, [col], [0.5]).select("column", F.col("quantile").alias("median"))
    return moments.join(F.broadcast(median), "column", "left")


# --- column selection ---------------------------------------------------------


def columns_with(cols: Sequence[str], *parts: str) -> list[str]:
    """Sorted names that contain any of ``parts``."""
    return sorted(c for c in cols if any(p in c for p in parts))


def present_only(df: DataFrame, wanted: Sequence[str]) -> list[str]:
    """Wanted names that exist, in the wanted order and once each."""
    return [c for c in dict.fromkeys(wanted) if c in df.columns]
