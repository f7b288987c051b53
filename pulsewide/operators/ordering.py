"""Exact order statistics and running totals without a single-partition sort.

Everything here starts from one row per distinct ``(group, value)``, so a value
that holds a third of all rows arrives as one pre-aggregated row. The values of
a group are then cut into ranges of similar size, whose number follows the shuffle
partitions; windows run inside one range, and the range totals supply the offsets.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsewide.session import materialise

#: Ranges per group for each shuffle partition, and distinct values that make a range worth while.
RANGES_PER_PARTITION = 4
ROWS_PER_RANGE = 50_000
#: Accuracy of the sketches, and how many of a group are merged before they meet.
SKETCH_SIZE = 4096
SKETCH_SLOTS = 64
_CHUNK = 32
_BUCKET = "__bucket"
_CUTS = "__cuts"


def _number(col: Column, data_type: T.DataType) -> Column:
    """A number in the order of the values, which may be dates."""
    return (F.unix_date(col) if isinstance(data_type, T.DateType) else col).cast("double")


def value_cuts(
    counts: DataFrame, group: str, value: str, rows_per_range: int = ROWS_PER_RANGE, max_ranges: int | None = None
) -> dict:
    """Cut points per group, ``{group: [cut, ...]}``, from one row per group and value.

    The cuts are approximate quantiles, which only decides how even the ranges
    are. They are fetched once, so that every later use sees the same ranges
    even if a task is run again. Small groups get few ranges; the number of
    ranges follows the shuffle partitions unless given. Every task sends one
    sketch for each of ``SKETCH_SLOTS`` slots, and what meets in the task of a
    group are the slots' sketches, however many tasks there were.
    """
    if max_ranges is None:
        max_ranges = RANGES_PER_PARTITION * int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    number = _number(F.col(value), counts.schema[value].dataType)
    slots = (
        counts.where(F.col(value).isNotNull())
        .groupBy(group, F.pmod(F.xxhash64(value), F.lit(SKETCH_SLOTS)).alias("__slot"))
        .agg(F.kll_sketch_agg_double(number, F.lit(SKETCH_SIZE)).alias("__k"), F.count(F.lit(1)).alias("__n"))
    )
    # as text: many literals are slow to build one by one
    grid = ", ".join(f"{i / max_ranges!r}D" for i in range(1, max_ranges))
    merged = slots.groupBy(group).agg(F.kll_merge_agg_double("__k").alias("__k"), F.sum("__n").alias("__n"))
    all_cuts = F.expr(f"kll_sketch_get_quantile_double(__k, array({grid}))") if max_ranges > 1 else F.array().cast("array<double>")
    cuts = {}
    for r in merged.select(group, "__n", all_cuts.alias(_CUTS)).collect():
        step = max(1, max_ranges // max(1, math.ceil(r["__n"] / rows_per_range)))
        cuts[r[group]] = list(dict.fromkeys(r[_CUTS][step - 1 :: step]))
    return cuts


def with_buckets(counts: DataFrame, cuts: dict, group: str, value: str) -> DataFrame:
    """Number each row's range, which is the count of cuts below its value.

    The cuts are searched in two steps, first the last cut of each chunk and
    then the cuts of one chunk.
    """
    chunked = {
        g: [c[i : i + _CHUNK] for i in range(0, len(c), _CHUNK)] + [[]] for g, c in cuts.items()
    }
    kind = T.ArrayType(T.ArrayType(T.DoubleType()))
    number = _number(F.col(value), counts.schema[value].dataType)
    if len(cuts) == 1:
        (only,) = chunked.values()
        nested = F.array(*[F.lit(c) if c else F.array() for c in only])
        held = counts.withColumn(_CUTS, nested.cast(kind))
    else:
        schema = T.StructType([
            T.StructField(group, counts.schema[group].dataType), T.StructField(_CUTS, kind)
        ])
        listed = counts.sparkSession.createDataFrame(list(chunked.items()), schema)
        # fixed bound: one row of fewer numbers than ranges per group
        held = counts.join(F.broadcast(listed), group)
    below = lambda c: c < number
    chunk = F.size(F.filter(_CUTS, lambda c: F.coalesce(below(F.get(c, F.size(c) - 1)), F.lit(False))))
    bucket = F.col("__chunk") * _CHUNK + F.size(F.filter(F.get(_CUTS, F.col("__chunk")), below))
    return (
        held.withColumn("__chunk", chunk)
        # never null, and said so, else a later join on it computes it again to check
        .withColumn(_BUCKET, F.coalesce(bucket, F.lit(0)))
        .drop(_CUTS, "__chunk")
    )


def running_totals(
    counts: DataFrame,
    group: str,
    value: str,
    measures: Sequence[str],
    cuts: dict | None = None,
    descending: bool = False,
    prefix: str = "cum_",
) -> DataFrame:
    """Inclusive running sums of ``measures`` in ``value`` order within ``group``.

    ``counts`` holds one row per (group, value) and should have no columns
    beyond the measures: the range totals and the rows then read one shuffle.
    Pass a written table, from which the cuts are found too unless given.
    """
    cuts = value_cuts(counts, group, value) if cuts is None else cuts
    bucketed = with_buckets(counts, cuts, group, value)
    order = F.desc if descending else F.asc
    totals = bucketed.groupBy(group, _BUCKET).agg(*[F.sum(m).alias(m) for m in measures])
    before = (
        Window.partitionBy(group)
        .orderBy(order(_BUCKET))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        group,
        _BUCKET,
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"__off_{m}") for m in measures],
    )
    inside = (
        Window.partitionBy(group, _BUCKET)
        .orderBy(order(value))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        bucketed.select("*", *[F.sum(m).over(inside).alias(f"__in_{m}") for m in measures])
        # at most one row per group and range
        .join(F.broadcast(offsets), [group, _BUCKET])
        .select(
            *counts.columns,
            *[(F.col(f"__in_{m}") + F.col(f"__off_{m}")).alias(prefix + m) for m in measures],
        )
    )


def locate(
    values: DataFrame,
    group: str,
    value: str,
    ranks: Column,
    cuts: dict | None = None,
) -> DataFrame:
    """Values found at given 0-based ascending ranks: ``(group, n, rank, value, below, at)``.

    ``ranks`` is an array expression that may use the group's non-null count
    ``n``. ``below`` counts rows strictly smaller than the value, ``at`` those
    equal to it. Only ranges that hold a wanted rank are sorted. The values are
    read once: their counts are written, and cuts and ranks come from these.
    ``cuts`` may be given where the values are known to be few.
    """
    present = values.where(F.col(value).isNotNull())
    counts = present.groupBy(group, value).agg(F.count(F.lit(1)).alias("__n"))
    if cuts is None:
        counts = materialise(counts)
        cuts = value_cuts(counts, group, value)
    bucketed = with_buckets(counts, cuts, group, value)

    whole = Window.partitionBy(group)
    before = whole.orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    totals = bucketed.groupBy(group, _BUCKET).agg(F.sum("__n").alias("__t")).select(
        group,
        _BUCKET,
        "__t",
        F.sum("__t").over(whole).alias("n"),
        F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__off"),
    )
    wanted = (
        totals.select("*", F.explode(F.array_distinct(ranks)).alias("rank"))
        .where((F.col("rank") >= F.col("__off")) & (F.col("rank") < F.col("__off") + F.col("__t")))
    )
    by_bucket = wanted.groupBy(group, _BUCKET, "n", "__off").agg(
        F.collect_set("rank").alias("__ranks")
    )
    inside = (
        Window.partitionBy(group, _BUCKET)
        .orderBy(value)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        # at most one row per requested rank
        bucketed.join(F.broadcast(by_bucket), [group, _BUCKET])
        .withColumn("__upto", F.col("__off") + F.sum("__n").over(inside))
        .withColumn("below", F.col("__upto") - F.col("__n"))
        .withColumn(
            "rank",
            F.explode(
                F.filter(
                    "__ranks",
                    lambda r: (r >= F.col("below")) & (r < F.col("__upto")),
                )
            ),
        )
        .select(group, "n", "rank", value, "below", F.col("__n").alias("at"))
    )


def percentiles(values: DataFrame, group: str, value: str, probs: Sequence[float]) -> DataFrame:
    """Exact percentiles with linear interpolation: ``(group, prob, quantile)``.

    Same interpolation as ``percentile`` in Spark SQL, whose single merge
    buffer would hold every distinct value of a column.
    """
    grid = F.array(*[F.lit(float(p)) for p in probs])
    position = lambda p: p * (F.col("n") - 1)
    ranks = F.concat(
        F.transform(grid, lambda p: F.floor(position(p))),
        F.transform(grid, lambda p: F.ceil(position(p))),
    )
    found = locate(values, group, value, ranks)
    return (
        found.select("*", F.explode(grid).alias("prob"))
        .withColumn("__pos", F.col("prob") * (F.col("n") - 1))
        .where(
            (F.col("rank") == F.floor("__pos")) | (F.col("rank") == F.ceil("__pos"))
        )
        .groupBy(group, "prob")
        .agg(
            F.max(F.when(F.col("rank") == F.floor("__pos"), F.col(value))).alias("__lo"),
            F.max(F.when(F.col("rank") == F.ceil("__pos"), F.col(value))).alias("__hi"),
            F.first("__pos").alias("__pos"),
        )
        .select(
            group,
            "prob",
            (
                F.col("__lo").cast("double")
                + (F.col("__hi").cast("double") - F.col("__lo").cast("double"))
                * (F.col("__pos") - F.floor("__pos"))
            ).alias("quantile"),
        )
    )


def numbered_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Stack numeric columns into ``(pos, value)``; NaN counts as missing.

    The column's position and not its name travels through the shuffles; see
    :func:`name_at`.
    """
    cells = F.array(*[
        F.struct(F.lit(i).alias("pos"), F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias("value"))
        for i, c in enumerate(cols)
    ])
    return df.select(F.inline(cells)).where(F.col("value").isNotNull())


def name_at(cols: Sequence[str], pos: str = "pos") -> Column:
    return F.get(F.array(*[F.lit(c) for c in cols]), F.col(pos))


def column_percentiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Exact percentiles of several columns in one pass: ``(column, prob, quantile)``."""
    found = percentiles(numbered_values(df, cols), "pos", "value", probs)
    return found.select(name_at(cols).alias("column"), "prob", "quantile")


def percentile_map(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict:
    """The same as ``{column: [quantile, ...]}`` on the driver (columns x probs numbers)."""
    found = {
        (r["column"], r["prob"]): r["quantile"]
        for r in column_percentiles(df, cols, probs).collect()
    }
    return {c: [found.get((c, float(p))) for p in probs] for c in cols}


def rows_at_ranks(
    df: DataFrame, keys: Sequence[str], ranks: Sequence[int], first_key_is_day: bool = False
) -> list[list]:
    """Key values of the rows at 0-based ranks under ascending ``keys``, one list per rank.

    Works key by key for all ranks together: find the values of the first key
    at the ranks, keep the rows that share one of them, go on with the next
    key inside each. A list ends early where its values already single out a
    row. Keys must be numbers or dates without nulls. A first key that is a day
    has few distinct values, so it needs no ranges.
    """
    found: list[list] = [[] for _ in ranks]
    # open work: (position in ``ranks``, rank left inside the rows that share the values so far)
    open_ranks = {"": [(i, rank) for i, rank in enumerate(ranks)]}
    rest = df.select(F.lit("").alias("__path"), *keys)
    for depth, key in enumerate(keys):
        wanted = F.create_map(*[
            x
            for path, todo in open_ranks.items()
            for x in (F.lit(path), F.array(*[F.lit(rank).cast("bigint") for _, rank in todo]))
        ])
        cuts = {"": []} if depth == 0 and first_key_is_day else None
        hits = {
            (h["__path"], h["rank"]): h
            for h in locate(rest, "__path", key, F.element_at(wanted, F.col("__path")), cuts).collect()
        }
        deeper: dict[str, list] = {}
        for path, todo in open_ranks.items():
            for i, rank in todo:
                hit = hits.get((path, rank))
                if hit is None:
                    raise ValueError(f"rank {ranks[i]} is outside the data")
                found[i].append(hit[key])
                if hit["at"] > 1:
                    deeper.setdefault(f"{path}/{hit[key]}", []).append((i, rank - hit["below"]))
        open_ranks = deeper
        if not open_ranks or depth == len(keys) - 1:
            break
        kept = sorted({found[i][-1] for todo in open_ranks.values() for i, _ in todo})
        rest = (
            rest.where(F.col(key).isin(kept))
            .withColumn("__path", F.concat("__path", F.lit("/"), F.col(key).cast("string")))
            .where(F.col("__path").isin(list(open_ranks)))
        )
    return found


def at_or_before(keys: Sequence[str], bound: Sequence) -> Column:
    """Whether a row's keys sort at or before ``bound`` (which may be a prefix)."""
    last = len(bound) - 1
    result = F.col(keys[last]) <= F.lit(bound[last])
    for key, value in reversed(list(zip(keys[:last], bound[:last]))):
        result = (F.col(key) < F.lit(value)) | ((F.col(key) == F.lit(value)) & result)
    return result
