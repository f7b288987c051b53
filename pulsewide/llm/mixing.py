"""Mixing sources to target weights with histograms over hash thresholds.

Sizes are counted once and kept as a narrow table. A source's target comes from its
weight; what a document gives is ``whole`` repeats, the same for all of a source, and
one more if its hash lies below the source's threshold. The threshold is found without
sorting rows: sums by source and hash bucket, the first bucket whose running sum passes
the budget, then the same inside that bucket alone with the next bits, twice. What is cut at
the last level is one bucket of 2^-28 of the hash range, taken if that comes nearer.
Thresholds are nested: a larger budget takes a superset.

Weights go to the sources in the order of code points, null last, and repeat. A target
is capped at ``max_repeats`` times its source's size; what is above goes to the others
by weight until none is above, which is one level for all sources below their cap:
that level is computed directly from sources sorted by size over weight.

Defined cases: null and empty texts have size 0 and take 0; a source without words has
target 0; null is a source, apart from the empty string; rows of equal ``key`` are taken
or left together (a null key hashes as the empty string); a very long text counts by its
size like any other; an empty table gives none.
Histograms have at most 2^10 rows a source, whatever a source's size. Columns that have
an output's name are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsewide.llm.batches import quoted
from pulsewide.session import materialise

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Bits of the hash that a histogram resolves, level by level.
LEVELS = (10, 9, 9)
_BITS = sum(LEVELS)

OUTPUTS = ("size", "source_size", "target", "whole", "taken")


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("bigint")


def hash_of(key: Column) -> Column:
    """The first 28 bits of the key's MD5, which SQL engines share."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 7), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """``source``, ``source_size``, ``target`` from one row per source and size.

    The windows run over sources, not documents.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (number % len(weights) + 1).cast("int")).cast("bigint")
    weighed = by_source.select("source", "source_size", weight.alias("weight"), (max_repeats * F.col("source_size")).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    capped_before = F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    filled = weighed.withColumns({
        "budget": F.sum("source_size").over(everything) - capped_before,
        "share": weight_left,
    })
    # the first source whose cap reaches the level of those from it on sets the level
    level = F.min(F.when(F.col("budget") * F.col("weight") <= F.col("cap") * F.col("share"),
                         F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("budget").alias("budget"), F.col("share").alias("share")))).over(everything)
    return filled.withColumn("level", level).select(
        "source", "source_size",
        F.when(F.col("cap") * F.col("level.share") < F.col("level.budget") * F.col("weight"), F.col("cap").cast("double"))
        .otherwise((F.col("level.budget") * F.col("weight")).cast("double") / F.col("level.share").cast("double"))
        .alias("target"),
    )


def _boundary(rows: DataFrame, bounds: DataFrame, level: int) -> DataFrame:
    """Refine each source's boundary bucket by the next bits of the hash.

    ``bounds`` has, by source, the prefix refined so far, what lies below it and the
    budget. The join is against one row a source.
    """
    shift = _BITS - sum(LEVELS[: level + 1])
    bucket = F.shiftright("hash", shift)
    inside = rows
    if level:
        keyed = bounds.select(F.col("source").alias("b_source"), "prefix")
        inside = rows.join(
            keyed,
            F.col("source").eqNullSafe(F.col("b_source")) & (F.shiftright("hash", shift + LEVELS[level]) == F.col("prefix")),
        )
    sums = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
    below = bounds.select(F.col("source").alias("b_source"), "budget", "below")
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cumulated = (
        sums.join(below, F.col("source").eqNullSafe(F.col("b_source")))
        .withColumn("through", F.col("below") + F.sum("size").over(running))
    )
    hit = F.struct("bucket", (F.col("through") - F.col("size")).alias("below"), "through")
    return cumulated.groupBy("source").agg(
        F.first("budget").alias("budget"),
        F.min(F.when(F.col("through") > F.col("budget"), hit)).alias("hit"),
        F.max("through").alias("all"),
    ).select(
        "source", "budget", F.coalesce("hit.bucket", F.lit(1 << (_BITS - shift)).cast("bigint")).alias("prefix"),
        F.coalesce("hit.below", "all").alias("below"), F.col("hit.through").alias("through"),
    )


def mix(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Documents with ``size``, ``source_size``, ``target``, ``whole`` and ``taken``.

    ``taken`` is the document's size times its repeats, of which there are ``whole``
    or one more.
    """
    rows = materialise(docs.select(
        quoted(source).cast("string").alias("source"), hash_of(quoted(key)).alias("hash"), word_count(quoted(text)).alias("size")
    ))
    aims = targets(rows, weights, max_repeats)
    aims = aims.withColumns({
        "whole": F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint"),
    }).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size"))
    aims = materialise(aims)
    bounds = aims.select("source", "budget", F.lit(0).cast("bigint").alias("prefix"), F.lit(0).cast("bigint").alias("below"))
    for level in range(len(LEVELS)):
        bounds = materialise(_boundary(rows, bounds, level))
    last = F.when(F.col("through") - F.col("budget") < F.col("budget") - F.col("below"), F.col("prefix") + 1).otherwise(F.col("prefix"))
    plan = aims.join(
        bounds.select(F.col("source").alias("b_source"), last.alias("threshold")),
        F.col("source").eqNullSafe(F.col("b_source")), "left",
    ).select(F.col("source").alias("p_source"), "source_size", "target", "whole", F.coalesce("threshold", F.lit(0)).alias("threshold"))
    keep = [c for c in (docs.columns if carry is None else carry) if c not in OUTPUTS]
    out = docs.select(
        F.struct(*[quoted(c) for c in keep]).alias("row"), quoted(source).cast("string").alias("source"),
        hash_of(quoted(key)).alias("hash"), word_count(quoted(text)).alias("size"),
    ).join(plan, F.col("source").eqNullSafe(F.col("p_source")))
    repeats = F.col("whole") + F.when(F.col("hash") < F.col("threshold"), 1).otherwise(0)
    return out.select("row.*", "size", "source_size", "target", "whole", (F.col("size") * repeats).alias("taken"))
