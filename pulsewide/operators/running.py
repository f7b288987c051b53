"""Running totals inside many groups, of which one may hold most rows.

Rows are sorted over all groups together, in ranges; every range adds up its own rows, and
a group that goes on in the next range takes its total along. So neither a group nor a
value is one task's work, and what comes to the driver is one row for each range.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsewide.session import materialise

_PART, _AT, _OFFSET = "__part", "__at", "__offset_"


def running(
    df: DataFrame, group: str, order: Sequence[str], adds: Sequence[str] = (), xors: Sequence[str] = ()
) -> DataFrame:
    """``df`` with its measures, whole numbers, replaced by inclusive running sums (``adds``)
    or exclusive ors (``xors``) within ``group``, in the order of the columns ``order``.

    The group must not be null. Rows equal in group and order are taken in any order; the
    result is written, so that all its readers see the same one. The order columns go.
    """
    measures = [*adds, *xors]
    others = [c for c in df.columns if c not in (group, *order, *measures)]
    schema = T.StructType([
        T.StructField(_PART, T.IntegerType()), T.StructField(_AT, T.LongType()), T.StructField(group, df.schema[group].dataType),
        *[T.StructField(m, T.LongType()) for m in measures], *[df.schema[c] for c in others],
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, [0] * (len(measures) + 1)
        for b in batches:
            if not len(b):
                continue
            groups = b.column(1)
            new = np.ones(len(b), bool)
            new[1:] = pc.not_equal(groups[1:], groups[:-1]).to_numpy(zero_copy_only=False)
            new[0] = last is None or groups[0].as_py() != last
            starts = np.flatnonzero(new)
            of = np.cumsum(new) - 1  # -1 while the group of the last batch goes on
            totals = []
            values = [np.ones(len(b), np.int64), *[b.column(2 + i).to_numpy() for i in range(len(measures))]]
            for k, v in enumerate(values):
                xor = k > len(adds)
                whole = np.bitwise_xor.accumulate(v) if xor else np.cumsum(v)
                before = (whole ^ v if xor else whole - v)[starts]  # taken back from each group that starts here
                base = np.append(before, carried[k] if xor else -carried[k])[of]
                total = whole ^ base if xor else whole - base
                carried[k] = int(total[-1])
                totals.append(pa.array(total))
            last = groups[-1].as_py()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), totals[0], groups, *totals[1:], *b.columns[2 + len(measures) :]], names=schema.names)

    ranged = materialise(
        df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
        .select(F.spark_partition_id().alias(_PART), group, *[F.col(m).cast("bigint").alias(m) for m in measures], *others)
        .mapInArrow(run, schema)
    )
    ends = ranged.groupBy(_PART).agg(
        F.min(group).alias("first"), F.max(group).alias("last"),
        F.max_by(F.struct(*measures), F.struct(group, _AT)).alias("totals")).orderBy(_PART).collect()
    offsets, open_group, open_totals = [], None, []
    for e in ends:
        own = [e["totals"][m] for m in measures]
        if open_totals and e["first"] == open_group:
            offsets.append((e[_PART], e["first"], *open_totals))
            if e["last"] == open_group:
                own = [x + y if k < len(adds) else x ^ y for k, (x, y) in enumerate(zip(own, open_totals))]
        open_group, open_totals = e["last"], own
    if not offsets:
        return ranged.drop(_PART, _AT)
    kinds = [T.StructField(_PART, T.IntegerType()), ranged.schema[group]]
    listed = df.sparkSession.createDataFrame(offsets, T.StructType(kinds + [T.StructField(_OFFSET + m, T.LongType()) for m in measures]))

    def moved(m: str) -> Column:
        offset = F.coalesce(F.col(_OFFSET + m), F.lit(0))
        return (F.col(m) + offset if m in adds else F.col(m).bitwiseXOR(offset)).alias(m)

    # fewer rows than ranges
    return ranged.join(F.broadcast(listed), [_PART, group], "left").select(group, *[moved(m) for m in measures], *others)
