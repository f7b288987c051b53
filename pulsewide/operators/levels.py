"""Text columns with any number of levels as numbers: ordered target statistics.

A level becomes, for each class but the first, the share of that class among the rows of
the level, drawn towards a fixed prior. A training row sees the rows before it in time only,
so it never sees its own label, and folds by time stay apart; a new row sees all training
rows. Levels stay in a table, from fit to scoring: nothing per level comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsewide.operators.running import running
from pulsewide.operators.salting import join_distinct
from pulsewide.session import materialise

#: Rows that the prior counts for.
PRIOR_ROWS = 1.0
_LEVEL, _SEEN = "__level", "__seen"


@dataclass(frozen=True)
class WideText:
    """A text column, the classes that have a share, and the table of its levels' counts."""

    column: str
    classes: tuple[int, ...]
    levels: DataFrame

    @property
    def outputs(self) -> list[str]:
        return [f"__share_{self.column}_{k}" for k in self.classes]

    @property
    def prior(self) -> float:
        return 1.0 / (len(self.classes) + 1)


def _level(column: str) -> Column:
    """Null is a level of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{column}`")), F.lit(""))


def _counts(k: int) -> str:
    return f"__class_{k}"


def _share(wide: WideText, k: int) -> Column:
    seen, of_class = (F.coalesce(F.col(c), F.lit(0)) for c in (_SEEN, _counts(k)))
    return (of_class + wide.prior * PRIOR_ROWS) / (seen + PRIOR_ROWS)


def fit_wide_text(df: DataFrame, column: str, label: str, classes: Sequence[int]) -> WideText:
    """Counts of rows and of each class but the first, by level, over all of ``df``."""
    later = tuple(sorted(classes))[1:]
    levels = df.groupBy(_level(column).alias(_LEVEL)).agg(
        F.count(F.lit(1)).alias(_SEEN), *[F.count_if(F.col(label) == k).alias(_counts(k)) for k in later])
    return WideText(column, later, materialise(levels))


def encode_new(df: DataFrame, wide: WideText) -> DataFrame:
    """Add the shares over all training rows; a level they do not have gets the prior."""
    held = join_distinct(df.withColumn(_LEVEL, _level(wide.column)), wide.levels, _LEVEL, "left")
    shares = {o: _share(wide, k) for o, k in zip(wide.outputs, wide.classes)}
    return held.withColumns(shares).select(*df.columns, *wide.outputs)


def encode_ordered(df: DataFrame, wide: WideText, label: str, order: Sequence[str]) -> DataFrame:
    """Add the shares over the rows of the level that come before, by ``order``."""
    own = {_counts(k): (F.col(label) == k).cast("bigint") for k in wide.classes}
    kept = {f"__own_{k}": (F.col(label) == k).cast("bigint") for k in wide.classes}
    keys = {f"__order_{i}": F.col(c) for i, c in enumerate(order)}
    rows = df.withColumns({_LEVEL: _level(wide.column), _SEEN: F.lit(1).cast("bigint"), **own, **kept, **keys})
    total = running(rows, _LEVEL, list(keys), adds=[_SEEN, *own])
    before = total.withColumns({
        _SEEN: F.col(_SEEN) - 1, **{_counts(k): F.col(_counts(k)) - F.col(f"__own_{k}") for k in wide.classes}})
    shares = {o: _share(wide, k) for o, k in zip(wide.outputs, wide.classes)}
    return before.withColumns(shares).select(*df.columns, *wide.outputs)
