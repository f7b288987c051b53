"""Attribute-value rows to one typed row per customer, and the active-entity join."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsewide import schema as S
from pulsewide.functions import columns as C
from pulsewide.operators.salting import join_distinct


def index_columns(df: DataFrame, candidates: Sequence[str] | None = None) -> list[str]:
    """Index of the pivot: the id columns, plus the score where there is one."""
    wanted = candidates or [*S.ID_COLS, S.SCORE_COL]
    return [c for c in wanted if c in df.columns]


def pivot_first(
    eav: DataFrame,
    types: Mapping[str, str | None],
    index: Sequence[str],
    ordinal: str = "ord",
    key: str = S.KEY_COL,
    value: str = S.VALUE_COL,
    extra_keys: Sequence[str] = (),
) -> DataFrame:
    """One row per index tuple, one column per driver, holding the first value.

    "First" is by ``ordinal``; an empty or missing first value is kept as NULL
    and not replaced by a later one. Values are converted before the
    aggregation: a numeric driver then has a fixed-width buffer, and a pivot of
    numeric drivers only is one hash aggregation with a map-side step, which
    also folds repeated rows of a hot customer before the shuffle. Naming the
    keys avoids the extra job that looks for them. A column not selected later
    is never computed.
    """
    plan = {**dict(types), **{k: None for k in extra_keys if k not in types}}

    def first(name: str, data_type: str | None) -> Column:
        mine = F.col(key) == F.lit(name)
        typed = C.to_driver_type(F.col(value), data_type)
        return F.min_by(F.when(mine, typed), F.when(mine, F.col(ordinal))).alias(name)

    return eav.groupBy(*index).agg(*[first(k, t) for k, t in plan.items()])


def type_meta(wide: DataFrame, date_col: str = "npsDate", score_col: str = S.SCORE_COL) -> DataFrame:
    """Parse the date and, where present, the score of a wide table."""
    changed = {date_col: C.to_date(F.col(date_col))}
    if score_col in wide.columns:
        changed[score_col] = C.to_tiny(F.col(score_col))
    return wide.withColumns(changed)


def with_class(wide: DataFrame, score_col: str = S.SCORE_COL, name: str = S.CLASS_COL) -> DataFrame:
    return wide.withColumn(name, C.score_class(F.col(score_col)))


def add_severe_flag(
    df: DataFrame,
    threshold: float = S.SEVERE_THRESHOLD,
    source: str = S.DELAY_COL,
    name: str = S.SEVERE_FLAG_COL,
) -> DataFrame:
    if source not in df.columns:
        raise KeyError(f"column '{source}' is needed for the severity flag")
    return df.withColumn(name, C.severe_flag(F.col(source), threshold))


def cast_drivers(wide: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Type the text columns of an already wide table; other columns stay as they are."""
    return wide.select(*[
        C.to_driver_type(F.col(c), types.get(c)).alias(c) if c in types else F.col(c)
        for c in wide.columns
    ])


def extra_keys(eav: DataFrame, known: Sequence[str], key: str = S.KEY_COL, most: int = 1000) -> list[str]:
    """Attribute names in the data but not in the definitions; more than ``most`` are an error,
    because each becomes a column."""
    found = eav.select(key).where(~F.col(key).isin(list(known))).distinct().orderBy(key).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"more than {most} attributes are not in the definitions")
    return [r[0] for r in found]


def load_wide(
    eav: DataFrame,
    types: Mapping[str, str],
    ordinal: str = "ord",
    keep_unknown: bool = False,
) -> DataFrame:
    """Raw attribute-value rows to the typed wide table."""
    more = extra_keys(eav, list(types)) if keep_unknown else ()
    index = index_columns(eav)
    return type_meta(pivot_first(eav, types, index, ordinal, extra_keys=more))


def active_history(
    eav: DataFrame,
    active_key: str = S.DELAY_COL,
    entity: str = "sourceId",
    key: str = S.KEY_COL,
    value: str = S.VALUE_COL,
) -> DataFrame:
    """Full history of the entities that have a value for ``active_key``.

    Pass one reads the filtered attribute only and reduces it to distinct ids;
    pass two is a left-semi join, so no row is multiplied. The join is salted,
    because one entity may hold a large share of all rows.
    """
    active = (
        eav.where((F.col(key) == active_key) & (F.col(value) != ""))
        .select(entity)
        .distinct()
    )
    return join_distinct(eav, active, entity).select(*eav.columns)
