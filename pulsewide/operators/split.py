"""Chronological splits and seeded samples.

A split is a filter on literal cut points found by distributed selection, so
the full rows are neither sorted nor shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsewide.functions import columns as C
from pulsewide.operators.ordering import at_or_before, rows_at_ranks

_DAY, _TIE, _ID = "__day", "__tie", "__id"
# day number below every real date, because rows without a date sort first
_NO_DATE = -1_000_000


def _order_keys(df: DataFrame, date_col: str, tie: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Add sortable keys: the day number, then the tie-break.

    A single integer tie column is used as it is. Anything else is hashed,
    which orders equal dates in an arbitrary but fixed way; equal hashes are
    told apart by a second hash.
    """
    day = F.coalesce(F.unix_date(F.col(date_col).cast("date")), F.lit(_NO_DATE))
    if len(tie) == 1 and df.schema[tie[0]].dataType.typeName() in ("long", "integer"):
        keyed = df.withColumns({_DAY: day, _TIE: F.col(tie[0])})
        return keyed, [_DAY, _TIE]
    keyed = df.withColumns({
        _DAY: day,
        _TIE: F.xxhash64(*tie),
        _ID: F.xxhash64(F.lit("second"), *tie),
    })
    return keyed, [_DAY, _TIE, _ID]


def _check(df: DataFrame, date_col: str, test_size: float | None = None) -> None:
    if test_size is not None and not 0.0 < test_size < 1.0:
        raise ValueError(f"no share between 0 and 1: {test_size!r}")
    if date_col not in df.columns:
        raise KeyError(f"no column '{date_col}' to order by")


def _first_rows(keyed: DataFrame, keys: Sequence[str], sizes: Sequence[int]) -> list[Column]:
    """For each size n, the condition that holds for the first n rows in key order."""
    some = [n for n in sizes if n > 0]
    if not some:
        return [F.lit(False) for _ in sizes]
    rows = rows_at_ranks(keyed, keys, [n - 1 for n in some], first_key_is_day=keys[0] == _DAY)
    bounds = dict(zip(some, rows))
    return [at_or_before(keys, bounds[n]) if n > 0 else F.lit(False) for n in sizes]


def oot_mark(df: DataFrame, date_col: str, tie: Sequence[str], test_size: float = 0.2, name: str = "is_train") -> DataFrame:
    """Mark the oldest ``int(n * (1 - test_size))`` rows; one scan of the rows.

    The row count and the cut day come from the counts by day, the cut inside
    that day from its rows alone.
    """
    _check(df, date_col, test_size)
    keyed, keys = _order_keys(df, date_col, tie)
    days = keyed.groupBy(_DAY).agg(F.count(F.lit(1)).alias("n")).orderBy(_DAY).collect()
    # Python arithmetic on purpose: the row count depends on its rounding
    left = int(sum(r["n"] for r in days) * (1.0 - test_size))
    last = None
    for r in days:
        if left < r["n"]:
            last = r[_DAY]
            break
        left -= r["n"]
    if last is None:
        is_train = F.lit(True)
    else:
        (inside,) = _first_rows(keyed.where(F.col(_DAY) == last), keys[1:], [left])
        is_train = (F.col(_DAY) < last) | ((F.col(_DAY) == last) & inside)
    return keyed.withColumn(name, is_train).drop(*keys)


def oot_split(
    df: DataFrame, date_col: str, tie: Sequence[str], test_size: float = 0.2
) -> tuple[DataFrame, DataFrame]:
    """Oldest ``int(n * (1 - test_size))`` rows as train, the others as test."""
    marked = oot_mark(df, date_col, tie, test_size, "__train")
    return marked.where("__train").drop("__train"), marked.where("not __train").drop("__train")


def expanding_folds(
    df: DataFrame, date_col: str, tie: Sequence[str], n_splits: int = 3, name: str = "fold"
) -> DataFrame:
    """Number the chronological blocks: 0 is only ever trained on, k is the k-th test block.

    Test blocks hold ``n // (n_splits + 1)`` rows each at the end of the order;
    the training rows of fold k are those with a smaller number.
    """
    _check(df, date_col)
    n = df.count()
    block = n // (n_splits + 1)
    if block == 0:
        raise ValueError(f"{n} rows are too few for {n_splits} folds")
    keyed, keys = _order_keys(df, date_col, tie)
    before = _first_rows(keyed, keys, [n - (n_splits - k) * block for k in range(n_splits)])
    fold = F.lit(n_splits)
    for k in reversed(range(n_splits)):
        fold = F.when(before[k], F.lit(k)).otherwise(fold)
    return keyed.withColumn(name, fold.cast("int")).drop(*keys)


def sample_rows(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows in the order of a seeded hash of the key.

    A top-k, so each task keeps ``n`` rows; for large ``n`` prefer
    :func:`sample_at_most`.
    """
    return df.orderBy(C.seeded_hash(seed, *map(F.col, key)), *key).limit(n)


def sample_at_most(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows like :func:`sample_rows`, as a filter instead of a sort.

    The hash of the n-th row is found by distributed selection; rows up to it
    are kept wherever they are. Of rows that share the last key, any are kept.
    """
    if df.count() <= n:
        return df
    keyed = df.withColumns({
        _TIE: C.seeded_hash(seed, *map(F.col, key)),
        _ID: C.seeded_hash(seed + 1, *map(F.col, key)),
    })
    (bound,) = rows_at_ranks(keyed, [_TIE, _ID], [n - 1])
    before = F.lit(False)
    if len(bound) == 2:
        # rows that share the last key, which a unique key has not
        level = (F.col(_TIE) == bound[0]) & (F.col(_ID) == bound[1])
        before = at_or_before([_TIE, _ID], bound) & ~level
        tied = keyed.where(level)
        inside = keyed.where(before).count()
        if inside + tied.count() > n:
            return keyed.where(before).unionByName(tied.limit(n - inside)).drop(_TIE, _ID)
    return keyed.where(at_or_before([_TIE, _ID], bound)).drop(_TIE, _ID)
