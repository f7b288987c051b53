"""Column expressions: lenient parsing, labels, tokens, names, guarded arithmetic.

ANSI mode stays on; every conversion that may meet bad text is a ``try_`` form.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsewide import schema as S

# Plain decimal text. Spark's own cast also takes '1.5f', '1d', padded text and
# 'inf', which a lenient reader of driver values must treat as missing.
_DECIMAL = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_INTEGER = r"^[+-]?[0-9]+$"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def to_float(c: Column) -> Column:
    """Text to float; anything that is not a finite decimal becomes NULL."""
    parsed = F.when(c.rlike(_DECIMAL), c.try_cast("float"))
    return F.when(F.abs(parsed) < F.lit(float("inf")), parsed)


def to_tiny(c: Column) -> Column:
    return F.when(c.rlike(_INTEGER), c.try_cast("tinyint"))


def to_date(c: Column) -> Column:
    """Date from the first ten characters; a trailing time or zone is ignored."""
    return F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")


def to_driver_type(c: Column, data_type: str | None) -> Column:
    """Typed driver value; a driver without a known type stays untouched text."""
    if data_type == S.NUMERIC:
        return to_float(blank_to_null(c))
    if data_type in (S.CATEGORICAL, S.MULTI_CATEGORICAL):
        return blank_to_null(c)
    return c


def score_class(score: Column) -> Column:
    """Survey score to class code; any other score, or none, is the unknown class."""
    result = F.lit(S.UNKNOWN_CLASS)
    for value, code in S.SCORE_TO_CLASS.items():
        result = F.when(score == value, F.lit(code)).otherwise(result)
    return result.cast("tinyint")


def severe_flag(duration: Column, threshold: float = S.SEVERE_THRESHOLD) -> Column:
    """1 above the threshold, 0 at or below it, NULL where nothing was recorded."""
    return (duration > F.lit(threshold)).cast("tinyint")


def is_detractor(class_col: Column) -> Column:
    return F.coalesce(class_col == S.DETRACTOR, F.lit(False)).cast("tinyint")


def decide(probability: Column, threshold: float) -> Column:
    return (probability >= F.lit(threshold)).cast("int")


def any_not_null(cols: Sequence[str]) -> Column:
    """Whether at least one of the columns holds a value."""
    return functools.reduce(operator.or_, [F.col(c).isNotNull() for c in cols], F.lit(False))


def guarded_ratio(a: Column, b: Column, fallback: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(fallback))


def expected_score(p_promoter: Column, p_detractor: Column) -> Column:
    return (p_promoter - p_detractor) * 100.0


# --- tokens -----------------------------------------------------------------


def tokens(c: Column) -> Column:
    """Non-empty tokens of a ``||``-separated cell; NULL becomes one sentinel token."""
    raw = F.split(F.coalesce(c, F.lit(S.NULL_TOKEN)), r"\|\|")
    stripped = F.transform(raw, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.filter(stripped, lambda x: x != "")


def sanitise(token: Column) -> Column:
    """Token as a column-name part."""
    cleaned = F.regexp_replace(token, r"[^0-9A-Za-z]+", "_")
    return F.coalesce(F.nullif(F.trim(cleaned, F.lit("_")), F.lit("")), F.lit(S.UNNAMED_TOKEN))


# --- display ----------------------------------------------------------------


def replace_all(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    for search, replacement in rules:
        c = F.replace(c, F.lit(search), F.lit(replacement))
    return c


def short_name(c: Column) -> Column:
    return F.trim(replace_all(c, S.SHORT_NAME_RULES))


def short_label(c: Column) -> Column:
    return F.substring(replace_all(c, S.SHORT_LABEL_RULES), 1, S.SHORT_LABEL_WIDTH)


def labels_for(codes: Sequence[int]) -> dict[int, str]:
    """Names of a set of class codes; an unknown set is numbered."""
    for known in (S.MULTI_LABELS, S.BINARY_LABELS):
        if set(codes) == set(known):
            return known
    return {code: f"Class {code}" for code in codes}


def label_of(c: Column, labels: Mapping[int, str]) -> Column:
    result = F.lit(None).cast("string")
    for code, name in labels.items():
        result = F.when(c == code, F.lit(name)).otherwise(result)
    return result


def interval_label(lo: Column, hi: Column, unit: str = "min") -> Column:
    return F.format_string(f"%.0f–%.0f {unit}", lo, hi)


def seeded_hash(seed: int, *key: Column) -> Column:
    """A number below 2^60 from a seed and a row's key, from MD5, which SQL engines share."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("")) for k in key])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")
