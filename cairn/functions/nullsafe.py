"""Null rules in one place. Every flag, clip and ratio of the library is written with these.

Two kinds of flag exist: a *known* flag is null where its input is null, so that shares divide by the rows where it is
known; a *plain* flag is 0 there, so that shares divide by all rows. ``greatest`` and ``least`` skip nulls and would
turn a missing value into the bound, so clips are conditionals.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_ratio(n: Column, d: Column) -> Column:
    """n / d where d is positive, else null."""
    return F.when(d > 0, n / d)


def clip_low(x: Column, low: float = 0.0) -> Column:
    return F.when(x < low, F.lit(low)).otherwise(x)


def clip_high(x: Column, high: float) -> Column:
    return F.when(x > high, F.lit(high)).otherwise(x)


def known_flag(condition: Column) -> Column:
    """1 or 0; null where the condition is unknown."""
    return condition.cast("int")


def plain_flag(condition: Column) -> Column:
    """1 or 0; 0 where the condition is unknown."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def flag_where(mask: Column, condition: Column) -> Column:
    """A plain flag on the rows of ``mask``, null elsewhere."""
    return F.when(mask, plain_flag(condition))


def keep_where(condition: Column, x: Column) -> Column:
    return F.when(condition, x)


def is_one_of(c: Column, *levels: str) -> Column:
    """A plain flag for string levels; a missing level is no level."""
    return plain_flag(c.isin(*levels))


def value_if(state: Column, x: Column, otherwise: float = 0.0) -> Column:
    """x where the 0/1 state is 1, ``otherwise`` where it is 0, null where it is unknown."""
    return F.when(state.isNull(), F.lit(None)).when(state == 1, x).otherwise(F.lit(otherwise))


def level_map(c: Column, mapping: dict, default) -> Column:
    """The mapped value of a level; ``default`` for missing and unlisted levels."""
    first, *rest = mapping.items()
    out = reduce(lambda acc, kv: acc.when(c == F.lit(kv[0]), F.lit(kv[1])), rest, F.when(c == F.lit(first[0]), F.lit(first[1])))
    return out.otherwise(F.lit(default))


def without_sentinel(x: Column, sentinel) -> Column:
    """Null where x is the sentinel."""
    return F.when(x != sentinel, x)


def sum_or_zero(x: Column) -> Column:
    return F.coalesce(F.sum(x), F.lit(0))


def latest(value: Column, by: Column, tie: Column | None = None) -> Column:
    """Aggregate: the value, null or not, of the row with the largest ``by``; among equals the smallest ``tie``."""
    order = F.struct(by, -tie) if tie is not None else by
    return F.max_by(value, F.when(by.isNotNull(), order))


def clipped_logit(p: Column, eps: float = 1e-12) -> Column:
    q = clip_high(clip_low(p, eps), 1 - eps)
    return F.log(q / (1 - q))


#: Texts that mean a missing value in delimited files.
MISSING_TEXTS = ("", "#N/A", "#NA", "-nan", "-NaN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def canonical_missing(df: DataFrame) -> DataFrame:
    """NaN, and in strings the usual missing texts, become null."""
    out = {}
    for c, kind in df.dtypes:
        if kind in ("double", "float"):
            out[c] = F.when(~F.isnan(c), F.col(c))
        elif kind == "string":
            out[c] = F.when(~F.trim(c).isin(*MISSING_TEXTS), F.col(c))
    return df.withColumns(out) if out else df
