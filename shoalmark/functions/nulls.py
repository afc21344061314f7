"""Missing-value rules.

The assessment rules were written for a language in which a missing value
poisons sums, ``0/0`` is just another missing value and rounding is half to
even.  Every place where Spark's own rule gives another answer has a helper
here, so operators never have to remember which rule applies.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """NaN and the infinities count as missing."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def sum_or_zero(c: str | Column) -> Column:
    """Sum that skips missing values; all missing gives 0, not null."""
    return F.coalesce(F.sum(col(c)), F.lit(0.0))


def strict_sum(c: str | Column) -> Column:
    """Sum that is missing as soon as one value is missing."""
    c = col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.sum(c))


def strict_mean(c: str | Column) -> Column:
    """Mean that is missing as soon as one value is missing."""
    c = col(c)
    return F.when(F.count(c) == F.count(F.lit(1)), F.avg(c))


def ratio(a: str | Column, b: str | Column) -> Column:
    """Division whose undefined cases are null instead of an error."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def not_in(c: str | Column, values: Iterable) -> Column:
    """Exclude the listed values but keep rows where the value is missing."""
    return ~F.coalesce(col(c).isin(list(values)), F.lit(False))


def ifelse(cond: Column, yes, no) -> Column:
    """Conditional that stays missing where the condition is missing."""
    return F.when(cond.isNull(), F.lit(None)).when(cond, yes).otherwise(no)


def half_even(c: str | Column, digits: int = 0) -> Column:
    return F.bround(col(c), digits)


def first_present(preferred: str | Column, fallback: str | Column) -> Column:
    """``preferred`` unless it is missing or 0, which both mean "not recorded"."""
    preferred = col(preferred)
    return F.coalesce(F.when(preferred != 0, preferred), col(fallback))


def same_key(left: Column, right: Column) -> Column:
    """Key equality under which a missing key matches a missing key."""
    return left.eqNullSafe(right)
