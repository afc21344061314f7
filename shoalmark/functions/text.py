"""Report text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col, half_even


def estimate_with_cv(estimate: str | Column, cv: str | Column) -> Column:
    """``5,941 (0.250)``; null when there is no estimate."""
    estimate, cv = col(estimate), col(cv)
    body = F.concat(
        F.format_number(half_even(estimate), 0),
        F.lit(" ("),
        F.when(cv.isNull(), "NA").otherwise(F.format_string("%.3f", half_even(cv, 3))),
        F.lit(")"),
    )
    return F.when(estimate.isNotNull(), body)


def one_decimal(c: str | Column, prefix: str = "", suffix: str = "") -> Column:
    """Value with one decimal place and fixed text around it."""
    c = col(c)
    return F.when(c.isNotNull(), F.concat(F.lit(prefix), F.format_string("%.1f", half_even(c, 1)), F.lit(suffix)))
