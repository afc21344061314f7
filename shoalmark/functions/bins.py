"""Binning of depths and lengths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nulls import col


def right_closed_bin(c: str | Column, width: float = 50, top: float = 1100) -> Column:
    """Lower edge of the ``(lower, lower + width]`` bin; null outside ``(0, top]``."""
    c = col(c)
    return F.when((c > 0) & (c <= top), F.ceil(c / width) * width - width).cast("int")


def unit_bin(c: str | Column, width: float = 1.0) -> Column:
    """Centre of the bin of ``width`` that has its centre on a multiple of it.

    A value half way between two centres falls in the lower bin, as bins are
    closed on the right.
    """
    c = col(c)
    return F.ceil(c / width - 0.5) * F.lit(width)


def threshold_label(c: str | Column, classes: list[tuple[float, str]], last: str) -> Column:
    """Label of the first class whose upper bound exceeds the value."""
    c = col(c)
    out = F.when(c.isNull(), F.lit(None).cast("string"))
    for below, label in classes:
        out = out.when(c < below, F.lit(label))
    return out.otherwise(F.lit(last))
