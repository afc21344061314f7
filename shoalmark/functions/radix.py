"""Exact quantiles of few, very large groups by radix selection.

A double is cut into digits in the order of its value: sign, exponent and ten
bits of the mantissa, then 21 bits, then the rest.  A histogram of the first
digit tells which of its bins hold the wanted positions, a histogram of the
second digit inside those bins narrows them further, and only the values of the
bins that are left are fetched.  Rows are read three times and never shuffled,
only counts and the few fetched values are.  Nothing is sampled, and no task
sees more than the bins of a group or the values of one bin.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import checked_broadcast


def with_digits(df: DataFrame, value: str) -> DataFrame:
    """Add ``_d1`` and ``_d2``, the first two digits of a double: ``(d1, d2)`` never falls when the value grows.

    Infinite values and NaN, which sorts last, have bins of their own.
    """
    size = f"abs({value})"
    power = "pow(2D, _e)"
    # The logarithm may be off by one next to a power of two; dividing by the power tells, and is exact.
    return (
        df.withColumn("_e", F.expr(f"CAST(CASE WHEN {value} = 0 OR {size} = double('Infinity') OR isnan({value}) THEN 0 ELSE greatest(floor(log2({size})), -1074) END AS INT)"))
        .withColumn("_e", F.expr(f"_e + CASE WHEN {size} / {power} >= 2 THEN 1 WHEN {size} / {power} < 1 AND _e > -1074 THEN -1 ELSE 0 END"))
        .withColumn("_f", F.expr(f"({size} / {power} - 1) * 1024"))
        .withColumn("_s", F.expr(f"CASE WHEN {value} < 0 THEN -1 ELSE 1 END"))
        .withColumn(
            "_d1",
            F.expr(
                f"CASE WHEN isnan({value}) THEN 4000001 WHEN {size} = double('Infinity') THEN _s * 4000000 WHEN {value} = 0 THEN 0 "
                "ELSE _s * CAST((_e + 1075) * 1024 + 1 + floor(_f) AS INT) END"
            ),
        )
        .withColumn("_d2", F.expr(f"CASE WHEN {value} = 0 OR abs(_d1) >= 4000000 THEN 0 ELSE _s * CAST(floor((_f - floor(_f)) * 2097152) AS INT) END"))
        .drop("_e", "_f", "_s")
    )


def neighbours_in(grid: Column, n: Column, start: Column, end: Column) -> Column:
    """Probabilities of ``grid`` with a neighbour position, of ``n`` in all, inside ``[start, end)``."""
    return F.filter(grid, lambda p: (F.floor(p * (n - 1)) < end) & (F.ceil(p * (n - 1)) >= start))


def interpolated(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys, prob, n, q`` from values ``_v`` that hold the places ``_first`` on, ``_w`` of them, each with ``_ps`` and ``_n``."""
    last = F.col("_first") + F.col("_w") - 1
    rows = (
        hits.withColumn("prob", F.explode("_ps"))
        .withColumn("_h", F.col("prob") * (F.col("_n") - 1))
        .withColumn("_lo", F.floor("_h").between(F.col("_first"), last))
        .withColumn("_hi", F.ceil("_h").between(F.col("_first"), last))
        .where("_lo or _hi")
    )
    low, high = F.max(F.when(F.col("_lo"), F.col("_v"))), F.max(F.when(F.col("_hi"), F.col("_v")))
    part = F.max(F.col("_h") - F.floor("_h"))
    # Neighbours that are equal need no step between them, which would be undefined for infinite ones.
    q = F.when(low == high, low).otherwise(low + (high - low) * part)
    return rows.groupBy(*keys, "prob").agg(F.max("_n").alias("n"), q.alias("q"))


def radix_quantiles(vals: DataFrame, grid: Column) -> DataFrame:
    """``_g, prob, n, q`` of rows ``_g, _v, _w`` (group, double, whole-number frequency)."""
    digits = with_digits(vals, "_v")

    def narrowed(counts: DataFrame, parents: list[str], digit: str, total: Column, before: Column, extra: list[str]) -> DataFrame:
        """Bins that hold a wanted position, with the number of values before them."""
        upto = Window.partitionBy(*parents).orderBy(digit).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        start = before + F.sum("_bw").over(upto) - F.col("_bw")
        return (
            counts.withColumn("_total", total)
            .withColumn("_start", start)
            .withColumn("_ps", neighbours_in(grid, F.col("_total"), F.col("_start"), F.col("_start") + F.col("_bw")))
            .where(F.size("_ps") > 0)
            .select(*parents, digit, F.col("_total").alias("_n"), "_start", "_ps", *extra)
        )

    first = digits.groupBy("_g", "_d1").agg(F.sum("_w").alias("_bw"))
    hit1 = narrowed(first, ["_g"], "_d1", F.sum("_bw").over(Window.partitionBy("_g")), F.lit(0), [])
    inside = digits.join(checked_broadcast(hit1.select("_g", "_d1", "_n", "_start")), ["_g", "_d1"])
    second = inside.groupBy("_g", "_d1", "_d2").agg(F.sum("_w").alias("_bw"), F.first("_n").alias("_n"), F.first("_start").alias("_before"))
    hit2 = narrowed(second, ["_g", "_d1"], "_d2", F.col("_n"), F.col("_before"), [])
    fetched = digits.join(checked_broadcast(hit2), ["_g", "_d1", "_d2"])
    # Equal values collapse before they travel.
    values = fetched.groupBy("_g", "_d1", "_d2", "_v").agg(*[F.first(c).alias(c) for c in ("_n", "_start", "_ps")], F.sum("_w").alias("_w"))
    earlier = Window.partitionBy("_g", "_d1", "_d2").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    placed = values.withColumn("_first", F.col("_start") + F.coalesce(F.sum("_w").over(earlier), F.lit(0)))
    return interpolated(placed, ["_g"])
