"""Frequency-weighted length compositions.

A length table holds one row per (place, length) with a frequency.  Nothing is
expanded to one row per fish: every statistic is computed with the frequency as
weight, on rows already summed to (key, length).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import threshold_label, unit_bin
from ..functions.joins import null_safe_join, salted_join
from ..functions.nulls import first_present, ratio, strict_sum, sum_or_zero
from ..functions.ranking import exact_quantiles
from ..sources.lookups import DEEPEST_CLASS, DEPTH_CLASSES, FISHERY_GEARS, TRAWL_AREAS, StrataScheme, recode
from .index import assign_strata


def null_outliers(df: DataFrame, corrections: Sequence[dict], column: str) -> DataFrame:
    """Blank ``column`` in the rows that match one of the known-bad cells, given as column -> value."""
    bad = F.lit(False)
    for cell in corrections:
        hit = F.lit(True)
        for name, v in cell.items():
            hit = hit & F.col(name).eqNullSafe(F.lit(v))
        bad = bad | hit
    return df.withColumn(column, F.when(~bad, F.col(column)))


def expand_by_frequency(df: DataFrame, freq: str, block: int = 4096) -> DataFrame:
    """Repeat each row ``freq`` times; rows with frequency 0 or none disappear.

    For output that must be one row per fish.  The repetition goes in two steps
    of at most ``block`` (or freq / block) elements, so a single huge frequency
    does not build a huge array.
    """
    n = F.col(freq).cast("long")
    return (
        df.where(n > 0)
        .withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / block).cast("long"))))
        .withColumn("_i", F.explode(F.array_repeat(F.lit(1), F.least(F.lit(block), n - F.col("_b") * block).cast("int"))))
        .drop("_b", "_i")
    )


def weighted_mean(df: DataFrame, by: Sequence[str], value: str = "length", weight: str = "freq") -> DataFrame:
    """``total`` weight and weighted ``mean`` per group, in one aggregation."""
    w, x = F.col(weight), F.col(value)
    return (
        df.groupBy(*by)
        .agg(F.sum(w).alias("total"), F.sum(w * x).alias("_wx"))
        .withColumn("mean", ratio("_wx", "total"))
        .drop("_wx")
    )


def length_comp(
    df: DataFrame, by: Sequence[str], length: str = "length", freq: str = "freq", strict: bool = False
) -> DataFrame:
    """``by..., length, freq, total, mean``: summed frequencies with the group's total and mean length.

    ``strict`` makes a sum with a missing frequency missing; otherwise missing
    frequencies are skipped.  The window runs over the summed rows, one per
    distinct length of a group.
    """
    total = strict_sum(freq) if strict else sum_or_zero(freq)
    comp = df.groupBy(*by, F.col(length).alias("length")).agg(total.alias("freq"))
    group = Window.partitionBy(*by)

    def whole(c: Column) -> Column:
        """Group sum that is missing if any part is, as a missing frequency makes the mean unknown."""
        return F.when(F.count(c).over(group) == F.count(F.lit(1)).over(group), F.sum(c).over(group))

    return (
        comp.withColumn("total", whole(F.col("freq")))
        .withColumn("_wx", whole(F.col("freq") * F.col("length")))
        .withColumn("mean", ratio("_wx", "total"))
        .drop("_wx")
    )


def length_comp_by_year(df: DataFrame, by: Sequence[str] = (), **kw) -> DataFrame:
    return length_comp(df, [*by, "year"], **kw)


def length_comp_by_stratum(df: DataFrame, scheme: StrataScheme, by: Sequence[str] = (), **kw) -> DataFrame:
    return length_comp(assign_strata(df, scheme), [*by, "strata"], **kw)


def length_comp_overall(surveys: dict[str, DataFrame], strict: Iterable[str] = ()) -> DataFrame:
    """Composition of each whole survey, stacked: ``survey, length, freq, total, mean``."""
    strict = set(strict)
    out = None
    for name, df in surveys.items():
        part = length_comp(df.withColumn("survey", F.lit(name)), ["survey"], strict=name in strict)
        out = part if out is None else out.unionByName(part)
    return out


def fishery_lengths(
    df: DataFrame,
    gears: dict = FISHERY_GEARS,
    above: int = 609,
    below: int = 651,
    excluded_area: int = 649,
) -> DataFrame:
    """Fishery lengths of the listed gears inside the area-code window, gear as text."""
    area = F.col("nmfs_area")
    return df.where(
        F.col("gear").isin(list(gears)) & (area > above) & (area < below) & (area != excluded_area)
    ).withColumn("gear", recode("gear", gears))


def fishery_length_comp(df: DataFrame, freq: str = "frequency") -> DataFrame:
    """By gear and year, and by gear over all years, in one table; ``year`` is null for all years.

    The second grain is summed from the first, so the rows are read once.
    ``total`` is the number of fish of the gear (and year).
    """
    fine = df.groupBy("gear", "year", F.col("length")).agg(strict_sum(freq).alias("freq"))
    both = fine.withColumn("_grain", F.explode(F.array(F.lit("gear_year"), F.lit("gear")))).withColumn(
        "year", F.when(F.col("_grain") == "gear_year", F.col("year"))
    )
    comp = length_comp(both, ["_grain", "gear", "year"], strict=True)
    return comp.withColumnRenamed("_grain", "grain")


def length_density(
    comp: DataFrame,
    by: Sequence[str],
    width: float = 1.0,
    lo: float | None = None,
    hi: float | None = None,
) -> DataFrame:
    """Weighted density per length bin and facet; it sums to 1 / width.  Lengths outside the axis are left out."""
    kept = comp
    if lo is not None:
        kept = kept.where(F.col("length") >= lo)
    if hi is not None:
        kept = kept.where(F.col("length") <= hi)
    return (
        kept.groupBy(*by, unit_bin("length", width).alias("bin"))
        .agg(sum_or_zero("freq").alias("freq"))
        .withColumn("density", ratio("freq", F.sum("freq").over(Window.partitionBy(*by)) * F.lit(width)))
    )


def mean_length_pair(a: DataFrame, b: DataFrame, on: Sequence[str] = ("year",)) -> DataFrame:
    """Mean lengths of two surveys in the years both have: ``year, mean_a, mean_b``."""
    return null_safe_join(
        a.select(*on, F.col("mean").alias("mean_a")), b.select(*on, F.col("mean").alias("mean_b")), list(on)
    )


def longline_depth_lengths(df: DataFrame, areas: dict[str, str]) -> DataFrame:
    """``survey, year, region, strat, length, freq`` from the longline length summary.

    Leaves out the shallowest class and unknown depths (stratum 0 and 1) and
    the two non-surveyed regions; a row without region is left out with them.
    """
    region = F.col("council_sablefish_mgmt_area")
    return df.where((F.col("stratum") > 1) & (region != "Bering Sea") & (region != "Aleutians")).select(
        F.lit("LLS").alias("survey"),
        "year",
        recode(region, areas, "EGOA").alias("region"),
        F.col("stratum_description").alias("strat"),
        "length",
        F.col("frequency").alias("freq"),
    )


def trawl_depth_lengths(df: DataFrame) -> DataFrame:
    """``survey, year, region, strat, length, freq`` from trawl lengths: mm to cm, depth to class."""
    depth = first_present("depth_gear_m", "depth_m")
    return df.select(
        F.lit("BTS").alias("survey"),
        "year",
        recode("regulatory_area", TRAWL_AREAS, "EGOA").alias("region"),
        threshold_label(depth, DEPTH_CLASSES, DEEPEST_CLASS).alias("strat"),
        (F.col("length_mm") / 10).alias("length"),
        F.col("frequency").alias("freq"),
    )


def length_by_depth(df: DataFrame, by: Sequence[str] = ("year", "strat", "region")) -> DataFrame:
    """Number of fish and mean length per group, as if every fish were a row.

    A missing length makes the mean of its group missing.
    """
    f, x = F.col("freq"), F.col("length")
    counted = df.where(f > 0)
    return (
        counted.groupBy(*by)
        .agg(
            F.sum(f).cast("long").alias("n"),
            F.sum(f * x).alias("_fx"),
            F.count(F.when(x.isNull(), 1)).alias("_gaps"),
        )
        .select(*by, "n", F.when(F.col("_gaps") == 0, ratio("_fx", "n")).alias("mean_length"))
    )


def box_stats(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Quartiles, 1.5 x IQR whiskers and outlier count per group, frequency-weighted.

    Groups may be of any size: the quartiles come from ``exact_quantiles`` and
    the second pass is an ordinary aggregation.
    """
    key = F.struct(*by)
    vals = (
        df.where(F.col(value).isNotNull())
        .groupBy(key.alias("_k"), F.col(value).cast("double").alias("_x"))
        .agg(F.sum(F.col(weight) if weight else F.lit(1)).alias("_f"))
        .where("_f > 0")
    )
    quartiles = exact_quantiles(vals, ["_k"], "_x", [0.25, 0.5, 0.75], "_f")

    def at(p: float) -> Column:
        return F.max(F.when(F.col("prob") == p, F.col("q")))

    q = quartiles.groupBy("_k").agg(at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))
    q = q.withColumn("_reach", (F.col("q3") - F.col("q1")) * 1.5)
    x = F.col("_x")
    inside = (x >= F.col("q1") - F.col("_reach")) & (x <= F.col("q3") + F.col("_reach"))
    return (
        salted_join(vals, q, ["_k"], "inner")
        .groupBy("_k", "q1", "median", "q3")
        .agg(
            F.sum("_f").cast("long").alias("n"),
            F.min(F.when(inside, x)).alias("whisker_low"),
            F.max(F.when(inside, x)).alias("whisker_high"),
            F.sum(F.when(~inside, F.col("_f")).otherwise(F.lit(0))).cast("long").alias("outliers"),
        )
        .select(*[F.col("_k")[c].alias(c) for c in by], "n", "q1", "median", "q3", "whisker_low", "whisker_high", "outliers")
    )
