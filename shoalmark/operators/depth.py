"""Depth profiles of the catch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bins import right_closed_bin
from ..functions.joins import null_safe_join
from ..functions.nulls import ratio, strict_mean


def hook_cpue(sets: DataFrame, hooks: int = 45, max_ineffective: int = 6) -> DataFrame:
    """Catch per effective hook; sets with too many ineffective hooks are dropped, no catch counts as 0."""
    per_hook = ratio("catch_freq", F.lit(hooks) - F.col("ineffective"))
    return sets.where(F.col("ineffective") < max_ineffective).withColumn(
        "cpue", F.when(F.col("catch_freq").isNull(), F.lit(0.0)).otherwise(per_hook)
    )


def scale_to_max(df: DataFrame, value: str, out: str) -> DataFrame:
    """Value over the survey's maximum.  ``df`` is a profile: one row per region and bin."""
    peak = df.agg(F.max(value)).scalar()
    return df.withColumn(out, ratio(F.col(value), peak))


def depth_profile_sets(
    sets: DataFrame, region: str = "region", depth: str = "depth", width: float = 50, top: float = 1100
) -> DataFrame:
    """Longline: mean CPUE per region and right-closed depth bin, with its share of the maximum."""
    profile = (
        hook_cpue(sets)
        .groupBy(F.col(region).alias("region"), right_closed_bin(depth, width, top).alias("bin"))
        .agg(strict_mean("cpue").alias("mean_cpue"))
    )
    return scale_to_max(profile, "mean_cpue", "scaled")


def depth_profile_hauls(
    hauls: DataFrame,
    catch: DataFrame,
    region: str = "geo",
    weight: str = "weight_kg",
    width: float = 50,
    top: float = 1100,
) -> DataFrame:
    """Trawl: the same for hauls; a haul without catch counts as 0.  Depth is that of the haul.

    The mean runs over haul-catch rows, so a haul with several catch rows counts
    several times.  The catch is summed per haul before the join, which keeps a
    haul with very many catch rows from becoming one large join partition.
    """
    per_haul = catch.groupBy("haul").agg(
        F.sum(F.coalesce(F.col(weight), F.lit(0.0))).alias("_w"), F.count(F.lit(1)).alias("_n")
    )
    rows, kg = F.coalesce("_n", F.lit(1)), F.coalesce("_w", F.lit(0.0))
    profile = (
        null_safe_join(hauls, per_haul, ["haul"], "left")
        .groupBy(F.col(region).alias("region"), right_closed_bin("depth", width, top).alias("bin"))
        .agg(ratio(F.sum(kg), F.sum(rows)).alias("mean_cpue"))
    )
    return scale_to_max(profile, "mean_cpue", "scaled")


def share_of_partition(df: DataFrame, by: list[str], value: str, total: str, share: str) -> DataFrame:
    """Group total on every row, and the row's share of it.

    For aggregated rows, where a group is short; a missing value makes the
    total of its group missing.
    """
    w = Window.partitionBy(*by)
    whole = F.when(F.count(value).over(w) == F.count(F.lit(1)).over(w), F.sum(value).over(w))
    return df.withColumn(total, whole).withColumn(share, ratio(value, total))
