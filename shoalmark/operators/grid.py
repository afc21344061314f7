"""Complete (year x stratum) grids and year ranges, without cross joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scaffold(
    df: DataFrame,
    strata: Sequence[str],
    by: Sequence[str] = (),
    strata_col: str = "strata",
) -> DataFrame:
    """Every year that occurs x every listed stratum; combinations without data have nulls.

    ``df`` is an aggregated index with one row per (by, year, stratum); a second
    row for a listed cell is an error.  The cells of a year are gathered - at
    most one per listed stratum - and laid out against the list, so the input is
    read once and nothing is joined.  A year that has only unlisted strata keeps
    its (empty) grid rows.
    """
    keys = [*by, "year"]
    values = [c for c in df.columns if c not in (*keys, strata_col)]
    cell = F.struct(F.col(strata_col).alias("_s"), *values)
    second = F.raise_error(F.concat(F.lit("more than one row for year and stratum: "), F.to_json(F.col("_hits"))))
    listed = F.when(F.col(strata_col).isin(list(strata)), cell)
    return (
        df.groupBy(*keys)
        .agg(F.collect_list(listed).alias("_cells"))
        .withColumn(strata_col, F.explode(F.array(*[F.lit(s) for s in strata])))
        .withColumn("_hits", F.filter("_cells", lambda c: c["_s"] == F.col(strata_col)))
        .withColumn("_hit", F.when(F.size("_hits") > 1, second).otherwise(F.get("_hits", F.lit(0))))
        .select(*keys, strata_col, *[F.col(f"_hit.{v}").alias(v) for v in values])
    )


def fill_years(df: DataFrame, last_year: int, by: Sequence[str] = ()) -> DataFrame:
    """One row per year from the first year present to ``last_year``; new years have nulls.

    ``df`` has one row per (by, year).  Each row also produces the gap years up
    to the next row, so no separate year table is joined.  The window sees one
    row per year.
    """
    values = [c for c in df.columns if c not in (*by, "year")]
    nxt = F.lead("year").over(Window.partitionBy(*by).orderBy("year"))
    return (
        df.where(F.col("year") <= last_year)
        .withColumn("_to", F.coalesce(nxt - 1, F.lit(last_year)))
        .withColumn("_y", F.explode(F.sequence("year", F.col("_to"))))
        .select(
            *by,
            F.col("_y").cast("int").alias("year"),
            *[F.when(F.col("_y") == F.col("year"), F.col(v)).alias(v) for v in values],
        )
    )


def grid_expand(df: DataFrame, last_year: int, by: Sequence[str] = (), strata_col: str = "strata") -> DataFrame:
    """First year .. ``last_year`` x the strata that occur, as a bare grid."""
    span = df.groupBy(*by).agg(F.min("year").alias("_lo"), F.collect_set(strata_col).alias("_strata"))
    return (
        span.where(F.col("_lo") <= last_year)
        .withColumn("year", F.explode(F.sequence("_lo", F.lit(last_year))))
        .select(*by, F.col("year").cast("int").alias("year"), F.explode("_strata").alias(strata_col))
    )
