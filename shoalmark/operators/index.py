"""Survey indices: stratified sums with pooled CVs, gaps, imputation, reports."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.nulls import col, half_even, not_in, ratio, strict_sum, sum_or_zero
from ..functions.text import estimate_with_cv
from ..sources.lookups import StrataScheme, recode
from .grid import fill_years, scaffold

DEFAULT_CV = 0.5


def pooled_cv(variance_sum: str | Column, total: str | Column) -> Column:
    """CV of a sum from the sum of its component variances."""
    return ratio(F.sqrt(col(variance_sum)), total)


def longline_index(
    lls: DataFrame,
    areas: dict[str, str],
    since: int = 1991,
    by: Sequence[str] = (),
    area_col: str = "council_management_area",
    value: str = "rpw",
    variance: str = "rpw_var",
) -> DataFrame:
    """Yearly area index after ``since``: ``year, strata, cpue, cv`` on a full year x area grid."""
    sums = (
        lls.where(F.col("year") > since)
        .withColumn("strata", recode(area_col, areas))
        .groupBy(*by, "year", "strata")
        .agg(sum_or_zero(value).alias("cpue"), sum_or_zero(variance).alias("_var"))
        .select(*by, "year", "strata", "cpue", pooled_cv("_var", "cpue").alias("cv"))
    )
    return scaffold(sums, list(dict.fromkeys(areas.values())), by)


def depredation_index(
    lls: DataFrame,
    areas: dict[str, str],
    excluded_subareas: Iterable[str],
    incomplete: Iterable[tuple[int, str]],
    since: int = 1989,
    by: Sequence[str] = (),
    area_col: str = "council_sablefish_management_area",
    subarea_col: str = "geographic_area_name",
    value: str = "rpw",
    variance: str = "rpw_var",
) -> DataFrame:
    """Area index without some sub-areas and without incomplete (year, area) pairs.

    A row without sub-area name is kept: it is not one of the excluded ones.
    """
    kept = lls.where((F.col("year") > since) & not_in(subarea_col, excluded_subareas))
    for year, area in incomplete:
        kept = kept.where(~((F.col("year") == year) & (F.col(area_col) == area)))
    sums = (
        kept.withColumn("strata", recode(area_col, areas))
        .groupBy(*by, "year", "strata")
        .agg(sum_or_zero(value).alias("biomass"), sum_or_zero(variance).alias("_var"))
        .select(*by, "year", "strata", "biomass", pooled_cv("_var", "biomass").alias("cv"))
    )
    return scaffold(sums, list(dict.fromkeys(areas.values())), by)


def impute_variance(
    df: DataFrame, cv: float = DEFAULT_CV, value: str = "biomass_mt", variance: str = "biomass_var"
) -> DataFrame:
    """Missing variance, or zero variance of a positive estimate, becomes ``(cv * estimate)^2``."""
    x, v = F.col(value), F.col(variance)
    assumed = F.pow(F.lit(cv) * x, F.lit(2))
    # A zero variance whose estimate is missing cannot be judged, so it turns missing.
    zero = F.when(x.isNull(), F.lit(None)).when(x > 0, assumed).otherwise(v)
    return df.withColumn(variance, F.when(v.isNull(), assumed).when(v == 0, zero).otherwise(v))


def clean_cv(df: DataFrame, default: float = DEFAULT_CV, value: str = "biomass", cv: str = "cv") -> DataFrame:
    """A zero CV, or a missing CV next to an estimate, becomes the default."""
    c = F.col(cv)
    return df.withColumn(
        cv, F.when(c == 0, F.lit(default)).when(c.isNull() & F.col(value).isNotNull(), F.lit(default)).otherwise(c)
    )


def assign_strata(df: DataFrame, scheme: StrataScheme, code_col: str = "area_id") -> DataFrame:
    """Add ``area, strata`` by area code; rows with an unmapped code are dropped.

    The scheme is a short list of codes, so this is an equality join with a
    broadcast of checked size.
    """
    codes = scheme.frame(df.sparkSession).withColumnRenamed("area_id", "_code")
    return df.join(codes, F.col(code_col) == F.col("_code")).drop("_code")


def trawl_index(biom: DataFrame, scheme: StrataScheme, by: Sequence[str] = ()) -> DataFrame:
    """``year, strata, n, biomass, cv`` on the full grid of a stratification scheme."""
    sums = (
        assign_strata(impute_variance(biom), scheme)
        .groupBy(*by, "year", "strata")
        .agg(
            strict_sum("n_haul").alias("n"),
            sum_or_zero("biomass_mt").alias("biomass"),
            sum_or_zero("biomass_var").alias("_var"),
        )
        .select(*by, "year", "strata", "n", "biomass", pooled_cv("_var", "biomass").alias("cv"))
    )
    return clean_cv(scaffold(sums, scheme.strata, by))


def combine_strata(df: DataFrame, mapping: dict[str, str], by: Sequence[str] = ()) -> DataFrame:
    """Merge strata; a merged value is missing if any of its parts is.  Other strata pass through."""
    mapped = F.col("strata").isin(list(mapping))
    return (
        df.withColumn("_mapped", mapped)
        .withColumn("strata", F.when(mapped, recode("strata", mapping)).otherwise(F.col("strata")))
        .groupBy(*by, "year", "strata", "_mapped")
        .agg(
            strict_sum("biomass").alias("biomass"),
            strict_sum(F.pow(F.col("biomass") * F.col("cv"), F.lit(2))).alias("_var"),
            F.max("cv").alias("_cv"),
        )
        .select(
            *by,
            "year",
            "strata",
            "biomass",
            F.when(F.col("_mapped"), pooled_cv("_var", "biomass")).otherwise(F.col("_cv")).alias("cv"),
        )
    )


def impute_stratum_mean(
    df: DataFrame,
    fills: dict[str, str | None],
    ref_years: tuple[int, int] | None = None,
    by: Sequence[str] = (),
    default_cv: float = DEFAULT_CV,
) -> DataFrame:
    """Fill missing biomass of the strata in ``fills`` with that stratum's mean over the reference years.

    ``fills`` maps a stratum to another stratum that must have been surveyed in
    the same year for the fill to apply, or to None.  The input is an index
    with one row per year and stratum, so its windows are short.
    """
    b = F.col("biomass")
    in_ref = F.lit(True) if ref_years is None else F.col("year").between(*ref_years)
    out = df.withColumn("_mean", F.avg(F.when(in_ref, b)).over(Window.partitionBy(*by, "strata")))
    allowed = F.lit(False)
    year = Window.partitionBy(*by, "year")
    for i, (stratum, needs) in enumerate(fills.items()):
        ok = F.col("strata") == stratum
        if needs is not None:
            out = out.withColumn(f"_ok{i}", F.max(F.when(F.col("strata") == needs, b)).over(year).isNotNull())
            ok = ok & F.col(f"_ok{i}")
        allowed = allowed | ok
    filled = F.when(b.isNull() & allowed, F.col("_mean")).otherwise(b)
    return clean_cv(out.withColumn("biomass", filled).select(*df.columns), default_cv)


def splice_redesign(old: DataFrame, new: DataFrame, year: int) -> DataFrame:
    """The old series before the redesign year, the new one from then on; columns align by name."""
    return old.where(F.col("year") < year).unionByName(new.where(F.col("year") >= year), allowMissingColumns=True)


def index_wide_report(
    df: DataFrame,
    last_year: int,
    strata: Sequence[str],
    by: Sequence[str] = (),
    value: str = "biomass",
    cv: str = "cv",
) -> DataFrame:
    """Year x stratum table of ``estimate (cv)`` text, all years from the first to ``last_year``."""
    text = df.select(*by, "year", "strata", estimate_with_cv(value, cv).alias("_t"))
    wide = text.groupBy(*by, "year").pivot("strata", list(strata)).agg(F.max("_t"))
    return fill_years(wide, last_year, by)


def species_ratio(
    df: DataFrame,
    a: str,
    b: str,
    value: str,
    species_col: str = "species",
    by: Sequence[str] = ("year",),
) -> DataFrame:
    """Per key: value of species a, of species b, and a / b.  One conditional pass, no pivot job."""
    s = F.col(species_col)
    return (
        df.where(s.isin(a, b))
        .groupBy(*by)
        .agg(F.sum(F.when(s == a, F.col(value))).alias("a"), F.sum(F.when(s == b, F.col(value))).alias("b"))
        .withColumn("ratio", ratio("a", "b"))
    )


def cv_floor(df: DataFrame, floor: float, cv: str = "cv") -> DataFrame:
    """Raise small CVs to a floor; a missing CV stays missing."""
    return df.withColumn(cv, F.when(F.col(cv) < floor, F.lit(floor)).otherwise(F.col(cv)))


def drop_years(df: DataFrame, years: Iterable[int]) -> DataFrame:
    """Leave out the listed years; rows without a year are kept."""
    return df.where(not_in("year", years))


def round_report(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    """Half-even report rounding, column by column."""
    return df.withColumns({c: half_even(c, d) for c, d in columns.items()})
