"""Catch accounting against limits, and the assessment status report."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import null_safe_join
from ..functions.nulls import half_even, strict_sum, sum_or_zero
from ..sources.lookups import recode

#: How each grain of ``catch_totals`` is told apart.
GRAINS = {
    ("year", "area", "retention"): "area_retention",
    ("year", "retention"): "retention",
    ("year",): "year",
    ("year", "gear"): "gear",
    ("year", "target"): "target",
}


def tidy_catch(
    catch: DataFrame,
    areas: dict[str, str] | None = None,
    other_area: str | None = None,
    year: str = "year",
    subarea: str = "fmp_subarea",
    gear: str = "agency_gear_code",
    target: str = "trip_target_name",
) -> DataFrame:
    """``year, area, retention, gear, target, weight``: numeric year, recoded area and retention."""
    area = F.col(subarea) if areas is None else recode(subarea, areas, other_area)
    retention = recode("retained_or_discarded", {"D": "Discarded"}, "Retained")
    return catch.select(
        F.col(year).try_cast("int").alias("year"),
        area.alias("area"),
        retention.alias("retention"),
        F.col(gear).alias("gear"),
        F.col(target).alias("target"),
        F.col("weight_posted").alias("weight"),
    )


def catch_by_area(catch: DataFrame) -> DataFrame:
    """Catch by year, area and retention; a missing weight makes its total missing."""
    return catch.groupBy("year", "area", "retention").agg(strict_sum("weight").alias("catch"))


def catch_totals(catch: DataFrame, digits: int | None = 2) -> DataFrame:
    """All five totals of the catch tables from one pass over the rows.

    The rows are summed once to the finest combination; the five grains are
    grouping sets over those sums, so the set expansion never touches the
    row-level table.  ``grain`` names the grain; columns outside it are null.
    A total is missing if a row in it has no weight.  The yearly total is
    rounded for the report.
    """
    dims = ["year", "area", "retention", "gear", "target"]
    fine = catch.groupBy(*dims).agg(
        F.sum("weight").alias("_s"), F.count("weight").alias("_c"), F.count(F.lit(1)).alias("_n")
    )
    sets = [[F.col(c) for c in s] for s in GRAINS]
    total = F.when(F.sum("_c") == F.sum("_n"), F.sum("_s"))
    out = fine.groupingSets(sets, *dims).agg(total.alias("catch"), F.grouping_id(*dims).alias("_g"))
    grain = F.lit(None).cast("string")
    for members, name in GRAINS.items():
        bits = sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in members)
        grain = F.when(F.col("_g") == bits, F.lit(name)).otherwise(grain)
    out = out.withColumn("grain", grain).select("grain", *dims, "catch")
    if digits is None:
        return out
    return out.withColumn(
        "catch", F.when(F.col("grain") == "year", half_even("catch", digits)).otherwise(F.col("catch"))
    )


def catch_by_gear_group(catch: DataFrame, groups: dict[str, str]) -> DataFrame:
    """Catch by year, gear group and retention; gears outside the groups are dropped."""
    return (
        catch.withColumn("gear", recode("gear", groups))
        .where(F.col("gear").isNotNull())
        .groupBy("year", "gear", "retention")
        .agg(strict_sum("weight").alias("catch"))
    )


def discards_by_target(catch: DataFrame) -> DataFrame:
    """Discarded catch by year and target fishery."""
    return (
        catch.where(F.col("retention") == "Discarded")
        .groupBy("year", "target")
        .agg(strict_sum("weight").alias("catch"))
    )


def area_limits(
    limits: DataFrame,
    areas: dict[str, str],
    other_area: str | None,
    total_label: str | None,
    label: str = "area_label",
    value: str = "acceptable_biological_catch",
) -> DataFrame:
    """``year, area, abc`` from the specification table, without its regional total row."""
    rows = limits if total_label is None else limits.where(F.col(label) != total_label)
    return rows.select("year", recode(label, areas, other_area).alias("area"), F.col(value).alias("abc"))


def catch_vs_limit(limits: DataFrame, area_catch: DataFrame, after: int = 2009, before: int = 2027) -> DataFrame:
    """Catch next to the area limit of its year.

    A limit appears once per retention class, so it must not be summed over
    this table.  Both sides have one row per year, area and class.
    """
    window = (F.col("year") > after) & (F.col("year") < before)
    return null_safe_join(limits.where(window), area_catch.where(window), ["year", "area"], "left")


def stack_biomass(parts: Sequence[DataFrame], digits: int = 0) -> DataFrame:
    """Yearly sum of several estimate tables, stacked by column name."""
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p, allowMissingColumns=True)
    return stacked.groupBy("year").agg(half_even(sum_or_zero("biomass"), digits).alias("biomass"))


def latest_rows(df: DataFrame, year: str = "year") -> DataFrame:
    """Rows of the latest year.  The year is a scalar subquery, not a collected value."""
    return df.where(F.col(year) == df.agg(F.max(year)).scalar())


def survey_series(
    survey: DataFrame, reference: DataFrame, tiers: Iterable[int], since: int = 1990, digits: int = 0
) -> DataFrame:
    """Yearly survey biomass of the species whose tier is listed.

    ``reference`` is a species list; it is left to the optimizer, which knows
    its size, to broadcast it.
    """
    tier = reference.select("species_code", "tier")
    by_species = survey.where(F.col("year") >= since).groupBy("year", "species_code")
    return (
        null_safe_join(by_species.agg(F.sum("area_biomass").alias("_b")), tier, ["species_code"], "left")
        .where(F.col("tier").isin(list(tiers)))
        .groupBy("year")
        .agg(half_even(sum_or_zero("_b"), digits).alias("survey_biomass"))
    )


def catch_series(catch: DataFrame, exclusions: Sequence[Column], since: int = 2003, digits: int = 0) -> DataFrame:
    """Yearly catch after dropping the rows that meet one of the compound ``exclusions``."""
    kept = catch.where(F.col("year") >= since)
    for e in exclusions:
        kept = kept.where(~e)
    return kept.groupBy("year").agg(half_even(sum_or_zero("tot_catch"), digits).alias("catch"))


# The tags of the report format, in its order.  Section heads have no value.
REPORT_TAGS = """
STOCK STOCK_NAME REGION ASMT_TYPE ASMT_YEAR ASMT_MONTH TIER NUM_SEXES NUM_FISHERIES REC_MULT RECAGE COMPLEX
LAST_DATA_YEAR ASMT_MODEL_CATEGORY ASMT_MODEL MODEL_VERSION ENSEMBLE LEAD_LAB POC_EMAIL REVIEW_RESULT
CATCH_INPUT_DATA ABUNDANCE_INPUT_DATA BIOLOGICAL_INPUT_DATA SIZEAGE_COMP_INPUT_DATA ECOSYSTEM_LINKAGE
FISHING_MORTALITY_ESTIMATES F_YEAR F_BASIS F_UNIT BEST_F_ESTIMATE F_LIMIT F_LIMIT_BASIS F_MSY F_MSY_BASIS
BIOMASS_ESTIMATES B_YEAR B_BASIS B_UNIT BEST_B_ESTIMATE LOWER_B_ESTIMATE UPPER_B_ESTIMATE ESTIMATE_METHOD
INTERVAL_SIZE B_MSY B_MSY_BASIS
TIME_SERIES_ESTIMATES FISHERYYEAR AGE RECRUITMENT SPAWNBIOMASS TOTALBIOMASS TOTFSHRYMORT TOTALCATCH SURVEYDESC
STOCKNOTES SURVEY_ESTIMATES
""".split()
REPORT_HEADS = ("FISHING_MORTALITY_ESTIMATES", "BIOMASS_ESTIMATES", "TIME_SERIES_ESTIMATES")


def status_report(
    biomass: DataFrame,
    survey: DataFrame,
    catch: DataFrame,
    limits: DataFrame,
    year: int,
    static: dict[str, str] | None = None,
) -> DataFrame:
    """Assessment summary as ordered ``(ord, tag, value)`` rows.

    ``biomass(year, biomass)``, ``survey(year, survey_biomass)`` and
    ``catch(year, catch)`` are yearly series; ``limits(year, hl, total)`` holds
    the harvest limits; ``static`` gives the text of descriptive tags.  Every
    number is a scalar subquery on an aggregate, so nothing is collected.  A tag
    whose value is not known reads ``NA``; a section head has no value.  A series
    with more than one row for a year is an error, so what is gathered is bounded
    by the number of years.
    """

    def digits(c: str) -> Column:
        return F.col(c).cast("long").cast("string")

    def years() -> Column:
        return F.array_join(F.transform(F.array_sort(F.collect_list("year")), lambda y: y.cast("string")), " ")

    def series(c: str) -> Column:
        """Values in year order, separated by blanks; one row per year goes in."""
        pairs = F.array_sort(F.collect_list(F.struct("year", digits(c).alias("v"))))
        return F.array_join(F.transform(pairs, lambda p: p.v), " ", "NA")

    def yearly(df: DataFrame, c: str) -> DataFrame:
        """One row per year; a second one is an error."""
        one = F.when(F.count(F.lit(1)) == 1, F.first(c)).otherwise(F.raise_error(F.lit(f"{c}: more than one row for a year")).cast(df.schema[c].dataType))
        return df.groupBy("year").agg(one.alias(c))

    biomass, survey, catch = yearly(biomass, "biomass"), yearly(survey, "survey_biomass"), yearly(catch, "catch")

    unknown = set(static or {}) - set(REPORT_TAGS)
    if unknown:
        raise ValueError(f"not tags of the report: {sorted(unknown)}")
    if set(static or {}) & set(REPORT_HEADS):
        raise ValueError("a section head takes no value")
    # One pass and one row per source; the other sources' rows are attached as scalar subqueries.
    of_catch = F.struct(F.max(F.when(F.col("year") == year - 1, digits("catch"))).alias("last"), series("catch").alias("all"))
    ofl = F.max(F.when((F.col("year") == year) & (F.col("hl") == "OFL"), digits("total")))
    facts = (
        biomass.agg(
            F.max("year").cast("string").alias("y"),
            F.max_by(digits("biomass"), "year").alias("b"),
            years().alias("years"),
            series("biomass").alias("trend"),
        )
        .withColumn("catch", catch.agg(of_catch).scalar())
        .withColumn("ofl", limits.agg(ofl).scalar())
        .withColumn("survey", survey.agg(series("survey_biomass")).scalar())
    )
    known: dict[str, Column] = {tag: F.lit(v) for tag, v in (static or {}).items()}
    known |= {
        "ASMT_YEAR": F.lit(str(year)),
        "LAST_DATA_YEAR": F.col("y"),
        "F_YEAR": F.lit(str(year - 1)),
        "BEST_F_ESTIMATE": F.col("catch.last"),
        "F_LIMIT": F.col("ofl"),
        "F_MSY": F.col("ofl"),
        "B_YEAR": F.col("y"),
        "BEST_B_ESTIMATE": F.col("b"),
        "FISHERYYEAR": F.col("years"),
        "TOTALBIOMASS": F.col("trend"),
        "TOTALCATCH": F.col("catch.all"),
        "SURVEY_ESTIMATES": F.col("survey"),
    }
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("ord"),
                F.lit(tag).alias("tag"),
                (F.lit(None).cast("string") if tag in REPORT_HEADS else F.coalesce(known.get(tag, F.lit(None)), F.lit("NA"))).alias("value"),
            )
            for i, tag in enumerate(REPORT_TAGS, 1)
        ]
    )
    return facts.select(F.inline(rows))


def exclude_codes(code_col: str, codes: Iterable[int], area_col: str, areas: Iterable[str]) -> Column:
    """Compound exclusion: these codes in these areas."""
    return F.col(code_col).isin(list(codes)) & F.col(area_col).isin(list(areas))

