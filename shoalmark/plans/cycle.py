"""The assessment cycle: survey tables in, model inputs and report tables out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.nulls import strict_sum, sum_or_zero
from ..operators import compare as cp
from ..operators import index as ix
from ..sources.lookups import LONGLINE_AREAS, MERGE_SHALLOW, NINE_STRATA, SIX_STRATA, StrataScheme


def model_inputs(
    biom: DataFrame,
    lls: DataFrame,
    redesign_year: int = 2025,
    fine: StrataScheme = NINE_STRATA,
    coarse: StrataScheme = SIX_STRATA,
    merge: dict[str, str] = MERGE_SHALLOW,
    fills: dict[str, str | None] | None = None,
    areas: dict[str, str] = LONGLINE_AREAS,
    ref_years: tuple[int, int] | None = None,
    by: Sequence[str] = (),
    land: Callable[[DataFrame], DataFrame] | None = None,
    since: int = 1991,
    years: tuple[int, int] = (1990, 2026),
) -> dict[str, DataFrame]:
    """The five model input tables of a cycle and its model years, each a lazy plan.

    Four of them start from the trawl table.  Where that is itself the result of
    a large scan, pass ``land`` (see ``writers.land``): it is applied to the two
    survey tables, which are then computed once for all five outputs.

    ``fills`` defaults to the three mid-depth strata, the eastern one only in
    years in which its shallow stratum was surveyed.  ``ref_years`` limits the
    years that enter the imputation mean; without it every year counts.  The longline
    table has the years after ``since``; the model years run from the first to the last of ``years``, surveyed or not.
    """
    if fills is None:
        fills = {"WGOA_501_700": None, "CGOA_501_700": None, "EGOA_501_700": "EGOA_0_500"}
    if land is not None:
        biom, lls = land(biom), land(lls)
    three = ix.trawl_index(biom, fine, by)
    two = ix.trawl_index(biom, coarse, by)
    imputed = ix.impute_stratum_mean(three, fills, ref_years, by).where(F.col("year") < redesign_year)
    two_imputed = ix.splice_redesign(ix.combine_strata(imputed, merge, by), two, redesign_year)
    return {
        "biomass_dat_3strat": three,
        "biomass_dat_3strat_impute": imputed.drop("n"),
        "biomass_dat_2strat": two,
        "biomass_dat_2strat_impute": two_imputed.select(*by, "year", "strata", "biomass", "cv"),
        "cpue_dat": ix.longline_index(lls, areas, since, by=by),
        "model_yrs": biom.sparkSession.range(years[0], years[1] + 1).select(F.col("id").cast("int").alias("year")),
    }


def predicted_areas(by_strata: DataFrame, area: str | Column = "area") -> DataFrame:
    """Sums of predictions by model, area and year: ``pred`` is missing where a stratum is, the others leave it out."""
    area = F.col(area) if isinstance(area, str) else area
    return by_strata.groupBy("model_name", area.alias("area"), "year").agg(
        strict_sum("pred").alias("pred"),
        *[sum_or_zero(c).alias(f"known_{c}") for c in ("pred", "pred_lci", "pred_uci")],
    )


def surveyed_areas(
    survey: DataFrame, value: str, area: str | Column, within: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Sums of a survey index by area and year: ``strict`` is missing where a stratum is, ``known`` leaves it out.

    ``within`` is ``known`` over the strata whose name holds that text, missing where the area has none in the year.
    """
    area = F.col(area) if isinstance(area, str) else area
    chosen = F.lit(True) if within is None else F.col("strata").contains(within)
    some = F.count(F.when(chosen, 1)) > 0
    return survey.groupBy(*by, area.alias("area"), "year").agg(
        strict_sum(value).alias("strict"),
        sum_or_zero(value).alias("known"),
        F.when(some, sum_or_zero(F.when(chosen, F.col(value)))).alias("within"),
    )


def cycle_reports(
    by_strata: DataFrame,
    total: DataFrame,
    trawl: DataFrame,
    longline: DataFrame,
    models: Sequence[str],
    areas: Sequence[str],
    area: str | Column,
    years: tuple[int, int],
    spec_year: int,
    prior: float | None = None,
    within: str | None = "0_700",
    by: Sequence[str] = (),
    m: float = 0.03,
    factor: float = 0.75,
    land: Callable[[DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """The report tables of a cycle, each a lazy plan over sums by area and year.

    Predictions, trawl index and longline index are summed once each, and all reports start from those sums: pass
    ``land`` (see ``writers.land``), and however many reports are written, the row-level tables are read once.
    ``area`` assigns a stratum of the predictions and of the trawl index to one of ``areas``, in report order; the
    longline index is reported by its strata.  Changes are between the two ``years``, long-term ratios are those of
    the later one, the trawl index's over the strata ``within``.  With ``prior``, a published total, the change from
    it is reported as well.
    """
    first, last = years
    predicted = predicted_areas(by_strata.where(F.col("model_name").isin(list(models))), area)
    by_trawl = surveyed_areas(trawl, "biomass", area, within, by)
    by_longline = surveyed_areas(longline, "cpue", "strata", None, by)
    if land is not None:
        predicted, by_trawl, by_longline = land(predicted), land(by_trawl), land(by_longline)
    # The models are looked for in the sums, so that the rows are not read a second time.
    predicted = cp.select_models(predicted, models)
    shares = cp.apportionment(predicted, "area", areas)
    known = predicted.select("model_name", "area", "year", *[F.col(f"known_{c}").alias(c) for c in ("pred", "pred_lci", "pred_uci")])
    out = {
        "apportionment": shares,
        "apportionment_wide": cp.apportionment_wide(shares, models),
        "harvest_spec": cp.harvest_spec(shares, spec_year, m, factor),
        "strata_report": cp.strata_report(known, areas),
        "total_report": cp.total_report(total, models),
        "trawl_area_change": cp.stratum_change(by_trawl, first, last, "known", "area", by),
        "trawl_total_change": cp.total_change(by_trawl, first, last, "known", by),
        "trawl_to_mean": cp.ratio_to_longterm_mean(by_trawl.where("within is not null"), last, "within", by=by),
        "longline_area_change": cp.stratum_change(by_longline, first, last, "known", "area", by),
        "longline_total_change": cp.total_change(by_longline, first, last, "strict", by, strict=True),
        "longline_to_mean": cp.ratio_to_longterm_mean(by_longline, last, "known", by=by),
    }
    if prior is not None:
        out["change_from_prior"] = cp.change_from_prior(cp.select_models(total, models), last, prior)
    return out


def flagship(biom: DataFrame, scheme: StrataScheme, last_year: int, by: Sequence[str] = ()) -> DataFrame:
    """Trawl survey table to the wide ``estimate (cv)`` report."""
    return ix.index_wide_report(ix.trawl_index(biom, scheme, by), last_year, scheme.strata, by)
