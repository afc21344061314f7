"""Model comparison, apportionment, harvest specification and change tables.

Inputs are prediction tables: one row per (model, stratum, year) or per
(model, year).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.joins import null_safe_join
from ..functions.nulls import half_even, ratio, strict_sum, sum_or_zero
from ..sources.lookups import category_rank, recode
from .depth import share_of_partition


def area_of(strata: str | Column, areas: Sequence[str], other: str) -> Column:
    """Area by substring of the stratum label; labels without a listed area belong to ``other``."""
    s = F.col(strata) if isinstance(strata, str) else strata
    out = F.when(s.isNull(), F.lit(other))
    for a in areas:
        out = out.when(s.contains(a), F.lit(a))
    return out.otherwise(F.lit(other))


def select_models(df: DataFrame, models: Sequence[str], model_col: str = "model_name") -> DataFrame:
    """Rows of the requested models.  Fails when one of them is absent instead of returning fewer rows."""
    kept = df.where(F.col(model_col).isin(list(models)))
    # An aggregate has its row whether or not anything is kept, so the check is always made; it adds no row.
    absent = F.when(F.count_distinct(model_col) == len(set(models)), F.lit(False)).otherwise(
        F.raise_error(F.lit(f"not every requested model is present: {sorted(models)}")).cast("boolean")
    )
    check = kept.agg(absent.alias("_absent")).where("_absent")
    return kept.unionByName(check.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kept.schema.fields]))


def extra_cv(fits: dict[str, DataFrame]) -> DataFrame:
    """Total and added observation CV, tagged by survey and stacked."""
    out = None
    for survey, df in fits.items():
        part = (
            df.withColumn("tot_cv", F.sqrt(F.exp(F.pow("tot_sd_log_obs", F.lit(2))) - 1))
            .withColumn("delta_cv", F.col("tot_cv") - F.col("obs_cv"))
            .withColumn("survey", F.lit(survey))
        )
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def pivot_models(df: DataFrame, ids: Sequence[str], models: Sequence[str], value: str) -> DataFrame:
    """One column per listed model.  The list saves the job that would look for distinct values.

    A second row of a model for the same ``ids`` is an error, found in the same pass.
    """
    message = F.format_string(f"%d rows of model %s for one ({', '.join(ids)})", F.count(F.lit(1)), F.max("model_name"))
    second = F.raise_error(message).cast(df.schema[value].dataType)
    return df.groupBy(*ids).pivot("model_name", list(models)).agg(F.when(F.count(F.lit(1)) > 1, second).otherwise(F.max(value)))


def prediction_table(by_strata: DataFrame, total: DataFrame, models: Sequence[str]) -> DataFrame:
    """Stratum rows and ``Total`` rows, one prediction column per model."""
    cols = ["strata", "year", "model_name", "pred"]
    rows = by_strata.select(*cols).unionByName(total.withColumn("strata", F.lit("Total")).select(*cols))
    return pivot_models(rows, ["strata", "year"], models, "pred")


def total_prediction(by_strata: DataFrame) -> DataFrame:
    """Prediction summed over the strata of a model and year, with summed bounds."""
    return by_strata.groupBy("model_name", "year").agg(*[strict_sum(c).alias(c) for c in ("pred", "pred_lci", "pred_uci")])


def pct_change_vs_base(
    total: DataFrame, pairs: Sequence[tuple[str, str, str]], before: int | None = None
) -> DataFrame:
    """``model, year, pct_change``: 100 (m - base) / base for each ``(label, m, base)``.

    Every prediction is handed to the pairs it takes part in and the two sides
    meet in one aggregation; a year only one side has gives null.
    """
    rows = total if before is None else total.where(F.col("year") < before)
    table = F.array(
        *[F.struct(F.lit(n).alias("model"), F.lit(m).alias("m"), F.lit(b).alias("b")) for n, m, b in pairs]
    )
    me = F.col("model_name")
    took_part = F.filter(table, lambda p: (p.m == me) | (p.b == me))
    m, b = F.col("_m"), F.col("_b")
    return (
        rows.withColumn("_p", F.explode(took_part))
        .groupBy(F.col("_p.model").alias("model"), "year")
        .agg(
            F.max(F.when(F.col("_p.m") == me, F.col("pred"))).alias("_m"),
            F.max(F.when(F.col("_p.b") == me, F.col("pred"))).alias("_b"),
        )
        .select("model", "year", (ratio(m - b, b) * 100).alias("pct_change"))
    )


def mean_pct_change(changes: DataFrame, since: int) -> DataFrame:
    """Mean of the yearly changes per model after ``since``."""
    return changes.where(F.col("year") > since).groupBy("model").agg(F.avg("pct_change").alias("mean_pct_change"))


def previous_assessment_change(new: DataFrame, old: DataFrame, before: int, by: Sequence[str] = ()) -> DataFrame:
    """Change against the previously published series, matched on year."""
    keys = [*by, "year"]
    a = new.where(F.col("year") < before).select(*keys, F.col("pred").alias("pred_new"))
    b = old.where(F.col("year") < before).select(*keys, F.col("pred").alias("pred_old"))
    return null_safe_join(a, b, keys).withColumn("pct_change", ratio(F.col("pred_new") - F.col("pred_old"), "pred_old") * 100)


def apportionment(
    by_strata: DataFrame,
    area: str | Column = "area",
    order: Sequence[str] = (),
    models: Sequence[str] | None = None,
) -> DataFrame:
    """Area biomass, model-year total and proportion; ``ord`` is the area's place in the report order.

    Totals are windows over the aggregated area rows, a handful per model and year.
    """
    rows = by_strata if models is None else select_models(by_strata, models)
    area = F.col(area) if isinstance(area, str) else area
    sums = rows.groupBy("model_name", area.alias("area"), "year").agg(strict_sum("pred").alias("stratum_biomass"))
    out = share_of_partition(sums, ["model_name", "year"], "stratum_biomass", "total_biomass", "proportion")
    return out.withColumn("ord", category_rank("area", list(order))) if order else out


def apportionment_wide(appo: DataFrame, models: Sequence[str]) -> DataFrame:
    return pivot_models(appo, ["area", "year"], models, "proportion")


def region_rollup(appo: DataFrame, regions: dict[str, str]) -> DataFrame:
    """Proportions and biomass by management region; areas outside ``regions`` stand for themselves."""
    return (
        appo.withColumn("region", recode("area", regions, F.col("area")))
        .groupBy("model_name", "year", "region")
        .agg(strict_sum("stratum_biomass").alias("biomass"), strict_sum("proportion").alias("proportion"))
    )


def harvest_spec(appo: DataFrame, year: int, m: float = 0.03, factor: float = 0.75) -> DataFrame:
    """OFL, maximum ABC and ABC from total biomass, one row per model in the target year.

    The year is a grouping key of the apportionment, so the filter moves below
    its window and aggregation by itself.
    """
    b = F.col("total_biomass")
    return (
        appo.where(F.col("year") == year)
        .select(
            "model_name",
            "year",
            b.alias("biomass"),
            (F.lit(m) * b).alias("ofl"),
            (F.lit(factor) * F.lit(m) * b).alias("max_abc"),
            (F.lit(factor) * F.lit(m) * b).alias("abc"),
        )
        .distinct()
    )


def _year_sum(year: int, value: str, strict: bool) -> Column:
    """Sum of one year's values: null when the year has no rows, 0 when it has only missing ones."""
    here = F.col("year") == year
    n, present = F.count(F.when(here, 1)), F.count(F.when(here, F.col(value)))
    total = F.sum(F.when(here, F.col(value)))
    if strict:
        return F.when((n > 0) & (n == present), total)
    return F.when(n > 0, F.coalesce(total, F.lit(0.0)))


def stratum_change(
    df: DataFrame, y0: int, y1: int, value: str, area: str | Column = "area", by: Sequence[str] = ()
) -> DataFrame:
    """Fractional change between two years by area."""
    area = F.col(area) if isinstance(area, str) else area
    return (
        df.where(F.col("year").isin(y0, y1))
        .groupBy(*by, area.alias("area"))
        .agg(_year_sum(y0, value, False).alias("v0"), _year_sum(y1, value, False).alias("v1"))
        .withColumn("frac_change", ratio(F.col("v1") - F.col("v0"), "v0"))
    )


def total_change(
    df: DataFrame, y0: int, y1: int, value: str, by: Sequence[str] = (), strict: bool = False
) -> DataFrame:
    """Fractional change of the regional total between two years."""
    return (
        df.where(F.col("year").isin(y0, y1))
        .groupBy(*by)
        .agg(_year_sum(y0, value, strict).alias("v0"), _year_sum(y1, value, strict).alias("v1"))
        .withColumn("frac_change", ratio(F.col("v1") - F.col("v0"), "v0"))
    )


def change_from_prior(total: DataFrame, year: int, prior: float) -> DataFrame:
    """Fractional change of each model's total in ``year`` from a published value."""
    return total.where(F.col("year") == year).select(
        "model_name", "year", "pred", ratio(F.col("pred") - prior, F.lit(float(prior))).alias("frac_change")
    )


def change_between_models(total: DataFrame, year: int, new: str, old: str) -> DataFrame:
    """Fractional change of the total in one year from model ``old`` to model ``new``."""
    m = F.col("model_name")
    return (
        total.where((F.col("year") == year) & m.isin(new, old))
        .groupBy("year")
        .agg(F.max(F.when(m == new, F.col("pred"))).alias("new"), F.max(F.when(m == old, F.col("pred"))).alias("old"))
        .withColumn("frac_change", ratio(F.col("new") - F.col("old"), "old"))
    )


def ratio_to_longterm_mean(
    df: DataFrame, year: int, value: str, pattern: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Total of one year over the mean of the yearly totals."""
    rows = df if pattern is None else df.where(F.col("strata").contains(pattern))
    yearly = rows.groupBy(*by, "year").agg(sum_or_zero(value).alias("_t"))
    return (
        yearly.groupBy(*by)
        .agg(F.max(F.when(F.col("year") == year, F.col("_t"))).alias("year_total"), F.avg("_t").alias("mean_total"))
        .withColumn("ratio", ratio("year_total", "mean_total"))
    )


def strata_report(
    by_strata: DataFrame,
    areas: Sequence[str],
    models: Sequence[str] | None = None,
    area: str | Column = "area",
) -> DataFrame:
    """Predicted biomass by area with its bounds, rounded, three columns per area.

    The bounds are sums of stratum bounds: they bracket the area estimate but
    are not a joint confidence interval.
    """
    rows = by_strata if models is None else select_models(by_strata, models)
    area = F.col(area) if isinstance(area, str) else area
    out = []
    for a in areas:
        here = area == a
        for src, suffix in (("pred", ""), ("pred_lci", "_lci"), ("pred_uci", "_uci")):
            n = F.count(F.when(here, 1))
            v = F.when(n > 0, F.coalesce(F.sum(F.when(here, F.col(src))), F.lit(0.0)))
            out.append(half_even(v).alias(f"{a}{suffix}"))
    return rows.groupBy("model_name", "year").agg(*out)


def total_report(total: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """Predicted total with bounds, as computed and rounded."""
    rows = total if models is None else select_models(total, models)
    return rows.select(
        "model_name",
        "year",
        "pred",
        "pred_lci",
        "pred_uci",
        half_even("pred").alias("total"),
        half_even("pred_lci").alias("lci"),
        half_even("pred_uci").alias("uci"),
    )
