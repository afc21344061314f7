"""Registered queries: survey indices."""

from pyspark.sql import functions as F

from ..functions.nulls import ratio
from ..operators import index as ix
from .cycle import model_inputs
from .oracle import r, sql
from .registry import query
from .standins import MERGE, REGION_AREAS, S6, S9, Tables

SP = ["species"]
FILLS = {"WA_501_700": None, "CA_501_700": None, "EA_501_700": "EA_0_500"}
S9_CASES = ", ".join(f"max(CASE WHEN strata = '{s}' THEN t END) AS {s}" for s in S9.strata)
MERGED = "CASE " + " ".join(f"WHEN strata = '{a}' THEN '{b}'" for a, b in MERGE.items()) + " END"


def whole9(t: Tables):
    """The index of all rows; ``trawl9`` and ``trawl6`` have unsurveyed areas, for the operators about gaps."""
    return ix.trawl_index(t.survey_area, S9, SP)


def whole6(t: Tables):
    return ix.trawl_index(t.survey_area, S6, SP)


def trawl9(t: Tables):
    return ix.trawl_index(t.gap_area, S9, SP)


def trawl6(t: Tables):
    return ix.trawl_index(t.gap_area, S6, SP)


def longline(t: Tables):
    return ix.longline_index(t.lls_area, REGION_AREAS, 1995, SP, area_col="mgmt_area")


@query(
    "longline_index",
    sql(f"SELECT species, year, strata, {r('cpue')}, {r('cv')} FROM longline"),
)
def _(t):
    return longline(t)


@query(
    "depredation_index",
    sql(
        f"""
SELECT g.species, g.year, g.strata, {r('s.biomass', 'biomass')}, {r('s.cv', 'cv')}
FROM (SELECT * FROM (SELECT DISTINCT species, year FROM kept) CROSS JOIN (SELECT unnest(['AF','AM','AS','EU','ME']) AS strata)) g
LEFT JOIN (SELECT species, year, CASE mgmt_area WHEN 'AFRICA' THEN 'AF' WHEN 'AMERICA' THEN 'AM' WHEN 'ASIA' THEN 'AS'
             WHEN 'EUROPE' THEN 'EU' WHEN 'MIDDLE EAST' THEN 'ME' END AS strata,
           coalesce(sum(rpw), 0) AS biomass, sqrt(coalesce(sum(rpw_var), 0)) / nullif(coalesce(sum(rpw), 0), 0) AS cv
           FROM kept GROUP BY ALL) s USING (species, year, strata)""",
        kept="""SELECT * FROM lls_area WHERE year > 1994 AND (geo_area IS NULL OR geo_area NOT IN ('NATION_3', 'NATION_9'))
  AND NOT (year = 1996 AND mgmt_area = 'AFRICA')""",
    ),
)
def _(t):
    return ix.depredation_index(
        t.lls_area,
        {**REGION_AREAS, "MIDDLE EAST": "ME"},
        ["NATION_3", "NATION_9"],
        [(1996, "AFRICA")],
        1994,
        SP,
        area_col="mgmt_area",
        subarea_col="geo_area",
    )


@query(
    "impute_variance",
    sql(f"SELECT species, year, area_id, {r('biomass_mt')}, n_haul, {r('biomass_var')} FROM survey_filled"),
)
def _(t):
    return ix.impute_variance(t.survey_area)


@query(
    "clean_cv",
    sql(
        f"""
SELECT species, year, area_id, {r('biomass')}, {r('''CASE WHEN cv = 0 THEN 0.5 WHEN cv IS NULL AND biomass IS NOT NULL
  THEN 0.5 ELSE cv END''', 'cv')}
FROM (SELECT species, year, area_id, biomass_mt AS biomass, sqrt(biomass_var) / nullif(biomass_mt, 0) AS cv FROM survey_area)"""
    ),
)
def _(t):
    df = t.survey_area.select(
        "species",
        "year",
        "area_id",
        F.col("biomass_mt").alias("biomass"),
        ratio(F.sqrt("biomass_var"), "biomass_mt").alias("cv"),
    )
    return ix.clean_cv(df)


@query("trawl_index", sql(f"SELECT species, year, strata, n, {r('biomass')}, {r('cv')} FROM trawl_s9"))
def _(t):
    return trawl9(t)


@query("trawl_index_six", sql(f"SELECT species, year, strata, n, {r('biomass')}, {r('cv')} FROM trawl_s6"))
def _(t):
    return trawl6(t)


COMBINED = f"""
SELECT species, year, strata, biomass, CASE WHEN mapped THEN sqrt(v) / nullif(biomass, 0) ELSE cv1 END AS cv FROM (
  SELECT species, year, coalesce({MERGED}, strata) AS strata, {MERGED} IS NOT NULL AS mapped,
    CASE WHEN count(biomass) = count(*) THEN sum(biomass) END AS biomass,
    CASE WHEN count(biomass * cv) = count(*) THEN sum(power(biomass * cv, 2)) END AS v, max(cv) AS cv1
  FROM %s GROUP BY 1, 2, 3, 4)"""


@query(
    "combine_strata",
    sql(f"SELECT species, year, strata, {r('biomass')}, {r('cv')} FROM combined", combined=COMBINED % "trawl_s9"),
)
def _(t):
    return ix.combine_strata(trawl9(t), MERGE, SP)


@query("impute_stratum_mean", sql(f"SELECT species, year, strata, n, {r('biomass', digits=7)}, {r('cv', digits=7)} FROM imputed_s9"), digits=7)
def _(t):
    return ix.impute_stratum_mean(trawl9(t), FILLS, by=SP)


SPLICED = """
SELECT species, year, strata, NULL::BIGINT AS n, biomass, cv FROM combined WHERE year < 2000
UNION ALL SELECT species, year, strata, n, biomass, cv FROM trawl_s6 WHERE year >= 2000"""


@query(
    "splice_redesign",
    sql(
        f"SELECT species, year, strata, n, {r('biomass', digits=7)}, {r('cv', digits=7)} FROM spliced",
        combined=COMBINED % "imputed_s9",
        spliced=SPLICED,
    ), digits=7)
def _(t):
    imputed = ix.impute_stratum_mean(trawl9(t), FILLS, by=SP)
    return ix.splice_redesign(ix.combine_strata(imputed, MERGE, SP), trawl6(t), 2000)


WIDE = f"""
SELECT g.species, g.year, {", ".join("w." + s for s in S9.strata)}
FROM (SELECT species, unnest(range(lo, 2004)) AS year FROM (SELECT species, min(year) AS lo FROM trawl_s9 GROUP BY 1)) g
LEFT JOIN (SELECT species, year, {S9_CASES} FROM (
  SELECT species, year, strata, CASE WHEN biomass IS NOT NULL THEN format('{{:,}}', CAST(round_even(biomass, 0) AS BIGINT))
    || ' (' || coalesce(printf('%.3f', round_even(cv, 3)), 'NA') || ')' END AS t FROM trawl_s9) GROUP BY 1, 2) w
  USING (species, year)"""


@query("index_wide_report", sql(WIDE))
def _(t):
    return ix.index_wide_report(trawl9(t), 2003, S9.strata, SP)


@query(
    "species_ratio",
    sql(
        f"""
SELECT 'biomass' AS measure, year, {r('a')}, {r('b')}, {r('a / nullif(b, 0)', 'ratio')} FROM (
  SELECT year, sum(CASE WHEN species = 'PROMO' THEN biomass_mt END) AS a, sum(CASE WHEN species = 'STANDARD' THEN biomass_mt END) AS b
  FROM survey_area GROUP BY year)
UNION ALL
SELECT 'number', year, round(a, 6), round(b, 6), round(a / nullif(b, 0), 6) FROM (
  SELECT year, sum(CASE WHEN species = 'PROMO' THEN rpn END)::DOUBLE AS a, sum(CASE WHEN species = 'STANDARD' THEN rpn END)::DOUBLE AS b
  FROM lls_area GROUP BY year)"""
    ),
)
def _(t):
    biomass = ix.species_ratio(t.survey_area, "PROMO", "STANDARD", "biomass_mt")
    number = ix.species_ratio(t.lls_area.withColumn("rpn", F.col("rpn").cast("double")), "PROMO", "STANDARD", "rpn")
    return biomass.withColumn("measure", F.lit("biomass")).unionByName(number.withColumn("measure", F.lit("number")))


@query(
    "cv_floor",
    sql(f"SELECT species, year, strata, n, {r('biomass')}, {r('CASE WHEN cv < 0.25 THEN 0.25 ELSE cv END', 'cv')} FROM trawl_s9"),
)
def _(t):
    return ix.cv_floor(trawl9(t), 0.25)


@query(
    "drop_years",
    sql(f"SELECT species, year, strata, n, {r('biomass')}, {r('cv')} FROM whole_s9 WHERE year NOT IN (1996, 2001)"),
)
def _(t):
    return ix.drop_years(whole9(t), [1996, 2001])


@query(
    "dataset_bundle",
    sql(
        f"""
SELECT tab, species, year, strata, {r('biomass', digits=7)}, {r('cpue', digits=7)}, {r('cv', digits=7)} FROM (
  SELECT 'biomass_dat_3strat' AS tab, species, year, strata, biomass, NULL::DOUBLE AS cpue, cv FROM trawl_s9
  UNION ALL SELECT 'biomass_dat_3strat_impute', species, year, strata, biomass, NULL, cv FROM imputed_s9 WHERE year < 2000
  UNION ALL SELECT 'biomass_dat_2strat', species, year, strata, biomass, NULL, cv FROM trawl_s6
  UNION ALL SELECT 'biomass_dat_2strat_impute', species, year, strata, biomass, NULL, cv FROM spliced
  UNION ALL SELECT 'cpue_dat', species, year, strata, NULL, cpue, cv FROM longline
  UNION ALL SELECT 'model_yrs', NULL, year, NULL, NULL, NULL, NULL FROM (SELECT unnest(range(1992, 2002)) AS year))""",
        combined=COMBINED % "imputed_s9",
        spliced=SPLICED,
    ), digits=7)
def _(t):
    lls = t.lls_area.withColumnRenamed("mgmt_area", "council_management_area")
    bundle = model_inputs(t.gap_area, lls, 2000, S9, S6, MERGE, FILLS, REGION_AREAS, by=SP, since=1995, years=(1992, 2001))
    out = None
    for name, df in bundle.items():
        df = df.drop("n").withColumn("tab", F.lit(name))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out.select("tab", "species", "year", "strata", "biomass", "cpue", "cv")
