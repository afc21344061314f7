"""Registered queries: catch accounting and the status report."""

from pyspark.sql import functions as F

from ..operators import catch as ct
from .oracle import r, sql
from .registry import query

GROUPS = {"1-URGENT": "trawl", "2-HIGH": "trawl", "3-MEDIUM": "longline"}


def tidy(t):
    return ct.tidy_catch(t.catch_blend, subarea="subarea", gear="gear", target="target")


@query("catch_by_area", sql(f"SELECT year, area, retention, {r('catch')} FROM area_catch"))
def _(t):
    return ct.catch_by_area(tidy(t))


GRAINS_SQL = """
SELECT CASE grouping(year, area, retention, gear, target) WHEN 3 THEN 'area_retention' WHEN 11 THEN 'retention'
    WHEN 15 THEN 'year' WHEN 13 THEN 'gear' WHEN 14 THEN 'target' END AS grain, year, area, retention, gear, target,
  CASE WHEN count(weight) = count(*) THEN sum(weight) END AS catch
FROM tidy_catch GROUP BY GROUPING SETS ((year, area, retention), (year, retention), (year), (year, gear), (year, target))"""


@query(
    "multi_grain_totals",
    sql(f"SELECT grain, year, area, retention, gear, target, {r('catch')} FROM grains", grains=GRAINS_SQL),
)
def _(t):
    return ct.catch_totals(tidy(t), None)


@query(
    "catch_totals",
    sql(
        f"""SELECT grain, year, area, retention, gear, target,
  {r("CASE WHEN grain = 'year' THEN round_even(catch, 2) ELSE catch END", 'catch')} FROM grains""",
        grains=GRAINS_SQL,
    ),
)
def _(t):
    return ct.catch_totals(tidy(t))


@query(
    "catch_by_gear_group",
    sql(
        f"""SELECT year, g AS gear, retention, {r('sum(weight)', 'catch')} FROM (
  SELECT *, CASE WHEN gear IN ('1-URGENT', '2-HIGH') THEN 'trawl' WHEN gear = '3-MEDIUM' THEN 'longline' END AS g FROM tidy_catch)
WHERE g IS NOT NULL GROUP BY year, g, retention"""
    ),
)
def _(t):
    return ct.catch_by_gear_group(tidy(t), GROUPS)


@query(
    "discards_by_target",
    sql(
        f"SELECT year, target, {r('sum(weight)', 'catch')} FROM tidy_catch WHERE retention = 'Discarded' GROUP BY year, target"
    ),
)
def _(t):
    return ct.discards_by_target(tidy(t))


def limits(t):
    return ct.area_limits(
        t.limits, {"AFRICA": "AFRICA", "AMERICA": "AMERICA", "ASIA": "ASIA"}, "EUROPE", "MIDDLE EAST", "area", "abc"
    )


LIMITS = """SELECT year, area, abc FROM limits WHERE area <> 'MIDDLE EAST'"""


@query(
    "catch_vs_limit",
    sql(
        f"""SELECT l.year, l.area, {r('l.abc', 'abc', 7)}, c.retention, {r('c.catch', 'catch', 7)}
FROM lim l LEFT JOIN area_catch c USING (year, area) WHERE l.year > 1995 AND l.year < 2001""",
        lim=LIMITS,
    ), digits=7)
def _(t):
    return ct.catch_vs_limit(limits(t), ct.catch_by_area(tidy(t)), 1995, 2001)


@query(
    "limit_vs_actual",
    sql(
        f"""SELECT l.year, l.area, {r('l.abc', 'abc', 7)}, {r('l.ofl', 'ofl', 7)}, c.retention, {r('c.catch', 'catch', 7)}
FROM limits l LEFT JOIN area_catch c USING (year, area)"""
    ), digits=7)
def _(t):
    actual = ct.catch_by_area(tidy(t))
    return t.limits.join(actual, ["year", "area"], "left")


# --- status report -----------------------------------------------------------


def report_inputs(t):
    fits = t.fit_by_strata
    upper = fits.where(F.col("area") != "EA").groupBy("year").agg(F.sum("pred").alias("biomass"))
    lower = fits.where(F.col("area") == "EA").groupBy("year").agg(F.sum("pred").alias("biomass"))
    survey = t.survey_area.select(F.col("area_id").alias("species_code"), "year", F.col("biomass_mt").alias("area_biomass"))
    tiers = t.base("part").select(F.col("p_size").alias("species_code"), (F.col("p_size") % 7).alias("tier")).distinct()
    catch = t.catch_blend.select(
        F.col("year").cast("int").alias("year"),
        F.substring("gear", 1, 1).cast("int").alias("cas_code"),
        F.col("subarea").alias("fmp_subarea"),
        F.col("weight_posted").alias("tot_catch"),
    )
    biomass = ct.stack_biomass([upper, lower])
    series = ct.survey_series(survey, tiers, [4, 5], 1996)
    exclusions = [
        ct.exclude_codes("cas_code", [3], "fmp_subarea", ["AFRICA", "ASIA"]),
        ct.exclude_codes("cas_code", [1, 5], "fmp_subarea", ["EUROPE"]),
    ]
    yearly = ct.catch_series(catch, exclusions, 1996)
    lim = t.limits.groupBy("year").agg(F.sum("ofl").alias("total")).withColumn("hl", F.lit("OFL"))
    return biomass, series, yearly, lim


BIOMASS = "SELECT year, round_even(coalesce(sum(pred), 0), 0) AS biomass FROM fit_by_strata GROUP BY year"
SURVEY = """SELECT year, round_even(coalesce(sum(biomass_mt), 0), 0) AS survey_biomass FROM survey_area
WHERE year >= 1996 AND area_id % 7 IN (4, 5) GROUP BY year"""
YEARLY = """SELECT CAST(year AS INTEGER) AS year, round_even(coalesce(sum(weight_posted), 0), 0) AS catch FROM catch_blend
WHERE CAST(year AS INTEGER) >= 1996 AND NOT (left(gear, 1) = '3' AND subarea IN ('AFRICA', 'ASIA'))
  AND NOT (left(gear, 1) IN ('1', '5') AND subarea = 'EUROPE') GROUP BY 1"""
STATIC = {"STOCK": "AB1", "STOCK_NAME": "STAND-IN STOCK", "REGION": "ALL", "TIER": "5"}


def _values(col, view):
    return f"(SELECT string_agg(CAST(CAST({col} AS BIGINT) AS VARCHAR), ' ' ORDER BY year) FROM {view})"


# The tags of the report format in its order, written out apart from the operator's.
TAGS_IN_ORDER = " ".join("""
STOCK STOCK_NAME REGION ASMT_TYPE ASMT_YEAR ASMT_MONTH TIER NUM_SEXES NUM_FISHERIES REC_MULT RECAGE COMPLEX
LAST_DATA_YEAR ASMT_MODEL_CATEGORY ASMT_MODEL MODEL_VERSION ENSEMBLE LEAD_LAB POC_EMAIL REVIEW_RESULT
CATCH_INPUT_DATA ABUNDANCE_INPUT_DATA BIOLOGICAL_INPUT_DATA SIZEAGE_COMP_INPUT_DATA ECOSYSTEM_LINKAGE
FISHING_MORTALITY_ESTIMATES F_YEAR F_BASIS F_UNIT BEST_F_ESTIMATE F_LIMIT F_LIMIT_BASIS F_MSY F_MSY_BASIS
BIOMASS_ESTIMATES B_YEAR B_BASIS B_UNIT BEST_B_ESTIMATE LOWER_B_ESTIMATE UPPER_B_ESTIMATE ESTIMATE_METHOD
INTERVAL_SIZE B_MSY B_MSY_BASIS
TIME_SERIES_ESTIMATES FISHERYYEAR AGE RECRUITMENT SPAWNBIOMASS TOTALBIOMASS TOTFSHRYMORT TOTALCATCH SURVEYDESC
STOCKNOTES SURVEY_ESTIMATES
""".split())
REPORT = f"""
SELECT ord, tag, CASE WHEN tag IN ('FISHING_MORTALITY_ESTIMATES', 'BIOMASS_ESTIMATES', 'TIME_SERIES_ESTIMATES') THEN NULL ELSE coalesce(CASE tag
  WHEN 'STOCK' THEN 'AB1' WHEN 'STOCK_NAME' THEN 'STAND-IN STOCK' WHEN 'REGION' THEN 'ALL' WHEN 'TIER' THEN '5'
  WHEN 'ASMT_YEAR' THEN '1998' WHEN 'F_YEAR' THEN '1997'
  WHEN 'LAST_DATA_YEAR' THEN (SELECT CAST(max(year) AS VARCHAR) FROM rep_biomass)
  WHEN 'B_YEAR' THEN (SELECT CAST(max(year) AS VARCHAR) FROM rep_biomass)
  WHEN 'BEST_B_ESTIMATE' THEN (SELECT CAST(CAST(arg_max(biomass, year) AS BIGINT) AS VARCHAR) FROM rep_biomass)
  WHEN 'BEST_F_ESTIMATE' THEN (SELECT CAST(CAST(catch AS BIGINT) AS VARCHAR) FROM rep_catch WHERE year = 1997)
  WHEN 'F_LIMIT' THEN (SELECT CAST(CAST(trunc(sum(ofl)) AS BIGINT) AS VARCHAR) FROM limits WHERE year = 1998)
  WHEN 'F_MSY' THEN (SELECT CAST(CAST(trunc(sum(ofl)) AS BIGINT) AS VARCHAR) FROM limits WHERE year = 1998)
  WHEN 'FISHERYYEAR' THEN {_values('year', 'rep_biomass')}
  WHEN 'TOTALBIOMASS' THEN {_values('biomass', 'rep_biomass')}
  WHEN 'TOTALCATCH' THEN {_values('catch', 'rep_catch')}
  WHEN 'SURVEY_ESTIMATES' THEN {_values('survey_biomass', 'rep_survey')} END, 'NA') END AS value
FROM (SELECT unnest(string_split('{TAGS_IN_ORDER}', ' ')) AS tag, unnest(range(1, {TAGS_IN_ORDER.count(' ') + 2})) AS ord)"""
REPORT_VIEWS = {"rep_biomass": BIOMASS, "rep_survey": SURVEY, "rep_catch": YEARLY}


@query("status_report", sql(REPORT, **REPORT_VIEWS))
def _(t):
    return ct.status_report(*report_inputs(t), 1998, STATIC)


@query("full_outer_stack", sql(f"SELECT year, {r('biomass')} FROM rep_biomass", **REPORT_VIEWS))
def _(t):
    return report_inputs(t)[0]


@query("lookup_join", sql(f"SELECT year, {r('survey_biomass')} FROM rep_survey", **REPORT_VIEWS))
def _(t):
    return report_inputs(t)[1]


@query("filter_compound_not", sql(f"SELECT year, {r('catch')} FROM rep_catch", **REPORT_VIEWS))
def _(t):
    return report_inputs(t)[2]


@query(
    "filter_latest",
    sql(
        f"""SELECT year, area, retention, {r('catch')} FROM area_catch WHERE year = (SELECT max(year) FROM area_catch)"""
    ),
)
def _(t):
    return ct.latest_rows(ct.catch_by_area(tidy(t)))
