"""Registered queries: model comparison, apportionment, specification, change."""

from pyspark.sql import functions as F

from ..operators import compare as cp
from .cycle import cycle_reports
from .oracle import r, sql
from .q_index import longline, whole6, whole9
from .registry import query
from .standins import MODELS

SP = ["species"]
ORDER = ["EA", "CA", "WA"]
PAIRS = [
    ("small_vs_standard", "SMALL", "STANDARD"),
    ("medium_vs_standard", "MEDIUM", "STANDARD"),
    ("promo_vs_economy", "PROMO", "ECONOMY"),
    ("economy_vs_large", "ECONOMY", "LARGE"),
]
PAIRS_SQL = "SELECT * FROM (VALUES " + ", ".join(f"('{n}','{m}','{b}')" for n, m, b in PAIRS) + ") AS p(model, m, b)"


def area(c="strata"):
    return cp.area_of(c, ["CA", "EA"], "WA")


AREA_SQL = "CASE WHEN contains(strata, 'CA') THEN 'CA' WHEN contains(strata, 'EA') THEN 'EA' ELSE 'WA' END"


def model_columns(value, digits=6):
    return ", ".join(f"round(max(CASE WHEN model_name = '{m}' THEN {value} END), {digits}) + 0.0 AS {m}" for m in MODELS)


@query(
    "extra_cv",
    sql(
        f"""SELECT survey, model_name, strata, year, {r('obs_cv')}, {r('sqrt(exp(power(tot_sd_log_obs, 2)) - 1)', 'tot_cv')},
  {r('sqrt(exp(power(tot_sd_log_obs, 2)) - 1) - obs_cv', 'delta_cv')}
FROM (SELECT 'BTS' AS survey, * FROM fit_by_strata WHERE area <> 'CA' UNION ALL SELECT 'LLS', * FROM fit_by_strata WHERE area = 'CA')"""
    ),
)
def _(t):
    fits = t.fit_by_strata
    out = cp.extra_cv({"BTS": fits.where(F.col("area") != "CA"), "LLS": fits.where(F.col("area") == "CA")})
    return out.select("survey", "model_name", "strata", "year", "obs_cv", "tot_cv", "delta_cv")


@query(
    "prediction_table",
    sql(
        f"""SELECT strata, year, {model_columns('pred')} FROM (
  SELECT strata, year, model_name, pred FROM fit_by_strata
  UNION ALL SELECT 'Total', year, model_name, pred FROM fit_total) GROUP BY strata, year"""
    ),
)
def _(t):
    return cp.prediction_table(t.fit_by_strata, cp.total_prediction(t.fit_by_strata), MODELS)


@query(
    "pivot_model",
    sql(f"SELECT year, {model_columns('pred')} FROM fit_total GROUP BY year"),
)
def _(t):
    return cp.pivot_models(cp.total_prediction(t.fit_by_strata), ["year"], MODELS, "pred")


CHANGES = """
SELECT model, year, (max(CASE WHEN f.model_name = p.m THEN pred END) - max(CASE WHEN f.model_name = p.b THEN pred END))
  / nullif(max(CASE WHEN f.model_name = p.b THEN pred END), 0) * 100 AS pct_change
FROM fit_total f JOIN pair_list p ON f.model_name IN (p.m, p.b) WHERE year < 2001 GROUP BY model, year"""


@query(
    "pct_change_vs_base",
    sql(f"SELECT model, year, {r('pct_change')} FROM changes", changes=CHANGES, pair_list=PAIRS_SQL),
)
def _(t):
    return cp.pct_change_vs_base(cp.total_prediction(t.fit_by_strata), PAIRS, 2001)


@query(
    "mean_pct_change",
    sql(
        f"SELECT model, {r('avg(pct_change)', 'mean_pct_change')} FROM changes WHERE year > 1996 GROUP BY model",
        changes=CHANGES,
        pair_list=PAIRS_SQL,
    ),
)
def _(t):
    return cp.mean_pct_change(cp.pct_change_vs_base(cp.total_prediction(t.fit_by_strata), PAIRS, 2001), 1996)


@query(
    "previous_assessment_change",
    sql(
        f"""SELECT model_name, year, {r('n.pred', 'pred_new')}, {r('o.pred', 'pred_old')},
  {r('(n.pred - o.pred) / nullif(o.pred, 0) * 100', 'pct_change')}
FROM fit_total n JOIN (SELECT model_name, year, sum(pred_lci) AS pred FROM fit_by_strata GROUP BY ALL) o
  USING (model_name, year) WHERE year < 2000"""
    ),
)
def _(t):
    old = t.fit_by_strata.groupBy("model_name", "year").agg(F.sum("pred_lci").alias("pred"))
    return cp.previous_assessment_change(cp.total_prediction(t.fit_by_strata), old, 2000, ["model_name"])


def appo(t):
    return cp.apportionment(t.fit_by_strata, "area", ORDER, MODELS)


@query(
    "apportionment",
    sql(
        f"""SELECT model_name, area, year, {r('stratum_biomass')}, {r('total_biomass')}, {r('proportion')},
  list_position(['EA', 'CA', 'WA'], area) AS ord FROM apportioned"""
    ),
)
def _(t):
    return appo(t)


@query(
    "partition_total_share",
    sql(
        f"""SELECT model_name, strata, year, {r('pred')}, {r('sum(pred) OVER w', 'total')}, {r('pred / nullif(sum(pred) OVER w, 0)', 'share')}
FROM fit_by_strata WINDOW w AS (PARTITION BY model_name, year)"""
    ),
)
def _(t):
    from ..operators.depth import share_of_partition

    df = t.fit_by_strata.select("model_name", "strata", "year", "pred")
    return share_of_partition(df, ["model_name", "year"], "pred", "total", "share")


@query(
    "recode_pattern",
    sql(
        f"""SELECT model_name, {AREA_SQL} AS area, year, {r('sum(pred)', 'stratum_biomass')} FROM fit_by_strata
GROUP BY model_name, {AREA_SQL}, year"""
    ),
)
def _(t):
    return cp.apportionment(t.fit_by_strata, area()).select("model_name", "area", "year", "stratum_biomass")


@query(
    "apportionment_wide",
    sql(f"SELECT area, year, {model_columns('proportion')} FROM apportioned GROUP BY area, year"),
)
def _(t):
    return cp.apportionment_wide(appo(t), MODELS)


@query(
    "region_rollup",
    sql(
        f"""SELECT model_name, year, CASE WHEN area IN ('CA', 'WA') THEN 'GULF' ELSE area END AS region,
  {r('sum(stratum_biomass)', 'biomass')}, {r('sum(proportion)', 'proportion')} FROM apportioned GROUP BY ALL"""
    ),
)
def _(t):
    return cp.region_rollup(appo(t), {"CA": "GULF", "WA": "GULF"})


@query(
    "harvest_spec",
    sql(
        f"""SELECT DISTINCT model_name, year, {r('total_biomass', 'biomass', 9)}, {r('0.03 * total_biomass', 'ofl', 9)},
  {r('0.75 * 0.03 * total_biomass', 'max_abc', 9)}, {r('0.75 * 0.03 * total_biomass', 'abc', 9)}
FROM apportioned WHERE year = 2000"""
    ), digits=9)
def _(t):
    return cp.harvest_spec(appo(t), 2000)


def _change(source, by, value, group):
    year_sum = "CASE WHEN count(CASE WHEN year = {y} THEN 1 END) > 0 THEN coalesce(sum(CASE WHEN year = {y} THEN {v} END), 0) END"
    v0, v1 = year_sum.format(y=1997, v=value), year_sum.format(y=1999, v=value)
    return f"""SELECT {by}, {r('v0')}, {r('v1')}, {r('(v1 - v0) / nullif(v0, 0)', 'frac_change')} FROM (
  SELECT {by}, {v0} AS v0, {v1} AS v1 FROM {source} WHERE year IN (1997, 1999) GROUP BY {group})"""


@query(
    "stratum_change",
    sql(
        f"""SELECT 'trawl' AS survey, * FROM ({_change(f'(SELECT *, {AREA_SQL} AS area FROM whole_s9)', 'species, area', 'biomass', 'species, area')})
UNION ALL SELECT 'longline', * FROM ({_change('(SELECT *, strata AS area FROM longline)', 'species, area', 'cpue', 'species, area')})"""
    ),
)
def _(t):
    trawl = cp.stratum_change(whole9(t), 1997, 1999, "biomass", area(), SP)
    lls = cp.stratum_change(longline(t), 1997, 1999, "cpue", "strata", SP)
    return trawl.withColumn("survey", F.lit("trawl")).unionByName(lls.withColumn("survey", F.lit("longline")))


@query(
    "pivot_year",
    sql(
        f"""SELECT model_name, strata, {r('max(CASE WHEN year = 1997 THEN pred END)', 'y1997')}, {r('max(CASE WHEN year = 1999 THEN pred END)', 'y1999')}
FROM fit_by_strata GROUP BY model_name, strata"""
    ),
)
def _(t):
    year = F.col("year")
    return t.fit_by_strata.groupBy("model_name", "strata").agg(
        F.max(F.when(year == 1997, F.col("pred"))).alias("y1997"), F.max(F.when(year == 1999, F.col("pred"))).alias("y1999")
    )


@query("total_change", sql(_change("whole_s9", "species", "biomass", "species")))
def _(t):
    return cp.total_change(whole9(t), 1997, 1999, "biomass", SP)


@query(
    "total_change_from_prior",
    sql(
        f"""SELECT model_name, year, {r('pred')}, {r('(pred - 59459) / 59459', 'frac_change')} FROM fit_total WHERE year = 2000"""
    ),
)
def _(t):
    return cp.change_from_prior(cp.total_prediction(t.fit_by_strata), 2000, 59459)


@query(
    "total_change_between_models",
    sql(
        f"""SELECT a.year, {r('a.pred', 'new')}, {r('b.pred', 'old')}, {r('(a.pred - b.pred) / b.pred', 'frac_change')}
FROM fit_total a JOIN fit_total b USING (year) WHERE year = 2000 AND a.model_name = 'PROMO' AND b.model_name = 'LARGE'"""
    ),
)
def _(t):
    return cp.change_between_models(cp.total_prediction(t.fit_by_strata), 2000, "PROMO", "LARGE")


@query(
    "ratio_to_longterm_mean",
    sql(
        f"""SELECT species, {r('t', 'year_total', 7)}, {r('m', 'mean_total', 7)}, {r('t / nullif(m, 0)', 'ratio', 7)} FROM (
  SELECT species, max(CASE WHEN year = 1999 THEN b END) AS t, avg(b) AS m FROM (
    SELECT species, year, coalesce(sum(biomass), 0) AS b FROM whole_s6 WHERE contains(strata, '0_700') GROUP BY species, year)
  GROUP BY species)"""
    ), digits=7)
def _(t):
    return cp.ratio_to_longterm_mean(whole6(t), 1999, "biomass", "0_700", SP)


def _report_cols():
    out = []
    for a in ("WA", "CA", "EA"):
        for src, suffix in (("pred", ""), ("pred_lci", "_lci"), ("pred_uci", "_uci")):
            out.append(
                f"round_even(CASE WHEN count(CASE WHEN area = '{a}' THEN 1 END) > 0 THEN "
                f"coalesce(sum(CASE WHEN area = '{a}' THEN {src} END), 0) END, 0) + 0.0 AS {a}{suffix}"
            )
    return ", ".join(out)


@query(
    "strata_report",
    sql(f"SELECT model_name, year, {_report_cols()} FROM fit_by_strata GROUP BY model_name, year"),
)
def _(t):
    return cp.strata_report(t.fit_by_strata, ["WA", "CA", "EA"], MODELS)


@query(
    "total_report",
    sql(
        f"""SELECT model_name, year, {r('pred', digits=7)}, {r('pred_lci', digits=7)}, {r('pred_uci', digits=7)}, round_even(pred, 0) + 0.0 AS total,
  round_even(pred_lci, 0) + 0.0 AS lci, round_even(pred_uci, 0) + 0.0 AS uci FROM fit_total"""
    ), digits=7)
def _(t):
    return cp.total_report(cp.total_prediction(t.fit_by_strata), MODELS)


def _long_sql(report, source, who, area, year, *values):
    """Rows of one report by measure, as ``unpivot`` makes them."""
    return " UNION ALL ".join(
        f"SELECT '{report}' AS report, {who} AS who, {area} AS area, {year} AS year, '{name}' AS measure, {r(expr, 'value', 7)} FROM {source}"
        for name, expr in values
    )


def _ratio_sql(source, value, where="true"):
    return f"""(SELECT species, max(CASE WHEN year = 1999 THEN b END) AS t, avg(b) AS m FROM (
  SELECT species, year, coalesce(sum({value}), 0) AS b FROM {source} WHERE {where} GROUP BY species, year) GROUP BY species)"""


CHANGE = [("v0", "v0"), ("v1", "v1"), ("frac_change", "(v1 - v0) / nullif(v0, 0)")]
TO_MEAN = [("year_total", "t"), ("mean_total", "m"), ("ratio", "t / nullif(m, 0)")]
SPEC = [("biomass", "total_biomass"), ("ofl", "0.03 * total_biomass"), ("max_abc", "0.0225 * total_biomass"), ("abc", "0.0225 * total_biomass")]


def _sums_sql(source, by, value, strict=False):
    """Two years side by side."""
    out = []
    for y in (1997, 1999):
        here = f"CASE WHEN year = {y} THEN {value} END"
        n = f"count(CASE WHEN year = {y} THEN 1 END)"
        full = f"{n} = count({here})" if strict else "true"
        out.append(f"CASE WHEN {n} > 0 AND {full} THEN coalesce(sum({here}), 0) END AS v{len(out)}")
    return f"(SELECT {by}, {', '.join(out)} FROM {source} WHERE year IN (1997, 1999) GROUP BY {by})"


def _cycle_sql():
    six = f"(SELECT *, {AREA_SQL} AS area FROM whole_s6)"
    per_area = "(SELECT model_name, year, area, coalesce(sum(pred), 0) AS p, coalesce(sum(pred_lci), 0) AS l, coalesce(sum(pred_uci), 0) AS u FROM fit_by_strata GROUP BY ALL)"
    pivot = [(f"{a}{x}", f"round_even(max(CASE WHEN area = '{a}' THEN {c} END), 0)") for a in ORDER for x, c in (("", "p"), ("_lci", "l"), ("_uci", "u"))]
    grouped = f"(SELECT model_name, year, {', '.join(f'{e} AS {n}' for n, e in pivot)} FROM {per_area} GROUP BY model_name, year)"
    wide = f"(SELECT area, year, {model_columns('proportion', 12)} FROM apportioned GROUP BY area, year)"
    spec = "(SELECT DISTINCT model_name, year, total_biomass FROM apportioned WHERE year = 2000)"
    parts = [
        ("apportionment", "apportioned", "model_name", "area", "year", *[(c, c) for c in ("stratum_biomass", "total_biomass", "proportion")]),
        ("apportionment_wide", wide, "NULL", "area", "year", *[(m, m) for m in MODELS]),
        ("harvest_spec", spec, "model_name", "NULL", "year", *SPEC),
        ("strata_report", grouped, "model_name", "NULL", "year", *[(n, n) for n, _ in pivot]),
        ("total_report", "fit_total", "model_name", "NULL", "year", ("total", "round_even(pred, 0)"), ("lci", "round_even(pred_lci, 0)"), ("uci", "round_even(pred_uci, 0)")),
        ("trawl_area_change", _sums_sql(six, "species, area", "biomass"), "species", "area", "NULL", *CHANGE),
        ("trawl_total_change", _sums_sql(six, "species", "biomass"), "species", "NULL", "NULL", *CHANGE),
        ("trawl_to_mean", _ratio_sql(six, "biomass", "contains(strata, '0_700')"), "species", "NULL", "NULL", *TO_MEAN),
        ("longline_area_change", _sums_sql("(SELECT *, strata AS area FROM longline)", "species, area", "cpue"), "species", "area", "NULL", *CHANGE),
        ("longline_total_change", _sums_sql("longline", "species", "cpue", True), "species", "NULL", "NULL", *CHANGE),
        ("longline_to_mean", _ratio_sql("longline", "cpue"), "species", "NULL", "NULL", *TO_MEAN),
        ("change_from_prior", "(SELECT * FROM fit_total WHERE year = 1999)", "model_name", "NULL", "year", ("pred", "pred"), ("frac_change", "(pred - 59459) / 59459")),
    ]
    return " UNION ALL ".join(_long_sql(*p) for p in parts)


@query("cycle_reports", sql(_cycle_sql()), digits=7)
def _(t):
    fits = t.fit_by_strata
    reports = cycle_reports(
        fits, cp.total_prediction(fits), whole6(t), longline(t), MODELS, ORDER, area(), (1997, 1999), 2000, prior=59459, by=SP
    )
    reports["apportionment"] = reports["apportionment"].drop("ord")
    reports["total_report"] = reports["total_report"].drop("pred", "pred_lci", "pred_uci")
    keys, out = {"model_name": "who", "species": "who", "area": "area", "year": "year"}, None
    for name, df in reports.items():
        ids = [c for c in df.columns if c in keys]
        rows = df.unpivot(ids, [c for c in df.columns if c not in keys], "measure", "value").withColumnsRenamed(keys)
        rows = rows.withColumn("report", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.select("report", "who", "area", "year", "measure", "value")
