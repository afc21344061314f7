"""Registered queries: simulation, posterior, scenario, retrospective and smoothing."""

from pyspark.sql import functions as F

from ..functions.joins import salted_join
from ..functions.nulls import ratio
from ..functions.ranking import exact_quantiles, grid_probs, positions
from ..functions.text import one_decimal
from ..operators import catch as ct
from ..operators import infer as nf
from ..operators import length as ln
from ..sources.lookups import recode
from .oracle import r, smoothed, sql
from .q_catch import tidy
from .q_index import longline, trawl6, trawl9
from .registry import query

SP = ["species"]
STRATA = ["WA_WA_0_700", "CA_CA_0_700", "EA_EA_0_700", "WA_WA_701_1000", "CA_CA_701_1000", "EA_EA_701_1000"]
NAMES = {"V1": "log_PE", "V2": "log_q"}
PAIRS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{a}', '{b}')" for i, a in enumerate(STRATA) for b in STRATA[i:]
) + ") AS p(strata_a, strata_b)"


def _pair_sql(fn, value):
    return f"""
SELECT model_name, strata_a, strata_b, round(CASE WHEN isfinite({fn}) THEN {fn} END, 6) + 0.0 AS {'corr' if 'corr' in fn else 'covar_samp'}
FROM (SELECT DISTINCT model_name FROM fit_by_strata) CROSS JOIN pair_list p
LEFT JOIN (SELECT a.model_name, a.strata AS strata_a, b.strata AS strata_b, {value.format('a')} AS x, {value.format('b')} AS y
  FROM fit_by_strata a JOIN fit_by_strata b USING (model_name, year) WHERE a.pred IS NOT NULL AND b.pred IS NOT NULL)
  USING (model_name, strata_a, strata_b)
GROUP BY model_name, strata_a, strata_b"""


@query("strata_correlation", sql(_pair_sql("corr(x, y)", "{}.pred"), pair_list=PAIRS_SQL))
def _(t):
    return nf.strata_correlation(t.fit_by_strata, STRATA, by=["model_name"])


@query("corr_matrix", sql(_pair_sql("corr(x, y)", "ln({}.pred)"), pair_list=PAIRS_SQL))
def _(t):
    return nf.strata_correlation(t.fit_by_strata.withColumn("pred", F.ln("pred")), STRATA, by=["model_name"])


@query("log_covariance", sql(_pair_sql("covar_samp(x, y)", "ln({}.pred)"), pair_list=PAIRS_SQL))
def _(t):
    return nf.log_covariance(t.fit_by_strata, STRATA, ["model_name"])


ERRORS = """SELECT r.parameter, replicate, estimate, model, (model - estimate) / nullif(model, 0) * 100 AS re
FROM recovered r JOIN true_values USING (parameter)"""


@query(
    "relative_error",
    sql(
        f"""SELECT e.parameter, replicate, {r('estimate')}, {r('model')}, {r('re')}, {r('share_missing')}, {r('median_re')},
  'Median RE=' || printf('%.1f', round_even(median_re, 1)) || '%' AS label
FROM errors e JOIN (SELECT parameter, avg(CAST(estimate IS NULL AS INTEGER)) AS share_missing, median(re) AS median_re
  FROM errors GROUP BY parameter) USING (parameter)""",
        errors=ERRORS,
    ),
)
def _(t):
    return nf.relative_error(t.true_values, t.recovered)


@query(
    "param_self_join",
    sql(f"SELECT parameter, replicate, {r('estimate')}, {r('model')}, {r('re')} FROM errors", errors=ERRORS),
)
def _(t):
    paired = salted_join(t.recovered, t.true_values, ["parameter"], "inner")
    return paired.withColumn("re", ratio(F.col("model") - F.col("estimate"), "model") * 100)


@query(
    "median_by",
    sql(f"SELECT parameter, count(estimate) AS n, {r('median(estimate)', 'median')} FROM recovered GROUP BY parameter"),
)
def _(t):
    return exact_quantiles(t.recovered, ["parameter"], "estimate", [0.5], few_groups=True).select("parameter", "n", F.col("q").alias("median"))


@query(
    "partition_median_label",
    sql(
        f"""SELECT parameter, replicate, {r('estimate')}, {r('median(estimate) OVER (PARTITION BY parameter)', 'median')},
  'Median=' || printf('%.1f', round_even(median(estimate) OVER (PARTITION BY parameter), 1)) AS label FROM recovered"""
    ),
)
def _(t):
    med = exact_quantiles(t.recovered, ["parameter"], "estimate", [0.5], few_groups=True).select("parameter", F.col("q").alias("median"))
    return salted_join(t.recovered, med.withColumn("label", one_decimal("median", "Median=")), ["parameter"])


@query(
    "share_missing",
    sql(
        f"""SELECT parameter, count(*) AS n, count(*) - count(estimate) AS n_missing,
  {r('(count(*) - count(estimate)) / count(*)', 'share_missing')} FROM recovered GROUP BY parameter"""
    ),
)
def _(t):
    gone = F.col("estimate").isNull().cast("int")
    return t.recovered.groupBy("parameter").agg(
        F.count("*").alias("n"), F.sum(gone).alias("n_missing"), F.avg(gone).alias("share_missing")
    )


@query(
    "recovered_box",
    sql(
        f"""SELECT parameter, count(estimate) AS n, {r('q1')}, {r('q2', 'median')}, {r('q3')},
  {r('min(CASE WHEN estimate >= q1 - (q3 - q1) * 1.5 AND estimate <= q3 + (q3 - q1) * 1.5 THEN estimate END)', 'whisker_low')},
  {r('max(CASE WHEN estimate >= q1 - (q3 - q1) * 1.5 AND estimate <= q3 + (q3 - q1) * 1.5 THEN estimate END)', 'whisker_high')},
  count(CASE WHEN NOT (estimate >= q1 - (q3 - q1) * 1.5 AND estimate <= q3 + (q3 - q1) * 1.5) THEN 1 END) AS outliers
FROM recovered JOIN (SELECT parameter, quantile_cont(estimate, 0.25) AS q1, quantile_cont(estimate, 0.5) AS q2,
  quantile_cont(estimate, 0.75) AS q3 FROM recovered GROUP BY parameter) USING (parameter) GROUP BY parameter, q1, q2, q3"""
    ),
)
def _(t):
    return ln.box_stats(t.recovered, ["parameter"], "estimate")


PROBS = "[" + ", ".join(str(p) for p in grid_probs()) + "]"
LONG = """SELECT sampler, draw_id, 'log_PE' AS parameter, V1 AS value FROM draws
UNION ALL SELECT sampler, draw_id, 'log_q', V2 FROM draws"""


@query(
    "quantile_grid",
    sql(
        f"""SELECT parameter, prob, count AS n, {r('q')} FROM (
  SELECT parameter, count(estimate) AS count, unnest({PROBS}::DOUBLE[]) AS prob, unnest(quantile_cont(estimate, {PROBS})) AS q
  FROM recovered GROUP BY parameter)"""
    ),
)
def _(t):
    return exact_quantiles(t.recovered, ["parameter"], "estimate", grid_probs(), few_groups=True)


@query(
    "posterior_qq",
    sql(
        f"""SELECT parameter, quant, {r("max(CASE WHEN sampler = 'click' THEN q END)", 'a')}, {r("max(CASE WHEN sampler = 'view' THEN q END)", 'b')}
FROM (SELECT sampler, parameter, unnest({PROBS}::DOUBLE[]) AS quant, unnest(quantile_cont(value, {PROBS})) AS q
  FROM long_draws GROUP BY sampler, parameter) GROUP BY parameter, quant""",
        long_draws=LONG,
    ),
)
def _(t):
    return nf.posterior_qq(t.draw_values, NAMES, ("click", "view"))


CHAINS = """SELECT d.*, per AS draws_per_chain, draw_id // per + 1 AS chain, draw_id % per + 1 AS iter
FROM draws d JOIN (SELECT sampler, CAST(ceil(count(*) / 3.0) AS BIGINT) AS per FROM draws GROUP BY sampler) USING (sampler)"""


@query(
    "chain_index",
    sql(f"SELECT sampler, draw_id, {r('V1')}, {r('V2')}, draws_per_chain, chain, iter FROM chains", chains=CHAINS),
)
def _(t):
    return nf.chain_index(t.draws, 3, ["sampler"], values=t.draw_values)


@query(
    "row_positions",
    sql("SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS before FROM events"),
)
def _(t):
    return positions(t.base("events").select("event_type", "event_id"), ["event_type"], "event_id")


SUMMARY = """
SELECT sampler, parameter, median, lower, upper, rhat FROM (
  SELECT sampler, parameter, median(value) AS median, quantile_cont(value, 0.025) AS lower, quantile_cont(value, 0.975) AS upper
  FROM chain_long GROUP BY sampler, parameter)
JOIN (SELECT sampler, parameter, sqrt(((avg(n) - 1) / avg(n) * avg(v) + var_samp(m)) / avg(v)) AS rhat FROM (
  SELECT sampler, parameter, chain, iter <= draws_per_chain / 2.0 AS half, avg(value) AS m, var_samp(value) AS v, count(value) AS n
  FROM chain_long GROUP BY ALL) GROUP BY sampler, parameter) USING (sampler, parameter)
UNION ALL
SELECT 'point fit', parameter, est, est - 1.96 * sd, est + 1.96 * sd, NULL FROM (
  SELECT parameter, avg(estimate) AS est, stddev_samp(estimate) AS sd FROM recovered GROUP BY parameter)"""


@query(
    "posterior_summary",
    sql(
        f"SELECT sampler, parameter, {r('median')}, {r('lower')}, {r('upper')}, {r('rhat')} FROM summ",
        summ=SUMMARY,
        chains=CHAINS,
        chain_long="""SELECT sampler, chain, iter, draws_per_chain, 'log_PE' AS parameter, V1 AS value FROM chains
UNION ALL SELECT sampler, chain, iter, draws_per_chain, 'log_q', V2 FROM chains""",
    ),
)
def _(t):
    point = t.recovered.groupBy("parameter").agg(F.avg("estimate").alias("est"), F.stddev_samp("estimate").alias("sd"))
    return nf.posterior_summary(t.draws, NAMES, point, values=t.draw_values)


SCENARIOS = [
    nf.Scenario("a_base", "three", 1995, 2000),
    nf.Scenario("c_drop", "three", 1995, 2000, (1996, 1998)),
    nf.Scenario("f_two", "two", 1996, 2001, (2001,), None, {"WA_701_1000": "deep", "CA_701_1000": "deep", "EA_701_1000": "deep"}),
    nf.Scenario("i_floor", "two", 1995, 2001, (), 0.25, {}, {"WA_0_700": "west"}),
]
STRATA_AREA = {s: s[:2] for s in ("WA_0_500 CA_0_500 EA_0_500 WA_501_700 CA_501_700 EA_501_700 WA_701_1000 CA_701_1000 "
                                  "EA_701_1000 WA_0_700 CA_0_700 EA_0_700").split()}


@query(
    "scenario_fanout",
    sql(
        f"""
SELECT scenario, dataset, species, year, strata, n, {r('biomass')}, {r('CASE WHEN cv < lowest THEN lowest ELSE cv END', 'cv')},
  CASE WHEN scenario = 'f_two' AND contains(strata, '701_1000') THEN 'deep' ELSE 'all' END AS pe_group,
  CASE WHEN scenario = 'i_floor' AND strata = 'WA_0_700' THEN 'west' ELSE left(strata, 2) END AS q_group
FROM (SELECT 'three' AS dataset, * FROM trawl_s9 UNION ALL SELECT 'two', * FROM trawl_s6)
JOIN (VALUES ('a_base', 'three', 1995, 2000, []::INTEGER[], NULL::DOUBLE), ('c_drop', 'three', 1995, 2000, [1996, 1998], NULL),
  ('f_two', 'two', 1996, 2001, [2001], NULL), ('i_floor', 'two', 1995, 2001, [], 0.25)) s(scenario, dataset, y0, y1, gone, lowest)
  USING (dataset)
WHERE year BETWEEN y0 AND y1 AND NOT list_contains(gone, year)"""
    ),
)
def _(t):
    data = trawl9(t).withColumn("dataset", F.lit("three")).unionByName(trawl6(t).withColumn("dataset", F.lit("two")))
    return nf.scenario_fanout(data, SCENARIOS, STRATA_AREA)


def smooth_cols(*keys):
    return f"{', '.join(keys)}, strata, year, {r('pred')}, {r('se')}, {r('pred_lci')}, {r('pred_uci')}, {r('ln_pe')}, {r('loglik')}"


@query(
    "smooth_index",
    sql(f"SELECT {smooth_cols('species')} FROM sm", **smoothed("trawl_s9", SP, 1994, 2003, "biomass", "cv")),
)
def _(t):
    return nf.smooth_index(trawl9(t), 1994, 2003, by=SP)


PEELS = [1998, 1999, 2000]
PEELED = "SELECT p.peel, s.* FROM {source} s JOIN (SELECT unnest([1998, 1999, 2000]) AS peel) p ON s.year <= p.peel"
AHEAD = "year > peel AND year <= peel + CASE WHEN peel = 1999 THEN 1 ELSE 2 END"


@query(
    "smooth_error_newton",
    sql(
        f"SELECT species, {r('loglik', digits=3)} FROM fine_best",
        **smoothed("trawl_s6", SP, 1994, 2003, "biomass", "cv", "fine", 1000),
    ),
    digits=3,
)
def _(t):
    # The likelihood is flat at its top, so a fine grid and Newton's steps agree on it.
    smooth = nf.smooth_index(trawl6(t), 1994, 2003, grid=[i / 4 - 4 for i in range(17)], by=SP, newton=12)
    return smooth.select("species", "loglik").distinct()


@query(
    "retrospective_peels",
    sql(
        f"SELECT {smooth_cols('peel', 'species')} FROM sm WHERE {AHEAD}",
        peeled=PEELED.format(source="trawl_s6"),
        **smoothed("peeled", ["peel", "species"], 1995, 2002, "biomass", "cv"),
    ),
)
def _(t):
    fits = nf.smooth_index(nf.retrospective_peels(trawl6(t), PEELS), 1995, 2002, by=["peel", "species"])
    return nf.peel_projections(fits, 2, [1999])


@query(
    "retrospective_abc",
    sql(
        f"""SELECT peel, species, year, area, {r('pred', digits=7)}, {r('0.75 * 0.03 * pred', 'implied_abc', 7)}, {r('abc', digits=7)}, {r('catch', digits=7)}
FROM (SELECT *, CASE strata WHEN 'AF' THEN 'AFRICA' WHEN 'AM' THEN 'AMERICA' WHEN 'AS' THEN 'ASIA' ELSE 'EUROPE' END AS area
  FROM sm WHERE {AHEAD}) LEFT JOIN limits USING (year, area)
LEFT JOIN (SELECT year, area, sum(catch) AS catch FROM area_catch GROUP BY year, area) USING (year, area)""",
        peeled=PEELED.format(source="longline"),
        **smoothed("peeled", ["peel", "species"], 1996, 2002, "cpue", "cv"),
    ), digits=7)
def _(t):
    peeled = nf.retrospective_peels(longline(t), PEELS)
    fits = nf.smooth_index(peeled, 1996, 2002, by=["peel", "species"], value="cpue")
    names = {"AF": "AFRICA", "AM": "AMERICA", "AS": "ASIA", "EU": "EUROPE"}
    ahead = nf.peel_projections(fits, 2, [1999]).withColumn("area", recode("strata", names))
    out = nf.retrospective_abc(ahead, t.limits, ct.catch_by_area(tidy(t)))
    return out.select("peel", "species", "year", "area", "pred", "implied_abc", "abc", "catch")


@query(
    "impute_stratum_ratio",
    sql(
        f"""
SELECT t.species, t.year, t.strata, t.n, {r('CASE WHEN t.biomass IS NULL AND m.r IS NOT NULL THEN m.r * s.biomass ELSE t.biomass END', 'biomass')},
  {r('t.cv', 'cv')}
FROM trawl_s9 t LEFT JOIN trawl_s9 s ON s.species = t.species AND s.year = t.year AND s.strata = replace(t.strata, '501_700', '0_500')
  AND contains(t.strata, '501_700')
LEFT JOIN (SELECT a.species, a.strata, avg(a.biomass / nullif(b.biomass, 0)) AS r FROM trawl_s9 a JOIN trawl_s9 b
  ON a.species = b.species AND a.year = b.year AND contains(a.strata, '501_700') AND b.strata = replace(a.strata, '501_700', '0_500')
  GROUP BY a.species, a.strata) m ON m.species = t.species AND m.strata = t.strata"""
    ),
)
def _(t):
    pairs = {"WA_501_700": "WA_0_500", "CA_501_700": "CA_0_500", "EA_501_700": "EA_0_500"}
    return nf.impute_stratum_ratio(trawl9(t), pairs, SP)


@query(
    "fixed_extra_cv",
    sql(
        f"""SELECT model_name, strata, year, {r('sd', 'tot_sd_log_obs')}, {r('exp(ln(pred) - 1.959963984540054 * sd)', 'tot_obs_lci')},
  {r('exp(ln(pred) + 1.959963984540054 * sd)', 'tot_obs_uci')}, {r('sqrt(exp(power(sd, 2)) - 1)', 'tot_cv')},
  {r('sqrt(exp(power(sd, 2)) - 1) - obs_cv', 'delta_cv')}
FROM (SELECT *, CASE WHEN pred > 0 THEN sqrt(ln(power(obs_cv, 2) + 0.2 * 0.2 + 1)) END AS sd FROM fit_by_strata)"""
    ),
)
def _(t):
    df = t.fit_by_strata.withColumn("obs", F.col("pred")).withColumn("log_obs", F.ln("pred"))
    cols = ["model_name", "strata", "year", "tot_sd_log_obs", "tot_obs_lci", "tot_obs_uci", "tot_cv", "delta_cv"]
    return nf.fixed_extra_cv(df).select(*cols)
