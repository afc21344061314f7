"""Reference SQL: shared views, and helpers to write a query over them.

Written from the rules of the analysis, independently of the Spark operators;
only the stand-in input views are the same.
"""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["survey_area"] = """
SELECT p_type AS species, year(l_shipdate) AS year, p_size AS area_id,
  CASE WHEN p_size = 17 THEN NULL ELSE sum(l_extendedprice)/1000 END AS biomass_mt,
  CASE WHEN p_size % 10 = 0 THEN 0.0::DOUBLE WHEN p_size % 13 = 0 THEN NULL
       ELSE var_samp(l_extendedprice)*count(*)/1000000 END AS biomass_var,
  count(*) AS n_haul
FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY p_type, year(l_shipdate), p_size"""

VIEWS["gap_area"] = """
SELECT * FROM survey_area
WHERE NOT (area_id BETWEEN 29 AND 37 AND year IN (1996, 1998))
  AND NOT (area_id BETWEEN 38 AND 46 AND year IN (1996, 1997, 1998, 2000))
  AND NOT ((area_id BETWEEN 19 AND 28 OR area_id BETWEEN 35 AND 37) AND year = 2001)"""

VIEWS["strata_scheme"] = """
SELECT * FROM (VALUES
  ('s9','WA','WA_0_500',1,8),('s9','CA','CA_0_500',9,18),('s9','EA','EA_0_500',19,28),
  ('s9','WA','WA_501_700',29,31),('s9','CA','CA_501_700',32,34),('s9','EA','EA_501_700',35,37),
  ('s9','WA','WA_701_1000',38,40),('s9','CA','CA_701_1000',41,43),('s9','EA','EA_701_1000',44,46),
  ('s6','WA','WA_0_700',1,8),('s6','WA','WA_0_700',29,31),('s6','CA','CA_0_700',9,18),('s6','CA','CA_0_700',32,34),
  ('s6','EA','EA_0_700',19,28),('s6','EA','EA_0_700',35,37),('s6','WA','WA_701_1000',38,40),
  ('s6','CA','CA_701_1000',41,43),('s6','EA','EA_701_1000',44,46)) AS t(scheme, area, strata, lo, hi)"""

VIEWS["lls_area"] = """
SELECT year(l_shipdate) AS year, r_name AS mgmt_area,
  CASE WHEN n_nationkey = 7 THEN NULL ELSE n_name END AS geo_area, l_linestatus AS exploitable, p_type AS species,
  CASE WHEN n_nationkey = 11 THEN NULL ELSE sum(l_quantity) END AS rpw,
  CASE WHEN n_nationkey = 11 THEN NULL ELSE var_samp(l_quantity)*count(*) END AS rpw_var, count(*) AS rpn
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY year(l_shipdate), r_name, n_nationkey, n_name, l_linestatus, p_type"""

VIEWS["catch_blend"] = """
SELECT cast(year(o_orderdate) AS VARCHAR) AS year, r_name AS subarea,
  CASE WHEN l_returnflag = 'R' THEN 'D' ELSE 'R' END AS retained_or_discarded,
  o_orderpriority AS gear, c_mktsegment AS target, l_quantity AS weight_posted
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

VIEWS["limits"] = """
SELECT year(o_orderdate) AS year, r_name AS area, sum(o_totalprice)/100000 AS abc, sum(o_totalprice)/75000 AS ofl
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY year(o_orderdate), r_name"""

VIEWS["length_freq"] = """
SELECT l_linestatus AS survey, year(l_shipdate) AS year, p_size AS area_id, l_returnflag AS gear,
  l_quantity AS length, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_linenumber END AS freq
FROM lineitem JOIN part ON l_partkey = p_partkey"""

VIEWS["hauls"] = """
SELECT o_orderkey AS haul, o_totalprice/400 AS depth, o_orderpriority AS geo, o_orderstatus AS performance FROM orders"""

VIEWS["haul_catch"] = """
SELECT l_orderkey AS haul, l_quantity AS weight_kg, l_linenumber AS cnt FROM lineitem"""

VIEWS["hook_sets"] = """
SELECT year(l_shipdate) AS year, l_returnflag AS region, l_extendedprice/90 AS depth, l_linenumber AS ineffective,
  CASE WHEN l_tax = 0 THEN NULL ELSE l_quantity END AS catch_freq FROM lineitem"""

VIEWS["obs_points"] = """
SELECT c_custkey AS id, 2023 + c_custkey % 3 AS year, c_mktsegment AS gear,
  CAST(-170 + c_custkey % 40 AS DOUBLE) AS lon, CAST(52 + c_custkey % 9 AS DOUBLE) AS lat, c_acctbal AS kg FROM customer"""

VIEWS["fit_by_strata"] = """
SELECT species AS model_name, area || '_' || strata AS strata, area, year, 'biomass_pred' AS variable,
  sum(biomass_mt) AS pred, sum(biomass_mt)*0.8 AS pred_lci, sum(biomass_mt)*1.25 AS pred_uci,
  sqrt(sum(biomass_var))/sum(biomass_mt) AS obs_cv,
  sqrt(ln(1 + sum(biomass_var)/power(sum(biomass_mt),2) + 0.01)) AS tot_sd_log_obs
FROM survey_area JOIN strata_scheme ON scheme = 's6' AND area_id BETWEEN lo AND hi
GROUP BY species, area, strata, year"""

VIEWS["fit_total"] = """
SELECT model_name, year,
  CASE WHEN count(pred) = count(*) THEN sum(pred) END AS pred,
  CASE WHEN count(pred_lci) = count(*) THEN sum(pred_lci) END AS pred_lci,
  CASE WHEN count(pred_uci) = count(*) THEN sum(pred_uci) END AS pred_uci
FROM fit_by_strata GROUP BY model_name, year"""

VIEWS["recovered"] = """
SELECT event_type AS parameter, event_id AS replicate,
  CASE WHEN event_id % 50 = 0 THEN NULL ELSE value END AS estimate FROM events"""

VIEWS["true_values"] = "SELECT event_type AS parameter, avg(value) AS model FROM events GROUP BY event_type"

VIEWS["draws"] = """
SELECT event_type AS sampler, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS draw_id,
  CASE WHEN value > 0 THEN ln(value) END AS V1, value/100 AS V2 FROM events"""


def _filled(source: str) -> str:
    return f"""
SELECT species, year, area_id, biomass_mt, n_haul,
  CASE WHEN biomass_var IS NULL THEN power(0.5*biomass_mt, 2)
       WHEN biomass_var = 0 AND biomass_mt IS NULL THEN NULL
       WHEN biomass_var = 0 AND biomass_mt > 0 THEN power(0.5*biomass_mt, 2)
       ELSE biomass_var END AS biomass_var
FROM {source}"""


VIEWS["survey_filled"] = _filled("survey_area")
VIEWS["gap_filled"] = _filled("gap_area")


def _trawl(scheme: str, filled: str, name: str) -> None:
    VIEWS[f"{name}_sums"] = f"""
SELECT species, year, strata, CASE WHEN count(n_haul) = count(*) THEN sum(n_haul) END AS n,
  coalesce(sum(biomass_mt), 0) AS biomass,
  sqrt(coalesce(sum(biomass_var), 0)) / nullif(coalesce(sum(biomass_mt), 0), 0) AS cv
FROM {filled} JOIN strata_scheme ON scheme = '{scheme}' AND area_id BETWEEN lo AND hi
GROUP BY species, year, strata"""
    VIEWS[name] = f"""
SELECT g.species, g.year, g.strata, CAST(s.n AS BIGINT) AS n, s.biomass,
  CASE WHEN s.cv = 0 THEN 0.5 WHEN s.cv IS NULL AND s.biomass IS NOT NULL THEN 0.5 ELSE s.cv END AS cv
FROM (SELECT * FROM (SELECT DISTINCT species, year FROM {name}_sums)
      CROSS JOIN (SELECT DISTINCT strata FROM strata_scheme WHERE scheme = '{scheme}')) g
LEFT JOIN {name}_sums s USING (species, year, strata)"""


for _scheme in ("s9", "s6"):
    _trawl(_scheme, "gap_filled", f"trawl_{_scheme}")
    _trawl(_scheme, "survey_filled", f"whole_{_scheme}")

VIEWS["imputed_s9"] = """
SELECT t.species, t.year, t.strata, t.n,
  CASE WHEN t.biomass IS NULL AND (t.strata IN ('WA_501_700', 'CA_501_700')
        OR (t.strata = 'EA_501_700' AND sh.biomass IS NOT NULL)) THEN m.mn ELSE t.biomass END AS biomass,
  t.cv AS cv0,
  CASE WHEN t.cv IS NULL AND (CASE WHEN t.biomass IS NULL AND (t.strata IN ('WA_501_700', 'CA_501_700')
        OR (t.strata = 'EA_501_700' AND sh.biomass IS NOT NULL)) THEN m.mn ELSE t.biomass END) IS NOT NULL
       THEN 0.5 WHEN t.cv = 0 THEN 0.5 ELSE t.cv END AS cv
FROM trawl_s9 t
JOIN (SELECT species, strata, avg(biomass) AS mn FROM trawl_s9 GROUP BY species, strata) m USING (species, strata)
LEFT JOIN (SELECT species, year, biomass FROM trawl_s9 WHERE strata = 'EA_0_500') sh
  ON sh.species = t.species AND sh.year = t.year"""

VIEWS["longline"] = """
SELECT g.species, g.year, g.strata, s.cpue, s.cv
FROM (SELECT * FROM (SELECT DISTINCT species, year FROM lls_area WHERE year > 1995)
      CROSS JOIN (SELECT unnest(['AF', 'AM', 'AS', 'EU']) AS strata)) g
LEFT JOIN (
  SELECT species, year, CASE mgmt_area WHEN 'AFRICA' THEN 'AF' WHEN 'AMERICA' THEN 'AM' WHEN 'ASIA' THEN 'AS'
           WHEN 'EUROPE' THEN 'EU' END AS strata,
    coalesce(sum(rpw), 0) AS cpue, sqrt(coalesce(sum(rpw_var), 0)) / nullif(coalesce(sum(rpw), 0), 0) AS cv
  FROM lls_area WHERE year > 1995 GROUP BY ALL) s USING (species, year, strata)"""

VIEWS["tidy_catch"] = """
SELECT try_cast(year AS INTEGER) AS year, subarea AS area,
  CASE WHEN retained_or_discarded = 'D' THEN 'Discarded' ELSE 'Retained' END AS retention, gear, target,
  weight_posted AS weight
FROM catch_blend"""

VIEWS["area_catch"] = "SELECT year, area, retention, sum(weight) AS catch FROM tidy_catch GROUP BY ALL"

VIEWS["apportioned"] = """
SELECT *, sum(stratum_biomass) OVER (PARTITION BY model_name, year) AS total_biomass,
  stratum_biomass / sum(stratum_biomass) OVER (PARTITION BY model_name, year) AS proportion
FROM (SELECT model_name, area, year, CASE WHEN count(pred) = count(*) THEN sum(pred) END AS stratum_biomass
      FROM fit_by_strata GROUP BY model_name, area, year)"""


def sql(body: str, **extra: str) -> str:
    """``body`` preceded by the shared (and ``extra``) views it mentions, in dependency order."""
    pool = {**VIEWS, **extra}
    order: list[str] = []
    seen: set[str] = set()

    def need(text: str) -> None:
        for name in pool:
            if name not in seen and re.search(rf"\b{name}\b", text):
                seen.add(name)
                need(pool[name])
                order.append(name)

    need(body)
    if not order:
        return body.strip()
    ctes = ",\n".join(f"{n} AS ({pool[n].strip()})" for n in order)
    return f"WITH RECURSIVE {ctes}\n{body.strip()}"


def r(expr: str, name: str | None = None, digits: int = 6) -> str:
    """Rounded result column; adding zero turns -0.0 into 0.0."""
    return f"round({expr}, {digits}) + 0.0 AS {name or expr}"


def smoothed(source: str, keys: list[str], start: int, end: int, value: str, cv: str, prefix: str = "sm", per_unit: int = 20) -> dict[str, str]:
    """Views of the random-walk smoother over ``source(keys..., strata, year, value, cv)``; result view ``<prefix>``.

    One process error per key, grid -4..0 on the log scale, by 1 / ``per_unit``.
    """
    grid = "g * 0.05::DOUBLE - 4" if per_unit == 20 else f"g / {per_unit}::DOUBLE - 4"
    k = ", ".join([*keys, "strata"])
    kk = "".join(f"{c}, " for c in keys)
    using = ", ".join(keys)
    best_join = f"JOIN {prefix}_best USING ({using})" if keys else f"CROSS JOIN {prefix}_best"
    partition = f"PARTITION BY {using} " if keys else ""
    eq = " AND ".join(f"o.{c} IS NOT DISTINCT FROM f.{c}" for c in [*keys, "strata"])
    step = f"""
  CASE WHEN o.y IS NOT NULL AND f.x IS NOT NULL THEN f.x + (f.p + f.s2) / (f.p + f.s2 + o.r) * (o.y - f.x)
       WHEN o.y IS NOT NULL THEN o.y ELSE f.x END AS x,
  CASE WHEN o.y IS NOT NULL AND f.x IS NOT NULL THEN (f.p + f.s2) * (1 - (f.p + f.s2) / (f.p + f.s2 + o.r))
       WHEN o.y IS NOT NULL THEN o.r WHEN f.x IS NOT NULL THEN f.p + f.s2 ELSE f.p END AS p,
  CASE WHEN o.y IS NOT NULL AND f.x IS NOT NULL THEN f.ll - (ln(2 * 3.141592653589793 * (f.p + f.s2 + o.r))
         + (o.y - f.x) * (o.y - f.x) / (f.p + f.s2 + o.r)) / 2 ELSE f.ll END AS ll"""
    return {
        f"{prefix}_obs": f"""
SELECT {", ".join("b." + c for c in [*keys, "strata"])}, t.yr,
  CASE WHEN s.{value} > 0 AND s.{cv} IS NOT NULL THEN ln(s.{value}) END AS y, ln(1 + s.{cv} * s.{cv}) AS r
FROM (SELECT DISTINCT {k} FROM {source}) b CROSS JOIN (SELECT unnest(range({start}, {end + 1})) AS yr) t
LEFT JOIN {source} s ON s.year = t.yr AND {" AND ".join(f"s.{c} IS NOT DISTINCT FROM b.{c}" for c in [*keys, "strata"])}""",
        f"{prefix}_fwd": f"""
SELECT {k}, {start - 1}::BIGINT AS yr, {grid} AS s, exp(2 * ({grid})) AS s2,
  NULL::DOUBLE AS x, NULL::DOUBLE AS p, 0.0::DOUBLE AS ll
FROM (SELECT DISTINCT {k} FROM {source}) CROSS JOIN (SELECT unnest(range(0, {4 * per_unit + 1})) AS g)
UNION ALL
SELECT {", ".join("f." + c for c in [*keys, "strata"])}, o.yr, f.s, f.s2, {step}
FROM {prefix}_fwd f JOIN {prefix}_obs o ON o.yr = f.yr + 1 AND {eq}""",
        f"{prefix}_best": f"""
SELECT * EXCLUDE (rk) FROM (
  SELECT *, row_number() OVER ({partition}ORDER BY loglik DESC, s) AS rk
  FROM (SELECT {kk}s, sum(ll) AS loglik FROM {prefix}_fwd WHERE yr = {end} GROUP BY {kk}s)) WHERE rk = 1""",
        f"{prefix}_hist": f"""
SELECT f.* FROM {prefix}_fwd f {"JOIN " + prefix + "_best b ON b.s = f.s" + "".join(f" AND b.{c} IS NOT DISTINCT FROM f.{c}" for c in keys)}
WHERE f.yr >= {start}""",
        f"{prefix}_back": f"""
SELECT {k}, yr, s, s2, x AS xs, p AS ps FROM {prefix}_hist WHERE yr = {end}
UNION ALL
SELECT {", ".join("o." + c for c in [*keys, "strata"])}, o.yr, o.s, o.s2,
  CASE WHEN o.x IS NULL THEN f.xs ELSE o.x + o.p / (o.p + o.s2) * (f.xs - o.x) END,
  CASE WHEN o.x IS NULL THEN f.ps + o.s2 ELSE o.p + power(o.p / (o.p + o.s2), 2) * (f.ps - o.p - o.s2) END
FROM {prefix}_back f JOIN {prefix}_hist o ON o.yr = f.yr - 1 AND {eq}""",
        prefix: f"""
SELECT {k}, yr AS year, exp(xs) AS pred, sqrt(ps) AS se, exp(xs - 1.96 * sqrt(ps)) AS pred_lci,
  exp(xs + 1.96 * sqrt(ps)) AS pred_uci, s AS ln_pe, loglik
FROM (SELECT * EXCLUDE (s, s2) FROM {prefix}_back) {best_join}""",
    }
