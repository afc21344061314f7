"""Registered queries: relational building blocks."""

from pyspark.sql import functions as F

from ..functions import nulls as nl
from ..functions.bins import right_closed_bin, threshold_label
from ..functions.ranges import range_join
from ..functions.text import estimate_with_cv, one_decimal
from ..operators import grid
from ..operators import index as ix
from ..sources import lookups as lk
from ..sources.readers import lower_names
from .oracle import r, sql
from .q_catch import tidy
from .q_index import trawl6, trawl9, whole9
from .registry import query
from .standins import MODELS, S6, S9

SP = ["species"]


@query("lower_names", sql(f"SELECT c_custkey, c_name, c_nationkey, {r('c_acctbal')}, c_mktsegment FROM customer"))
def _(t):
    df = t.base("customer")
    return lower_names(df.toDF(*[c.upper() for c in df.columns]))


@query(
    "rename",
    sql(f"SELECT o_orderkey AS haul, {r('o_totalprice', 'biomass')}, o_orderstatus AS performance FROM orders"),
)
def _(t):
    df = t.base("orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    return df.withColumnsRenamed({"o_orderkey": "haul", "o_totalprice": "biomass", "o_orderstatus": "performance"})


@query(
    "select_drop",
    sql(f"SELECT l_orderkey, l_partkey, l_suppkey, {r('l_extendedprice')} FROM lineitem"),
)
def _(t):
    df = t.base("lineitem")
    matching = [c for c in df.columns if "KEY" in c.upper() or "price" in c]
    return df.select(*matching)


@query(
    "cast_year",
    sql("SELECT try_cast(year AS INTEGER) AS year, count(*) AS n FROM catch_blend GROUP BY 1"),
)
def _(t):
    return t.catch_blend.select(F.col("year").try_cast("int").alias("year")).groupBy("year").agg(F.count("*").alias("n"))


@query(
    "recode_values",
    sql(
        f"""SELECT year, CASE mgmt_area WHEN 'AFRICA' THEN 'AF' WHEN 'AMERICA' THEN 'AM' WHEN 'ASIA' THEN 'AS' END AS no_default,
  CASE WHEN geo_area IS NULL THEN NULL WHEN geo_area = 'NATION_1' THEN 'one' ELSE 'other' END AS with_default,
  {r('sum(rpw)', 'rpw')} FROM lls_area GROUP BY ALL"""
    ),
)
def _(t):
    return (
        t.lls_area.withColumn("no_default", lk.recode("mgmt_area", {"AFRICA": "AF", "AMERICA": "AM", "ASIA": "AS"}))
        .withColumn("with_default", lk.recode("geo_area", {"NATION_1": "one"}, "other"))
        .groupBy("year", "no_default", "with_default")
        .agg(F.sum("rpw").alias("rpw"))
    )


@query(
    "recode_ranges",
    sql(
        f"""SELECT species, year, area_id, strata, {r('biomass_mt')} FROM survey_area JOIN strata_scheme
  ON scheme = 's9' AND area_id BETWEEN lo AND hi"""
    ),
)
def _(t):
    return ix.assign_strata(t.survey_area, S9).select("species", "year", "area_id", "strata", "biomass_mt")


@query(
    "range_join_table",
    sql(
        """SELECT l_orderkey, l_linenumber, p_partkey, p_type FROM lineitem
JOIN part ON l_suppkey * 40 + l_linenumber BETWEEN p_partkey * 25 AND CASE WHEN p_partkey % 50 = 0 THEN NULL ELSE p_partkey * 25 + p_size END
UNION ALL SELECT l_orderkey, l_linenumber, p_partkey, p_type FROM lineitem
JOIN part ON p_partkey % 50 = 0 AND l_suppkey * 40 + l_linenumber >= p_partkey * 25"""
    ),
)
def _(t):
    key = F.col("p_partkey")
    end = F.when(key % 50 != 0, key * 25 + F.col("p_size"))
    ranges = t.base("part").select("p_partkey", "p_type", (key * 25).alias("lo"), end.alias("hi"))
    codes = t.base("lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") * 40 + F.col("l_linenumber")).alias("code"))
    return range_join(codes, ranges, "code").drop("code")


@query(
    "range_lookup_join",
    sql(
        """SELECT scheme, area, strata, count(*) AS n FROM part JOIN strata_scheme ON p_size BETWEEN lo AND hi
GROUP BY scheme, area, strata"""
    ),
)
def _(t):
    sizes = t.base("part").select(F.col("p_size").alias("area_id"))
    out = None
    for scheme in (S9, S6):
        part = ix.assign_strata(sizes, scheme).groupBy("area", "strata").agg(F.count("*").alias("n"))
        part = part.withColumn("scheme", F.lit(scheme.name))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "ordered_category",
    sql(
        """SELECT o_orderpriority, CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '3-MEDIUM' THEN 2 WHEN '1-URGENT' THEN 3
  ELSE 4 END AS ord, count(*) AS n FROM orders GROUP BY ALL"""
    ),
)
def _(t):
    ordered = ["5-LOW", "3-MEDIUM", "1-URGENT"]
    df = t.base("orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return df.withColumn("ord", lk.category_rank("o_orderpriority", ordered))


@query(
    "null_to_zero",
    sql(f"SELECT year, region, ineffective, {r('avg(coalesce(catch_freq, 0))', 'mean_catch')} FROM hook_sets GROUP BY ALL"),
)
def _(t):
    filled = t.hook_sets.withColumn("catch_freq", F.coalesce("catch_freq", F.lit(0.0)))
    return filled.groupBy("year", "region", "ineffective").agg(F.avg("catch_freq").alias("mean_catch"))


@query(
    "fallback_value",
    sql(
        f"""SELECT l_orderkey, l_linenumber, {r('CASE WHEN l_tax = 0.05 OR l_discount = 0 THEN l_extendedprice / 100 ELSE l_discount END', 'depth')}
FROM lineitem"""
    ),
)
def _(t):
    preferred = F.when(F.col("l_tax") != 0.05, F.col("l_discount"))
    depth = nl.first_present(preferred, F.col("l_extendedprice") / 100)
    return t.base("lineitem").select("l_orderkey", "l_linenumber", depth.alias("depth"))


@query(
    "unit_convert",
    sql(f"SELECT id, {r('kg / 1000', 'tonnes')}, {r('kg / 10', 'cm')} FROM obs_points"),
)
def _(t):
    return t.obs_points.select("id", (F.col("kg") / 1000).alias("tonnes"), (F.col("kg") / 10).alias("cm"))


@query(
    "depth_class",
    sql(
        """SELECT geo, CASE WHEN depth < 101 THEN '1-100m' WHEN depth < 201 THEN '101-200m' WHEN depth < 301 THEN '201-300m'
  WHEN depth < 401 THEN '301-400m' WHEN depth < 601 THEN '401-600m' WHEN depth < 801 THEN '601-800m'
  WHEN depth < 1001 THEN '801-1000m' ELSE '>1000m' END AS strat, count(*) AS n FROM hauls GROUP BY 1, 2"""
    ),
)
def _(t):
    label = threshold_label("depth", lk.DEPTH_CLASSES, lk.DEEPEST_CLASS)
    return t.hauls.groupBy("geo", label.alias("strat")).agg(F.count("*").alias("n"))


@query(
    "fixed_bins",
    sql(
        """SELECT region, CASE WHEN depth > 0 AND depth <= 1100 THEN CAST(ceil(depth / 50) * 50 - 50 AS BIGINT) END AS bin, count(*) AS n
FROM hook_sets GROUP BY 1, 2"""
    ),
)
def _(t):
    return t.hook_sets.groupBy("region", right_closed_bin("depth").alias("bin")).agg(F.count("*").alias("n"))


@query("tag_source", sql("SELECT 'LLS' AS survey, year, count(*) AS n FROM lls_area GROUP BY year"))
def _(t):
    return t.lls_area.withColumn("survey", F.lit("LLS")).groupBy("survey", "year").agg(F.count("*").alias("n"))


@query(
    "round_report",
    sql(
        """SELECT species, year, area_id, round_even(biomass_mt, 0) + 0.0 AS biomass_mt, round_even(biomass_var, 2) + 0.0 AS biomass_var
FROM survey_area"""
    ),
)
def _(t):
    df = t.survey_area.select("species", "year", "area_id", "biomass_mt", "biomass_var")
    return ix.round_report(df, {"biomass_mt": 0, "biomass_var": 2})


@query(
    "format_estimate_cv",
    sql(
        """SELECT species, year, strata, CASE WHEN biomass IS NOT NULL THEN format('{:,}', CAST(round_even(biomass, 0) AS BIGINT))
  || ' (' || printf('%.3f', round_even(cv, 3)) || ')' END AS value FROM trawl_s6"""
    ),
)
def _(t):
    return trawl6(t).select("species", "year", "strata", estimate_with_cv("biomass", "cv").alias("value"))


@query(
    "format_label",
    sql(
        """SELECT year, 'Mean (' || printf('%.1f', round_even(avg(length), 1)) || ' cm)' AS label FROM length_freq GROUP BY year"""
    ),
)
def _(t):
    means = t.length_freq.groupBy("year").agg(F.avg("length").alias("m"))
    return means.select("year", one_decimal("m", "Mean (", " cm)").alias("label"))


@query(
    "filter_compare",
    sql(
        f"""SELECT haul, {r('depth')}, geo, performance FROM hauls WHERE depth > 100 AND depth <= 900
  AND (performance = 'F' OR geo = '1-URGENT') AND haul <> 649"""
    ),
)
def _(t):
    d = F.col("depth")
    either = (F.col("performance") == "F") | (F.col("geo") == "1-URGENT")
    return t.hauls.where((d > 100) & (d <= 900) & either & (F.col("haul") != 649))


@query(
    "filter_not_in",
    sql(
        f"""SELECT year, geo_area, {r('sum(rpw)', 'rpw')} FROM lls_area
WHERE geo_area IS NULL OR geo_area NOT IN ('NATION_1', 'NATION_2') GROUP BY year, geo_area"""
    ),
)
def _(t):
    kept = t.lls_area.where(nl.not_in("geo_area", ["NATION_1", "NATION_2"]))
    return kept.groupBy("year", "geo_area").agg(F.sum("rpw").alias("rpw"))


@query(
    "filter_not_equal",
    sql(f"SELECT year, geo_area, {r('sum(rpw)', 'rpw')} FROM lls_area WHERE geo_area <> 'NATION_1' GROUP BY year, geo_area"),
)
def _(t):
    return t.lls_area.where(F.col("geo_area") != "NATION_1").groupBy("year", "geo_area").agg(F.sum("rpw").alias("rpw"))


@query(
    "filter_in",
    sql("SELECT year, species, count(*) AS n FROM lls_area WHERE species IN ('PROMO', 'SMALL') GROUP BY year, species"),
)
def _(t):
    return t.lls_area.where(F.col("species").isin("PROMO", "SMALL")).groupBy("year", "species").agg(F.count("*").alias("n"))


@query(
    "filter_not_null",
    sql(f"SELECT species, year, area_id, {r('biomass_mt')} FROM survey_area WHERE biomass_mt IS NOT NULL"),
)
def _(t):
    return t.survey_area.where(F.col("biomass_mt").isNotNull()).select("species", "year", "area_id", "biomass_mt")


@query(
    "filter_pattern",
    sql(
        f"""SELECT species, year, strata, {r('biomass')} FROM whole_s9 WHERE contains(strata, '701_1000')
  OR regexp_matches(strata, '^(WA|CA)_501')"""
    ),
)
def _(t):
    s = F.col("strata")
    return whole9(t).where(s.contains("701_1000") | s.rlike("^(WA|CA)_501")).select("species", "year", "strata", "biomass")


@query(
    "scaffold_join",
    sql(
        f"""SELECT g.year, g.strata, {r('s.rpn', 'rpn')} FROM (SELECT * FROM (SELECT DISTINCT year FROM lls_area)
  CROSS JOIN (SELECT unnest(['AFRICA', 'EUROPE', 'NOWHERE']) AS strata)) g
LEFT JOIN (SELECT year, mgmt_area AS strata, CAST(sum(rpn) AS DOUBLE) AS rpn FROM lls_area GROUP BY ALL) s USING (year, strata)"""
    ),
)
def _(t):
    sums = t.lls_area.groupBy("year", F.col("mgmt_area").alias("strata")).agg(F.sum("rpn").cast("double").alias("rpn"))
    return grid.scaffold(sums, ["AFRICA", "EUROPE", "NOWHERE"])


@query(
    "left_join_keys",
    sql(
        f"""SELECT species, year, strata, {r('a.biomass', 'biomass')}, {r('b.cpue', 'cpue')} FROM trawl_s9 a
LEFT JOIN (SELECT species, year, sum(cpue) AS cpue FROM longline GROUP BY species, year) b USING (species, year)"""
    ),
)
def _(t):
    from .q_index import longline

    totals = longline(t).groupBy("species", "year").agg(F.sum("cpue").alias("cpue"))
    return trawl9(t).join(totals, ["species", "year"], "left").select("species", "year", "strata", "biomass", "cpue")


@query(
    "grid_expand",
    sql(
        """SELECT species, year, strata FROM (SELECT species, unnest(range(lo, 2004)) AS year FROM
  (SELECT species, min(year) AS lo FROM trawl_s9 GROUP BY species)) JOIN (SELECT DISTINCT species, strata FROM trawl_s9) USING (species)"""
    ),
)
def _(t):
    return grid.grid_expand(trawl9(t), 2003, SP)


@query(
    "scalar_broadcast",
    sql(
        f"""SELECT year, {r('abc', digits=7)}, {r('abc / (SELECT sum(abc) FROM limits WHERE year = 1996)', 'rel', 7)}
FROM (SELECT year, sum(abc) AS abc FROM limits GROUP BY year)"""
    ), digits=7)
def _(t):
    yearly = t.limits.groupBy("year").agg(F.sum("abc").alias("abc"))
    base = yearly.where(F.col("year") == 1996).agg(F.max("abc")).scalar()
    return yearly.withColumn("rel", nl.ratio(F.col("abc"), base))


@query(
    "sum_by",
    sql(f"SELECT year, geo_area, {r('coalesce(sum(rpw), 0)', 'rpw')} FROM lls_area GROUP BY year, geo_area"),
)
def _(t):
    return t.lls_area.groupBy("year", "geo_area").agg(nl.sum_or_zero("rpw").alias("rpw"))


@query(
    "sum_strict_by",
    sql(
        f"""SELECT year, mgmt_area, {r('CASE WHEN count(rpw) = count(*) THEN sum(rpw) END', 'rpw')},
  {r('CASE WHEN count(rpw) = count(*) THEN avg(rpw) END', 'mean_rpw')} FROM lls_area GROUP BY year, mgmt_area"""
    ),
)
def _(t):
    return t.lls_area.groupBy("year", "mgmt_area").agg(
        nl.strict_sum("rpw").alias("rpw"), nl.strict_mean("rpw").alias("mean_rpw")
    )


@query(
    "pooled_cv",
    sql(
        f"""SELECT species, year, {r('coalesce(sum(biomass_mt), 0)', 'biomass')},
  {r('sqrt(coalesce(sum(biomass_var), 0)) / nullif(coalesce(sum(biomass_mt), 0), 0)', 'cv')} FROM survey_area GROUP BY species, year"""
    ),
)
def _(t):
    sums = t.survey_area.groupBy("species", "year").agg(
        nl.sum_or_zero("biomass_mt").alias("biomass"), nl.sum_or_zero("biomass_var").alias("v")
    )
    return sums.select("species", "year", "biomass", ix.pooled_cv("v", "biomass").alias("cv"))


@query(
    "mean_by",
    sql(
        f"""SELECT region, {r('avg(catch_freq)', 'mean_present')},
  {r('CASE WHEN count(catch_freq) = count(*) THEN avg(catch_freq) END', 'mean_strict')} FROM hook_sets GROUP BY region"""
    ),
)
def _(t):
    return t.hook_sets.groupBy("region").agg(
        F.avg("catch_freq").alias("mean_present"), nl.strict_mean("catch_freq").alias("mean_strict")
    )


@query(
    "count_mean_by",
    sql(f"SELECT year, survey, gear, count(*) AS n, {r('avg(length)', 'mean_length')} FROM length_freq GROUP BY ALL"),
)
def _(t):
    return t.length_freq.groupBy("year", "survey", "gear").agg(
        F.count("*").alias("n"), F.avg("length").alias("mean_length")
    )


@query(
    "global_agg",
    sql(f"SELECT count(*) AS n, {r('avg(depth)', 'mean_depth')}, {r('max(depth)', 'max_depth')} FROM hauls"),
)
def _(t):
    return t.hauls.agg(F.count("*").alias("n"), F.avg("depth").alias("mean_depth"), F.max("depth").alias("max_depth"))


@query("distinct_rows", sql("SELECT DISTINCT year, mgmt_area AS strata, species AS model_name FROM lls_area"))
def _(t):
    return t.lls_area.select("year", F.col("mgmt_area").alias("strata"), F.col("species").alias("model_name")).distinct()


@query("distinct_values", sql("SELECT DISTINCT year FROM lls_area"))
def _(t):
    return t.lls_area.select("year").distinct()


@query(
    "min_max_scalar",
    sql(f"SELECT min(year) AS first, max(year) AS last, {r('max(abc)', 'max_abc', 7)} FROM limits"), digits=7)
def _(t):
    return t.limits.agg(F.min("year").alias("first"), F.max("year").alias("last"), F.max("abc").alias("max_abc"))


@query(
    "sort_category",
    sql(
        f"""SELECT model_name, area, year, {r('proportion')}, list_position(['EA', 'CA', 'WA'], area) AS ord FROM apportioned
ORDER BY year, ord"""
    ),
)
def _(t):
    from .q_compare import appo

    return appo(t).select("model_name", "area", "year", "proportion", "ord").orderBy("year", "ord")


@query("sort_year", sql(f"SELECT year, {r('sum(weight)', 'catch')} FROM tidy_catch GROUP BY year ORDER BY year"))
def _(t):
    return tidy(t).groupBy("year").agg(F.sum("weight").alias("catch")).orderBy("year")


@query(
    "union_by_name",
    sql(
        f"""SELECT species, year, strata, {r('cv')}, {r('biomass')}, {r('cpue')} FROM (
  SELECT species, year, strata, cv, biomass, NULL::DOUBLE AS cpue FROM whole_s9
  UNION ALL SELECT species, year, strata, cv, NULL, cpue FROM longline)"""
    ),
)
def _(t):
    from .q_index import longline

    return whole9(t).drop("n").unionByName(longline(t), allowMissingColumns=True)


@query(
    "union_strict",
    sql(
        """SELECT survey, length, count(*) AS n FROM (SELECT survey, length FROM length_freq WHERE survey = 'F'
  UNION ALL SELECT survey, length FROM length_freq WHERE survey = 'O') GROUP BY survey, length"""
    ),
)
def _(t):
    parts = [
        t.length_freq.where(F.col("survey") == s).groupBy("survey", "length").agg(F.count("*").alias("n")) for s in "FO"
    ]
    return parts[0].unionByName(parts[1])


@query(
    "pivot_strata",
    sql(
        "SELECT species, year, "
        + ", ".join(r(f"max(CASE WHEN strata = '{s}' THEN biomass END)", s) for s in S9.strata)
        + " FROM whole_s9 GROUP BY species, year"
    ),
)
def _(t):
    return whole9(t).groupBy("species", "year").pivot("strata", S9.strata).agg(F.max("biomass"))


@query(
    "pivot_species",
    sql(
        "SELECT year, "
        + ", ".join(r(f"sum(CASE WHEN species = '{m}' THEN biomass_mt END)", m) for m in MODELS)
        + " FROM survey_area GROUP BY year"
    ),
)
def _(t):
    return t.survey_area.groupBy("year").pivot("species", MODELS).agg(F.sum("biomass_mt"))


@query(
    "unpivot",
    sql(
        f"""SELECT species, year, area_id, variable, {r('value')} FROM (
  SELECT species, year, area_id, 'biomass_mt' AS variable, biomass_mt AS value FROM survey_area
  UNION ALL SELECT species, year, area_id, 'biomass_var', biomass_var FROM survey_area)"""
    ),
)
def _(t):
    return t.survey_area.unpivot(["species", "year", "area_id"], ["biomass_mt", "biomass_var"], "variable", "value")


@query(
    "scalar_functions",
    sql(
        f"""SELECT species, year, area_id, {r('sqrt(biomass_mt)', 'root')}, {r('ln(biomass_mt)', 'log')},
  {r('exp(-biomass_mt / 1000000)', 'decay')}, {r('ln(biomass_mt) - 1.959963984540054 * 0.5', 'lower')}, lower(species) AS name,
  CAST(area_id AS VARCHAR) || '-' || CAST(year AS VARCHAR) AS label FROM survey_area WHERE biomass_mt IS NOT NULL"""
    ),
)
def _(t):
    b = F.col("biomass_mt")
    return t.survey_area.where(b.isNotNull()).select(
        "species",
        "year",
        "area_id",
        F.sqrt(b).alias("root"),
        F.ln(b).alias("log"),
        F.exp(-b / 1_000_000).alias("decay"),
        (F.ln(b) - 1.959963984540054 * 0.5).alias("lower"),
        F.lower("species").alias("name"),
        F.concat_ws("-", F.col("area_id").cast("string"), F.col("year").cast("string")).alias("label"),
    )
