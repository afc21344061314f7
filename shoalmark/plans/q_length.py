"""Registered queries: length compositions and depth profiles."""

from pyspark.sql import functions as F

from ..operators import depth as dp
from ..operators import length as ln
from ..sources.lookups import LONGLINE_AREAS
from .oracle import r, sql
from .registry import query
from .standins import S9


def survey(t, code):
    return t.length_freq.where(F.col("survey") == code)


def comp_sql(source: str, by: str, strict: bool = False, freq: str = "freq") -> str:
    total = f"CASE WHEN count({freq}) = count(*) THEN sum({freq}) END" if strict else f"coalesce(sum({freq}), 0)"
    return f"""
SELECT {by}, length, {r('freq')}, {r('total')}, {r('mean')} FROM (
  SELECT *, CASE WHEN count(freq) OVER w = count(*) OVER w THEN sum(freq) OVER w END AS total,
    CASE WHEN count(freq) OVER w = count(*) OVER w THEN sum(freq * length) OVER w / nullif(sum(freq) OVER w, 0) END AS mean
  FROM (SELECT {by}, length, CAST({total} AS DOUBLE) AS freq FROM {source} GROUP BY {by}, length)
  WINDOW w AS (PARTITION BY {by}))"""


BAD = [{"year": 1997, "area_id": 38, "length": 29.0}, {"year": 1998, "area_id": 5, "length": 12.0}]
BAD_SQL = "(year = 1997 AND area_id = 38 AND length = 29) OR (year = 1998 AND area_id = 5 AND length = 12)"


def dbl(df):
    """Frequencies as doubles, so that sums of counts and of relative numbers share a type."""
    return df.withColumn("freq", F.col("freq").cast("double"))


@query(
    "length_comp_by_year",
    sql(
        comp_sql("cleaned", "survey, year"),
        cleaned=f"SELECT * REPLACE (CASE WHEN {BAD_SQL} THEN NULL ELSE freq END AS freq) FROM length_freq",
    ),
)
def _(t):
    return ln.length_comp_by_year(dbl(ln.null_outliers(t.length_freq, BAD, "freq")), ["survey"])


@query(
    "length_comp_by_stratum",
    sql(
        comp_sql("mapped", "survey, strata", True),
        mapped="SELECT * FROM length_freq JOIN strata_scheme ON scheme = 's9' AND area_id BETWEEN lo AND hi",
    ),
)
def _(t):
    return ln.length_comp_by_stratum(dbl(t.length_freq), S9, ["survey"], strict=True)


@query(
    "length_comp_overall",
    sql(
        f"""SELECT * FROM ({comp_sql("(SELECT * FROM length_freq WHERE survey = 'F')", "survey", True)})
UNION ALL SELECT * FROM ({comp_sql("(SELECT * FROM length_freq WHERE survey = 'O')", "survey")})"""
    ),
)
def _(t):
    return ln.length_comp_overall({"F": dbl(survey(t, "F")), "O": dbl(survey(t, "O"))}, strict=["F"])


FISHERY = "SELECT CASE gear WHEN 'A' THEN 'Trawl' ELSE 'Longline' END AS gear, year, length, freq FROM length_freq WHERE gear IN ('A', 'N') AND area_id > 3 AND area_id < 48 AND area_id <> 20"


@query(
    "fishery_length_comp",
    sql(
        f"""SELECT grain, gear, year, length, freq, total, mean FROM
(SELECT 'gear_year' AS grain, * FROM ({comp_sql('fishery', 'gear, year', True)}))
UNION ALL SELECT 'gear', gear, NULL, length, freq, total, mean FROM ({comp_sql('fishery', 'gear', True)})""",
        fishery=FISHERY,
    ),
)
def _(t):
    lengths = dbl(t.length_freq).withColumnRenamed("area_id", "nmfs_area")
    return ln.fishery_length_comp(ln.fishery_lengths(lengths, {"A": "Trawl", "N": "Longline"}, 3, 48, 20), "freq")


DENSITY = """
SELECT survey, year, bin, freq, freq / nullif(sum(freq) OVER (PARTITION BY survey, year) * {w}, 0) AS density FROM (
  SELECT survey, year, ceil(length / {w} - 0.5) * {w} AS bin, CAST(coalesce(sum(freq), 0) AS DOUBLE) AS freq
  FROM length_freq WHERE length >= 12 AND length <= 48 GROUP BY 1, 2, 3)"""


@query(
    "length_density",
    sql(f"SELECT survey, year, {r('bin')}, {r('freq')}, {r('density', digits=9)} FROM dens", dens=DENSITY.format(w="1.0")),
    digits=9,
)
def _(t):
    return ln.length_density(ln.length_comp_by_year(dbl(t.length_freq), ["survey"]), ["survey", "year"], 1.0, 12, 48)


@query(
    "histogram_density",
    sql(f"SELECT survey, year, {r('bin')}, {r('freq')}, {r('density')} FROM dens", dens=DENSITY.format(w="4.0")),
)
def _(t):
    return ln.length_density(dbl(t.length_freq), ["survey", "year"], 4.0, 12, 48)


MEANS = """SELECT {by}, CAST(sum(freq) AS DOUBLE) AS total, sum(freq * length) / nullif(sum(freq), 0) AS mean
FROM length_freq GROUP BY {by}"""


@query(
    "weighted_mean",
    sql(f"SELECT survey, year, {r('total')}, {r('mean')} FROM means", means=MEANS.format(by="survey, year")),
)
def _(t):
    return ln.weighted_mean(dbl(t.length_freq), ["survey", "year"])


@query(
    "mean_length_pair",
    sql(
        f"""SELECT a.year, {r('a.mean', 'mean_a')}, {r('b.mean', 'mean_b')}
FROM (SELECT * FROM means WHERE survey = 'O') a JOIN (SELECT * FROM means WHERE survey = 'F') b USING (year)""",
        means=MEANS.format(by="survey, year"),
    ),
)
def _(t):
    means = ln.weighted_mean(dbl(t.length_freq), ["survey", "year"])
    return ln.mean_length_pair(means.where(F.col("survey") == "O"), means.where(F.col("survey") == "F"))


@query(
    "pair_series",
    sql(
        f"""SELECT a.gear, a.year, {r('a.mean', 'mean_a')}, {r('b.mean', 'mean_b')}
FROM (SELECT * FROM means WHERE survey = 'O') a JOIN (SELECT * FROM means WHERE survey = 'F') b USING (gear, year)""",
        means=MEANS.format(by="survey, gear, year"),
    ),
)
def _(t):
    means = ln.weighted_mean(dbl(t.length_freq), ["survey", "gear", "year"])
    return ln.mean_length_pair(
        means.where(F.col("survey") == "O"), means.where(F.col("survey") == "F"), ["gear", "year"]
    )


@query(
    "attach_group_totals",
    sql(comp_sql("length_freq", "gear, area_id")),
)
def _(t):
    return ln.length_comp(dbl(t.length_freq), ["gear", "area_id"])


@query(
    "null_outlier",
    sql(
        f"""SELECT survey, year, area_id, gear, {r('length')}, CASE WHEN {BAD_SQL} THEN NULL ELSE freq END AS freq
FROM length_freq"""
    ),
)
def _(t):
    return ln.null_outliers(t.length_freq, BAD, "freq")


@query(
    "expand_by_frequency",
    sql(
        """SELECT survey, year, gear, count(*) AS n FROM (SELECT *, unnest(range(CAST(freq AS BIGINT))) FROM length_freq WHERE freq > 0)
GROUP BY survey, year, gear"""
    ),
)
def _(t):
    return ln.expand_by_frequency(t.length_freq, "freq").groupBy("survey", "year", "gear").agg(F.count("*").alias("n"))


def box_sql(source: str, by: str, value: str, weight: str = "freq") -> str:
    return f"""
SELECT {", ".join("f." + c for c in by.split(", "))}, count(*) AS n, {r('q.q1', 'q1')}, {r('q.q2', 'median')}, {r('q.q3', 'q3')},
  {r(f'min(CASE WHEN {value} >= q1 - (q3 - q1) * 1.5 AND {value} <= q3 + (q3 - q1) * 1.5 THEN {value} END)', 'whisker_low')},
  {r(f'max(CASE WHEN {value} >= q1 - (q3 - q1) * 1.5 AND {value} <= q3 + (q3 - q1) * 1.5 THEN {value} END)', 'whisker_high')},
  count(CASE WHEN NOT ({value} >= q1 - (q3 - q1) * 1.5 AND {value} <= q3 + (q3 - q1) * 1.5) THEN 1 END) AS outliers
FROM fish f JOIN (SELECT {by}, quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS q2,
  quantile_cont({value}, 0.75) AS q3 FROM fish GROUP BY {by}) q
  ON {" AND ".join(f"f.{c} IS NOT DISTINCT FROM q.{c}" for c in by.split(", "))}
GROUP BY {", ".join("f." + c for c in by.split(", "))}, q.q1, q.q2, q.q3"""


@query(
    "box_stats",
    sql(
        box_sql("fish", "survey, gear", "length"),
        fish="SELECT *, unnest(range(CAST(freq AS BIGINT))) FROM length_freq WHERE freq > 0",
    ),
)
def _(t):
    return ln.box_stats(t.length_freq, ["survey", "gear"], "length", "freq")


# --- lengths by depth --------------------------------------------------------

AREA_NAMES = {"A": "Western Gulf of Alaska", "N": "Central Gulf of Alaska"}
DESCRIPTIONS = ["0-100m", "101-200m", "201-300m", "301-400m", "401-600m", "601-800m", "1201m +"]


def depth_lengths(t):
    li = t.base("lineitem")
    n = F.col("l_linenumber")
    freq = F.when(F.col("l_discount") > 0, n)
    lls = li.where(F.col("l_linestatus") == "O").select(
        F.year("l_shipdate").alias("year"),
        n.alias("stratum"),
        F.get(F.array(*[F.lit(d) for d in DESCRIPTIONS]), n - 1).alias("stratum_description"),
        F.when(F.col("l_returnflag") == "A", "Western Gulf of Alaska")
        .when(F.col("l_returnflag") == "N", "Central Gulf of Alaska")
        .when(F.col("l_tax") < 0.03, "Bering Sea")
        .when(F.col("l_tax") < 0.06, "West Yakutat")
        .alias("council_sablefish_mgmt_area"),
        F.col("l_quantity").alias("length"),
        freq.alias("frequency"),
    )
    bts = li.where(F.col("l_linestatus") == "F").select(
        F.year("l_shipdate").alias("year"),
        F.when(F.col("l_returnflag") == "A", "WESTERN GOA - INPFC")
        .when(F.col("l_returnflag") == "N", "CENTRAL GOA - NMFS")
        .otherwise("SOUTHEASTERN")
        .alias("regulatory_area"),
        F.when(F.col("l_tax") == 0, None).when(F.col("l_tax") == 0.01, 0.0).otherwise(F.col("l_extendedprice") / 90)
        .alias("depth_gear_m"),
        (F.col("l_extendedprice") / 100).alias("depth_m"),
        (F.col("l_quantity") * 10).cast("int").alias("length_mm"),
        freq.alias("frequency"),
    )
    return ln.longline_depth_lengths(lls, LONGLINE_AREAS).unionByName(ln.trawl_depth_lengths(bts))


DEPTH_LENGTHS = f"""
SELECT 'LLS' AS survey, year(l_shipdate) AS year, CASE region WHEN 'Central Gulf of Alaska' THEN 'CGOA'
    WHEN 'Western Gulf of Alaska' THEN 'WGOA' ELSE 'EGOA' END AS region,
  ({DESCRIPTIONS!r})[l_linenumber] AS strat, l_quantity AS length, CASE WHEN l_discount > 0 THEN l_linenumber END AS freq
FROM (SELECT *, CASE WHEN l_returnflag = 'A' THEN 'Western Gulf of Alaska' WHEN l_returnflag = 'N' THEN 'Central Gulf of Alaska'
        WHEN l_tax < 0.03 THEN 'Bering Sea' WHEN l_tax < 0.06 THEN 'West Yakutat' END AS region FROM lineitem)
WHERE l_linestatus = 'O' AND l_linenumber > 1 AND region IS NOT NULL AND region <> 'Bering Sea'
UNION ALL
SELECT 'BTS', year, region, CASE WHEN d < 101 THEN '1-100m' WHEN d < 201 THEN '101-200m' WHEN d < 301 THEN '201-300m'
    WHEN d < 401 THEN '301-400m' WHEN d < 601 THEN '401-600m' WHEN d < 801 THEN '601-800m' WHEN d < 1001 THEN '801-1000m'
    ELSE '>1000m' END, length, freq
FROM (SELECT year(l_shipdate) AS year, CASE l_returnflag WHEN 'A' THEN 'WGOA' WHEN 'N' THEN 'CGOA' ELSE 'EGOA' END AS region,
        CASE WHEN l_tax IN (0, 0.01) THEN l_extendedprice / 100 ELSE l_extendedprice / 90 END AS d,
        CAST(l_quantity * 10 AS INTEGER) / 10 AS length, CASE WHEN l_discount > 0 THEN l_linenumber END AS freq
      FROM lineitem WHERE l_linestatus = 'F')"""


@query(
    "length_by_depth",
    sql(
        f"""SELECT survey, year, strat, region, CAST(sum(freq) AS BIGINT) AS n, {r('sum(freq * length) / sum(freq)', 'mean_length')}
FROM lengths WHERE freq > 0 GROUP BY survey, year, strat, region""",
        lengths=DEPTH_LENGTHS,
    ),
)
def _(t):
    return ln.length_by_depth(depth_lengths(t), ["survey", "year", "strat", "region"])


@query(
    "length_by_depth_box",
    sql(
        box_sql("fish", "strat, survey, region", "length"),
        fish="SELECT *, unnest(range(CAST(freq AS BIGINT))) FROM lengths WHERE freq > 0",
        lengths=DEPTH_LENGTHS,
    ),
)
def _(t):
    return ln.box_stats(depth_lengths(t), ["strat", "survey", "region"], "length", "freq")


# --- depth profiles ----------------------------------------------------------

BIN = "CASE WHEN depth > 0 AND depth <= 1100 THEN CAST(ceil(depth / 50) * 50 - 50 AS BIGINT) END"
SETS = f"""SELECT region, {BIN} AS bin, avg(CASE WHEN catch_freq IS NULL THEN 0 ELSE catch_freq / (45 - ineffective) END) AS mean_cpue
FROM hook_sets WHERE ineffective < 6 GROUP BY 1, 2"""
HAULS = f"""SELECT geo AS region, {BIN} AS bin, avg(coalesce(weight_kg, 0)) AS mean_cpue
FROM hauls LEFT JOIN haul_catch USING (haul) GROUP BY 1, 2"""


@query(
    "depth_profile",
    sql(
        f"""SELECT 'LLS' AS survey, region, bin, {r('mean_cpue')}, {r('mean_cpue / (SELECT max(mean_cpue) FROM set_prof)', 'scaled')}
FROM set_prof UNION ALL
SELECT 'BTS', region, bin, round(mean_cpue, 6), round(mean_cpue / (SELECT max(mean_cpue) FROM haul_prof), 6) FROM haul_prof""",
        set_prof=SETS,
        haul_prof=HAULS,
    ),
)
def _(t):
    sets = dp.depth_profile_sets(t.hook_sets).withColumn("survey", F.lit("LLS"))
    return sets.unionByName(dp.depth_profile_hauls(t.hauls, t.haul_catch).withColumn("survey", F.lit("BTS")))


@query(
    "scale_to_max",
    sql(
        f"""SELECT region, bin, {r('mean_cpue')}, {r('mean_cpue / (SELECT max(mean_cpue) FROM haul_prof)', 'scaled')}
FROM haul_prof""",
        haul_prof=HAULS,
    ),
)
def _(t):
    return dp.depth_profile_hauls(t.hauls, t.haul_catch)


@query(
    "effort_cpue",
    sql(
        f"""SELECT year, region, {r('depth')}, ineffective, {r('catch_freq')},
  {r('CASE WHEN catch_freq IS NULL THEN 0 ELSE catch_freq / (45 - ineffective) END', 'cpue')}
FROM hook_sets WHERE ineffective < 6"""
    ),
)
def _(t):
    return dp.hook_cpue(t.hook_sets)
