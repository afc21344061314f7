"""Registered queries: stations, cells, projection, polygons."""

import math
import re

from pyspark.sql import functions as F

from ..functions.geo import AlbersParams
from ..functions.joins import lookup
from ..operators import spatial as sp
from ..sources.lookups import recode
from ..sources.readers import with_bounds
from .oracle import r, sql
from .registry import query


def station_inputs(t):
    li, n, q = t.base("lineitem"), F.col("l_linenumber"), F.col("l_quantity")
    lls = li.select(
        F.lit(30020).alias("species_code"),
        F.year("l_shipdate").alias("year"),
        F.when(F.col("l_returnflag") == "A", "Western Gulf of Alaska")
        .when(F.col("l_linestatus") == "O", "Central Gulf of Alaska")
        .when(n == 1, "Bering Sea")
        .when(n < 6, "West Yakutat")
        .alias("council_sablefish_management_area"),
        F.when(F.col("l_tax") == 0.08, "Shallow cross-shelf gully").when(F.col("l_tax") > 0, "slope").alias("habitat_type"),
        (F.col("l_partkey") % 600).cast("int").alias("station_number"),
        F.when(F.col("l_discount") > 0, q).alias("catch_freq"),
        (n + 50).cast("double").alias("start_latitude"),
        (F.lit(50) + q / 10).alias("end_latitude"),
        (F.lit(-160) - n).cast("double").alias("start_longitude"),
        (F.lit(-160) + q / 10).alias("end_longitude"),
    )
    key, pr = F.col("o_custkey"), F.col("o_orderpriority")
    bts = t.base("orders").select(
        F.lit(30020).alias("species_code"),
        F.year("o_orderdate").alias("year"),
        F.when(pr == "1-URGENT", "WESTERN GOA - INPFC")
        .when(pr == "2-HIGH", "EASTERN GOA - NMFS")
        .when(pr == "3-MEDIUM", "CENTRAL GOA - NMFS")
        .when(pr == "4-NOT SPECIFIED", "OTHER")
        .alias("regulatory_area"),
        key.alias("hauljoin"),
        F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice") / 1000).alias("count"),
        (F.lit(52) + key % 7).cast("double").alias("latitude_dd_start"),
        (F.lit(53) + key % 7).cast("double").alias("latitude_dd_end"),
        (F.lit(-160) + key % 11).cast("double").alias("longitude_dd_start"),
        (F.lit(-161) + key % 11).cast("double").alias("longitude_dd_end"),
    )
    return bts, lls


LLS_ST = """
SELECT 30020 AS species_code, year, CASE area WHEN 'Central Gulf of Alaska' THEN 'CGOA' WHEN 'Western Gulf of Alaska' THEN 'WGOA'
    WHEN 'West Yakutat' THEN 'EGOA' END AS region, station, sum(c) AS catch, avg(lat) AS lat, avg(lon) AS lon, 'LLS' AS survey
FROM (SELECT year(l_shipdate) AS year, CASE WHEN l_returnflag = 'A' THEN 'Western Gulf of Alaska' WHEN l_linestatus = 'O'
          THEN 'Central Gulf of Alaska' WHEN l_linenumber = 1 THEN 'Bering Sea' WHEN l_linenumber < 6 THEN 'West Yakutat' END AS area,
        CASE WHEN l_tax = 0.08 THEN 'Shallow cross-shelf gully' WHEN l_tax > 0 THEN 'slope' END AS habitat,
        l_partkey % 600 AS station, CASE WHEN l_discount > 0 THEN l_quantity ELSE 0 END AS c,
        ((l_linenumber + 50) + (50 + l_quantity / 10)) / 2 AS lat, ((-160 - l_linenumber) + (-160 + l_quantity / 10)) / 2 AS lon
      FROM lineitem)
WHERE (area IS NULL OR area NOT IN ('Bering Sea', 'Aleutians')) AND habitat <> 'Shallow cross-shelf gully' AND station < 500
GROUP BY ALL"""
BTS_ST = """
SELECT 30020 AS species_code, year, region, station, CASE WHEN count(c) = count(*) THEN sum(c) END AS catch, avg(lat) AS lat,
  avg(lon) AS lon, 'BTS' AS survey
FROM (SELECT year(o_orderdate) AS year, CASE o_orderpriority WHEN '1-URGENT' THEN 'WGOA' WHEN '2-HIGH' THEN 'EGOA' ELSE 'CGOA' END AS region,
        o_custkey AS station, CASE WHEN o_orderkey % 17 <> 0 THEN o_totalprice / 1000 END AS c,
        ((52 + o_custkey % 7) + (53 + o_custkey % 7)) / 2 AS lat, ((-160 + o_custkey % 11) + (-161 + o_custkey % 11)) / 2 AS lon
      FROM orders) GROUP BY ALL"""


@query(
    "station_catch",
    sql(
        f"""SELECT species_code, year, region, station, {r('catch')}, {r('lat')}, {r('lon')}, survey, catch > 0 AS present
FROM (SELECT * FROM lls_st UNION ALL SELECT * FROM bts_st)""",
        lls_st=LLS_ST,
        bts_st=BTS_ST,
    ),
)
def _(t):
    return sp.station_catch(*station_inputs(t))


@query(
    "sum_and_centroid",
    sql(f"SELECT species_code, year, region, station, {r('catch')}, {r('lat')}, {r('lon')} FROM bts_st", bts_st=BTS_ST),
)
def _(t):
    return sp.trawl_stations(station_inputs(t)[0])


@query(
    "gear_cell_catch",
    sql(
        f"""SELECT year, lat, lon, CASE WHEN gear IN ('BUILDING', 'MACHINERY') THEN 'Fixed' ELSE 'Trawl' END AS gear,
  {r('sum(kg) / 1000', 'weight')} FROM obs_points WHERE id % 5 <> 0 AND year > 2023
GROUP BY year, lat, lon, CASE WHEN gear IN ('BUILDING', 'MACHINERY') THEN 'Fixed' ELSE 'Trawl' END"""
    ),
)
def _(t):
    codes = {"BUILDING": "POT", "MACHINERY": "LGL"}
    obs = t.obs_points.withColumn("species", F.when(F.col("id") % 5 != 0, "target").otherwise("other"))
    return sp.gear_cell_catch(obs.withColumn("gear", recode("gear", codes, F.col("gear"))), "target", 2023)


def _albers_sql(lon: str, lat: str) -> tuple[str, str]:
    """The textbook formulas with the parallels' constants written out as numbers."""
    p = AlbersParams()
    f = 1 / p.inverse_flattening
    e2 = 2 * f - f * f
    e = math.sqrt(e2)

    def q(deg):
        s = math.sin(math.radians(deg))
        return (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    def m2(deg):
        s = math.sin(math.radians(deg))
        return math.cos(math.radians(deg)) ** 2 / (1 - e2 * s * s)

    n = (m2(55) - m2(65)) / (q(65) - q(55))
    c = m2(55) + n * q(55)
    s = f"sin(radians({lat}))"
    qq = f"({1 - e2!r} * ({s} / (1 - {e2!r} * {s} * {s}) - ln((1 - {e!r} * {s}) / (1 + {e!r} * {s})) / {2 * e!r}))"
    rho = f"({p.semi_major!r} * sqrt({c!r} - {n!r} * {qq}) / {n!r})"
    rho0 = p.semi_major * math.sqrt(c - n * q(50)) / n
    theta = f"({n!r} * radians({lon} + 154.0))"
    return f"{rho} * sin({theta})", f"{rho0!r} - {rho} * cos({theta})"


def _doubles(text: str) -> str:
    """Number literals with a fraction as doubles; the engine would read them as decimals."""
    return re.sub(r"(?<![\w.])(\d+\.\d+(?:e-?\d+)?)(?![\d:])", r"\1::DOUBLE", text)


AX, AY = (_doubles(x) for x in _albers_sql("lon", "lat"))
PROJ = f"SELECT *, {AX} AS x, {AY} AS y FROM obs_points"


@query(
    "project_albers",
    sql(f"SELECT id, year, gear, lon, lat, {r('kg', digits=3)}, {r('x', digits=3)}, {r('y', digits=3)} FROM proj", proj=PROJ),
    digits=3,
)
def _(t):
    return sp.project_albers(t.obs_points)


# The concave ring overlaps the square, so membership in both must not repeat a point; the square has a hole, an island
# in the hole, and a second part.
RINGS = {
    "concave": [[(-165.0, 53.0), (-150.0, 53.0), (-158.0, 55.5), (-150.0, 58.0), (-165.0, 58.0)]],
    "square": [
        [(-160.5, 56.5), (-140.2, 56.5), (-140.2, 59.5), (-160.5, 59.5)],
        [(-149.5, 56.8), (-141.5, 56.8), (-141.5, 59.2), (-149.5, 59.2)],
        [(-146.5, 57.5), (-144.0, 57.5), (-144.0, 58.5), (-146.5, 58.5)],
        [(-139.5, 52.5), (-133.5, 52.5), (-136.5, 55.5)],
    ],
}


def edges_sql(polys: dict, shift: float = 0.0) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(
        f"('{k}', {a[0] + shift}::DOUBLE, {a[1] + shift}::DOUBLE, {b[0] + shift}::DOUBLE, {b[1] + shift}::DOUBLE)"
        for k, rings in polys.items()
        for ring in rings
        for a, b in zip(ring, ring[1:] + ring[:1])
    ) + ") AS e(poly_id, ax, ay, bx, by_)"


EDGES = edges_sql(RINGS)
INSIDE = """SELECT * FROM obs_points p WHERE EXISTS (
  SELECT 1 FROM edges e WHERE (e.ay > p.lat) <> (e.by_ > p.lat)
    AND p.lon < (e.bx - e.ax) * ((p.lat - e.ay) / nullif(e.by_ - e.ay, 0)) + e.ax
  GROUP BY poly_id HAVING count(*) % 2 = 1)
OR EXISTS (SELECT 1 FROM edges e WHERE sqrt(power(p.lon - e.ax, 2) + power(p.lat - e.ay, 2))
  + sqrt(power(p.lon - e.bx, 2) + power(p.lat - e.by_, 2)) <= sqrt(power(e.bx - e.ax, 2) + power(e.by_ - e.ay, 2)) * (1 + 1e-15))"""


def polygons(t, shift: float = 0.0):
    rows = [(k, [[{"x": x + shift, "y": y + shift} for x, y in ring] for ring in rings]) for k, rings in RINGS.items()]
    return with_bounds(lookup(t.spark, rows, "poly_id string, rings array<array<struct<x: double, y: double>>>"))


@query(
    "points_in_strata",
    sql(f"SELECT id, year, gear, lon, lat, {r('kg')} FROM inside", inside=INSIDE, edges=EDGES),
)
def _(t):
    return sp.points_in_strata(t.obs_points, polygons(t))


@query(
    "spatial_semi_join",
    sql("SELECT lon, lat, count(*) AS n FROM inside GROUP BY lon, lat", inside=INSIDE, edges=EDGES),
)
def _(t):
    return sp.points_in_strata(t.obs_points, polygons(t), few=4).groupBy("lon", "lat").agg(F.count("*").alias("n"))


# Straight edges in degrees, a vertex at least every quarter of a degree, in metres; no point lies on one.
SHIFT, STEP = 0.0625, 0.25
PIECES = f"""
SELECT poly_id, ax + (bx - ax) * i / n AS alon, ay + (by_ - ay) * i / n AS alat,
  CASE WHEN i + 1 = n THEN bx ELSE ax + (bx - ax) * (i + 1) / n END AS blon,
  CASE WHEN i + 1 = n THEN by_ ELSE ay + (by_ - ay) * (i + 1) / n END AS blat
FROM (SELECT *, unnest(range(CAST(n AS BIGINT))) AS i FROM
  (SELECT *, greatest(1, ceil(greatest(abs(bx - ax), abs(by_ - ay)) / {STEP})) AS n FROM ({edges_sql(RINGS, SHIFT)})))"""
BENT = f"""SELECT poly_id, {_doubles(_albers_sql("alon", "alat")[0])} AS ax, {_doubles(_albers_sql("alon", "alat")[1])} AS ay,
  {_doubles(_albers_sql("blon", "blat")[0])} AS bx, {_doubles(_albers_sql("blon", "blat")[1])} AS by_ FROM pieces"""
OBS_CELLS = f"""SELECT *, {AX} AS x, {AY} AS y FROM (
  SELECT year, lat, lon, CASE WHEN gear IN ('BUILDING', 'MACHINERY') THEN 'Fixed' ELSE 'Trawl' END AS gear, sum(kg) / 1000 AS weight
  FROM obs_points WHERE id % 5 <> 0 AND year > 2023 GROUP BY ALL)"""


@query(
    "observer_cells",
    sql(
        f"""SELECT year, lat, lon, gear, {r('weight', digits=3)}, {r('x', digits=3)}, {r('y', digits=3)}, {r('x - 10000', 'xmin', 3)}, {r('y + 10000', 'ymax', 3)}
FROM obs_cells c WHERE EXISTS (
  SELECT 1 FROM bent e WHERE (e.ay > c.y) <> (e.by_ > c.y) AND c.x < (e.bx - e.ax) * ((c.y - e.ay) / nullif(e.by_ - e.ay, 0)) + e.ax
  GROUP BY poly_id HAVING count(*) % 2 = 1)""",
        pieces=PIECES,
        bent=BENT,
        obs_cells=OBS_CELLS,
    ),
    digits=3,
)
def _(t):
    codes = {"BUILDING": "POT", "MACHINERY": "LGL"}
    obs = t.obs_points.withColumn("species", F.when(F.col("id") % 5 != 0, "target").otherwise("other"))
    obs = obs.withColumn("gear", recode("gear", codes, F.col("gear")))
    cells = sp.observer_cells(obs, polygons(t, SHIFT), "target", 2023, step=STEP)
    return cells.select("year", "lat", "lon", "gear", "weight", "x", "y", F.col("ring")[0].x.alias("xmin"), F.col("ring")[2].y.alias("ymax"))


@query(
    "square_cells",
    sql(
        f"""SELECT id, corner, {r('x + dx', 'x', 3)}, {r('y + dy', 'y', 3)} FROM proj
CROSS JOIN (VALUES (0, -10000, -10000), (1, 10000, -10000), (2, 10000, 10000), (3, -10000, 10000), (4, -10000, -10000)) c(corner, dx, dy)""",
        proj=PROJ,
    ),
    digits=3,
)
def _(t):
    cells = sp.square_cells(sp.project_albers(t.obs_points))
    return cells.select("id", F.posexplode("ring").alias("corner", "c")).select("id", "corner", "c.x", "c.y")


@query(
    "midpoint",
    sql(f"SELECT l_orderkey, l_linenumber, {r('(l_quantity + l_extendedprice) / 2', 'mid')} FROM lineitem"),
)
def _(t):
    return t.base("lineitem").select("l_orderkey", "l_linenumber", sp.midpoint("l_quantity", "l_extendedprice").alias("mid"))
