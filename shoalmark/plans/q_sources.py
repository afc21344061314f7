"""Registered queries: sources and sinks.

Files are written below the shared folder of the session and read back, so each
query covers a writer together with its reader.
"""

from pyspark.sql import functions as F

from ..operators import catch as ct
from ..operators import compare as cp
from ..operators import spatial as sp
from ..sources import readers as rd
from ..sources import writers as wr
from . import incremental as inc
from .oracle import r, sql
from .q_catch import REPORT, REPORT_VIEWS, STATIC, report_inputs, tidy
from .q_compare import appo
from .q_index import trawl9
from .registry import query
from .standins import MODELS, S9


@query(
    "scan_table",
    sql(
        f"""SELECT l_orderkey, l_linenumber, {r('l_extendedprice')} FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_returnflag = 'R'"""
    ),
)
def _(t):
    # A date range, not year(...) = 1997: only the range reaches the row groups of the scan.
    when = F.col("l_shipdate")
    window = (when >= F.lit("1997-01-01").cast("timestamp_ntz")) & (when < F.lit("1998-01-01").cast("timestamp_ntz"))
    return rd.scan_table(
        t.spark,
        f"{t.dir}/lineitem.parquet",
        ["l_orderkey", "l_linenumber", "l_extendedprice"],
        window & (F.col("l_returnflag") == "R"),
    )


@query("scan_csv", sql(f"SELECT species, year, strata, n, {r('biomass')}, {r('cv')} FROM trawl_s9"))
def _(t):
    path = wr.sink_csv(trawl9(t), wr.shared_folder(t.spark))
    return rd.scan_csv(t.spark, path, ddl="species string, year int, strata string, n int, biomass double, cv double")


@query(
    "scan_landed_csv",
    sql(f"SELECT lat, lon, 'Target' AS species, year, gear, {r('kg')} FROM obs_points"),
)
def _(t):
    landed = t.obs_points.select(
        F.col("kg").alias("KG"),
        F.col("year").alias("Year"),
        F.col("lat").alias("LAT400SQKM"),
        F.col("lon").alias("LON400SQKM"),
        F.lit("Target").alias("Species"),
        F.col("gear").alias("GEAR"),
        F.col("id").alias("HAULS"),
    )
    return rd.scan_landed_csv(t.spark, wr.sink_csv(landed, wr.shared_folder(t.spark)))


@query(
    "scan_polygons",
    sql(
        f"""SELECT CAST(id AS VARCHAR) AS poly_id, 5 AS vertices, {r('lon - 0.5', 'xmin')}, {r('lon + 0.5', 'xmax')},
  {r('lat - 0.5', 'ymin')}, {r('lat + 0.5', 'ymax')} FROM obs_points"""
    ),
)
def _(t):
    cells = sp.square_cells(t.obs_points, 0.5, "lon", "lat").select(F.col("id").cast("string").alias("poly_id"), F.array("ring").alias("rings"))
    path = wr.shared_folder(t.spark)
    cells.write.parquet(path)
    polys = rd.scan_polygons(t.spark, path)
    return polys.select("poly_id", F.size(F.flatten("rings")).alias("vertices"), "xmin", "xmax", "ymin", "ymax")


@query("sink_csv", sql(f"SELECT year, area, retention, {r('catch')} FROM area_catch"))
def _(t):
    path = wr.sink_csv(ct.catch_by_area(tidy(t)), wr.shared_folder(t.spark))
    return rd.scan_csv(t.spark, path, ddl="year int, area string, retention string, catch double")


@query(
    "sink_csv_rowid",
    sql(f"SELECT year, model_name, {r('pred', digits=7)}, {r('pred_lci', digits=7)}, {r('pred_uci', digits=7)} FROM fit_total"), digits=7)
def _(t):
    path = wr.sink_csv_keyed(cp.total_prediction(t.fit_by_strata), wr.shared_folder(t.spark))
    return rd.scan_csv(t.spark, path, ddl="year int, model_name string, pred double, pred_lci double, pred_uci double")


@query(
    "sink_tagged_text",
    sql(
        "SELECT line, count(*) AS n FROM (SELECT '#' || tag AS line FROM rep UNION ALL SELECT value FROM rep WHERE value IS NOT NULL) GROUP BY line",
        rep=REPORT,
        **REPORT_VIEWS,
    ),
)
def _(t):
    report = ct.status_report(*report_inputs(t), 1998, STATIC)
    path = wr.sink_tagged_text(report, wr.shared_folder(t.spark))
    return t.spark.read.text(path).groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


@query(
    "versioned_output",
    sql(
        f"""SELECT assessment, model_name, area, year, {r('proportion')} FROM apportioned
CROSS JOIN (VALUES ('2024_nov'), ('2026_nov')) v(assessment) WHERE assessment = '2024_nov' OR year > 1997"""
    ),
)
def _(t):
    path = wr.shared_folder(t.spark)
    table = appo(t).select("model_name", "area", "year", "proportion")
    wr.sink_versioned(table, path, "2024_nov")
    wr.sink_versioned(table, path, "2026_nov")
    # Writing a cycle again replaces that cycle only.
    wr.sink_versioned(table.where(F.col("year") > 1997), path, "2026_nov")
    return t.spark.read.parquet(path)


@query(
    "sink_csv_wide",
    sql(
        "SELECT area, year, "
        + ", ".join(f"{r(f'''max(CASE WHEN model_name = '{m}' THEN proportion END)''', m.lower())}" for m in MODELS)
        + " FROM apportioned GROUP BY area, year"
    ),
)
def _(t):
    path = wr.sink_csv_keyed(cp.apportionment_wide(appo(t), MODELS), wr.shared_folder(t.spark))
    ddl = "year int, area string, " + ", ".join(f"{m} double" for m in MODELS)
    return rd.scan_csv(t.spark, path, ddl=ddl)


@query(
    "scan_landed_layouts",
    sql(f"SELECT lat, lon, 'Target' AS species, year, gear, {r('kg')} FROM obs_points"),
)
def _(t):
    # Two releases in one folder: other order, other case, one column more.
    old = {"KG": "kg", "Year": "year", "LAT400SQKM": "lat", "LON400SQKM": "lon", "Species": "species", "GEAR": "gear", "HAULS": "id"}
    new = {"SPECIES": "species", "LON400SQKM": "lon", "LAT400SQKM": "lat", "gear": "gear", "YEAR": "year", "kg": "kg"}
    rows, path = t.obs_points.withColumn("species", F.lit("Target")), wr.shared_folder(t.spark)
    for release, names in ((0, old), (1, new)):
        part = rows.where(F.col("id") % 2 == release).select(*[F.col(c).alias(n) for n, c in names.items()])
        wr.sink_csv(part, path, mode="append")
    return rd.scan_landed_csv(t.spark, path)


@query(
    "declared_pulls",
    sql(
        f"""SELECT geo, year(l_shipdate) AS year, count(*) AS n, {r('sum(l_quantity)', 'weight')}, {r('max(depth)', 'deepest')}
FROM lineitem JOIN hauls ON l_orderkey = haul WHERE performance <> 'F' GROUP BY geo, year(l_shipdate)"""
    ),
)
def _(t):
    suffix = wr.shared_folder(t.spark)[-12:]
    catch = t.base("lineitem").select(F.col("l_orderkey").alias("haul"), "l_quantity", F.year("l_shipdate").alias("year"))
    hauls = t.hauls.join(t.base("orders").select(F.col("o_orderkey").alias("haul"), F.year("o_orderdate").alias("year")), "haul")
    names = [wr.declare_pull(df, f"pull_{kind}_{suffix}", "haul", 8) for kind, df in (("catch", catch), ("haul", hauls))]
    pulled = rd.scan_pull(t.spark, names[0], ["haul", "l_quantity", "year"])
    sites = rd.scan_pull(t.spark, names[1], ["haul", "geo", "depth"], "performance <> 'F'")
    return pulled.join(sites.hint("merge"), "haul").groupBy("geo", "year").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("weight"), F.max("depth").alias("deepest")
    )


@query("incremental_index", sql(f"SELECT species, year, strata, n, {r('biomass')}, {r('cv')} FROM trawl_s9"))
def _(t):
    source, store = wr.shared_folder(t.spark), wr.shared_folder(t.spark)
    states = inc.trawl_states(S9, ["species"])
    put = lambda rows: rows.write.mode("append").partitionBy("year").parquet(source)
    put(t.gap_area.where(F.col("year") < 1998))
    inc.update(t.spark, source, store, states)
    # The next cycle: later years arrive, and only they are read.
    put(t.gap_area.where(F.col("year") >= 1998))
    inc.update(t.spark, source, store, states)
    return inc.trawl_index_from(inc.current(t.spark, source, store), S9, ["species"])
