"""Stations, catch cells, projection and polygon membership."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cover import DIVISIONS, FEW_EDGES, cover, holds, size_of
from ..functions.geo import AlbersParams, albers_xy, dense_ring, square_ring
from ..functions.nulls import col, not_in, strict_mean, strict_sum
from ..sources.lookups import LONGLINE_AREAS, OBSERVER_FIXED_GEARS, TRAWL_AREAS, recode
from ..sources.readers import with_bounds


def midpoint(a: str | Column, b: str | Column) -> Column:
    return (col(a) + col(b)) / 2


def sum_and_centroid(
    df: DataFrame, by: Sequence[str], value: str, lat: str = "lat", lon: str = "lon", out: str = "catch"
) -> DataFrame:
    """Total and mean position per group; a missing part makes each of them missing."""
    return df.groupBy(*by).agg(
        strict_sum(value).alias(out), strict_mean(lat).alias("lat"), strict_mean(lon).alias("lon")
    )


def trawl_stations(bts: DataFrame) -> DataFrame:
    """Trawl catch per haul and year: region, count, mean position."""
    rows = bts.select(
        "species_code",
        "year",
        # An area that is missing or not listed belongs to the central region.
        recode("regulatory_area", TRAWL_AREAS, "CGOA", missing_is_other=True).alias("region"),
        F.col("hauljoin").alias("station"),
        "count",
        midpoint("latitude_dd_start", "latitude_dd_end").alias("lat"),
        midpoint("longitude_dd_start", "longitude_dd_end").alias("lon"),
    )
    return sum_and_centroid(rows, ["species_code", "year", "region", "station"], "count")


def longline_stations(
    lls: DataFrame,
    excluded_areas: Iterable[str] = ("Bering Sea", "Aleutians"),
    excluded_habitat: str = "Shallow cross-shelf gully",
    station_below: int = 500,
) -> DataFrame:
    """Longline catch per station and year; no recorded catch counts as 0.

    A missing area is kept, a missing habitat is not, as in the survey rules.
    """
    area = F.col("council_sablefish_management_area")
    rows = lls.where(
        not_in(area, excluded_areas)
        & (F.col("habitat_type") != excluded_habitat)
        & (F.col("station_number") < station_below)
    ).select(
        "species_code",
        "year",
        recode(area, LONGLINE_AREAS, "EGOA").alias("region"),
        F.col("station_number").cast("long").alias("station"),
        F.coalesce("catch_freq", F.lit(0.0)).alias("catch_freq"),
        midpoint("start_latitude", "end_latitude").alias("lat"),
        midpoint("start_longitude", "end_longitude").alias("lon"),
    )
    return sum_and_centroid(rows, ["species_code", "year", "region", "station"], "catch_freq")


def station_catch(bts: DataFrame, lls: DataFrame) -> DataFrame:
    """Both surveys' stations stacked, with the survey's name and a presence flag."""
    stacked = (
        longline_stations(lls)
        .withColumn("survey", F.lit("LLS"))
        .unionByName(trawl_stations(bts).withColumn("survey", F.lit("BTS")), allowMissingColumns=True)
    )
    return stacked.withColumn("present", F.col("catch") > 0)


def gear_cell_catch(obs: DataFrame, species: str, after: int = 2022) -> DataFrame:
    """Observed catch in tonnes by year, cell centre and gear class."""
    return (
        obs.where((F.col("species") == species) & (F.col("year") > after))
        .withColumn("gear", recode("gear", OBSERVER_FIXED_GEARS, "Trawl", missing_is_other=True))
        .groupBy("year", "lat", "lon", "gear")
        .agg((strict_sum("kg") / 1000).alias("weight"))
    )


def project_albers(
    df: DataFrame, params: AlbersParams = AlbersParams(), lon: str = "lon", lat: str = "lat"
) -> DataFrame:
    """Add equal-area ``x, y`` in metres."""
    x, y = albers_xy(lon, lat, params)
    return df.withColumn("x", x).withColumn("y", y)


def project_rings(polys: DataFrame, params: AlbersParams = AlbersParams(), step: float = 0.05) -> DataFrame:
    """Polygons in degrees as polygons in metres.

    Edges are straight in degrees and bent in metres, so they get a vertex at least every ``step`` degrees first.
    """

    def vertex(v: Column) -> Column:
        x, y = albers_xy(v.x, v.y, params)
        return F.struct(x.alias("x"), y.alias("y"))

    rings = F.transform("rings", lambda r: F.transform(dense_ring(r, step), vertex))
    return with_bounds(polys.select("poly_id", rings.alias("rings")))


def points_in_strata(
    pts: DataFrame, polys: DataFrame, x: str = "lon", y: str = "lat", few: int = FEW_EDGES, divisions: int = DIVISIONS
) -> DataFrame:
    """Points that lie inside at least one polygon, or on an edge of one; each point comes out once.

    ``polys`` is ``(poly_id, rings, xmin, xmax, ymin, ymax)``; rings are parts, holes and islands, judged together by
    the even-odd rule.  Places, not points, meet the polygons' cells (``functions/cover.py``): a place that many points
    share is judged once, and only a place in a cell that an edge touches is compared with edges.  A place is looked up
    in a cell of each size that the covers have.  Points without a coordinate are in no polygon.
    """
    cells = cover(polys.select("poly_id", "rings", "xmin", "xmax", "ymin", "ymax"), few, divisions)
    sizes = cells.agg(F.collect_set("k")).scalar()
    places = pts.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).where("_x IS NOT NULL AND _y IS NOT NULL").distinct()

    def at(c: str) -> Column:
        return F.floor(F.col(c) / size_of(F.col("_k"))).cast("long")

    found = (
        places.withColumn("_k", F.explode(sizes))
        # However few the polygons, the number of their cells has no bound: never broadcast by a hint.
        .join(cells.hint("merge"), (F.col("_k") == F.col("k")) & (at("_x") == F.col("cx")) & (at("_y") == F.col("cy")))
        .where(holds(F.col("_x"), F.col("_y")))
        .select("_x", "_y")
        .distinct()
    )
    return pts.join(found, (F.col(x) == F.col("_x")) & (F.col(y) == F.col("_y")), "left_semi")


def observer_cells(
    obs: DataFrame,
    polys: DataFrame,
    species: str,
    after: int = 2022,
    params: AlbersParams = AlbersParams(),
    half: float = 10_000,
    step: float = 0.05,
) -> DataFrame:
    """Observed catch by year, gear class and cell centre, in the survey strata, with the cell's square in metres.

    One plan: catch is summed, centres are projected, those inside a stratum (polygons in degrees, reprojected) stay.
    """
    catch = project_albers(gear_cell_catch(obs, species, after), params)
    return square_cells(points_in_strata(catch, project_rings(polys, params, step), x="x", y="y"), half)


def square_cells(df: DataFrame, half: float = 10_000, x: str = "x", y: str = "y") -> DataFrame:
    """Add ``ring``: the square of side ``2 * half`` around each point, first corner repeated."""
    return df.withColumn("ring", square_ring(x, y, half))
