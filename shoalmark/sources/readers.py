"""Scans: files and remote tables in, DataFrames with lower-case names out."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import placed
from .schemas import schema


def lower_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def scan_table(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    where: str | Column | None = None,
) -> DataFrame:
    """Parquet scan.  Filter and projection are left to the scan; no sort is added."""
    df = lower_names(spark.read.parquet(path))
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def scan_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    columns: Sequence[str] | None = None,
    where: str | Column | None = None,
    partition_by: tuple[str, int, int, int] | None = None,
    **options: str,
) -> DataFrame:
    """Scan of a remote table; the filter is pushed into the remote query.

    ``partition_by`` is ``(column, lowest, highest, parts)`` and makes the read
    parallel.  The driver jar and the credentials come from the session.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_by:
        column, low, high, parts = partition_by
        reader = (
            reader.option("partitionColumn", column)
            .option("lowerBound", low)
            .option("upperBound", high)
            .option("numPartitions", parts)
        )
    df = lower_names(reader.load())
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def scan_csv(spark: SparkSession, path: str, table: str | None = None, ddl: str | None = None) -> DataFrame:
    """CSV with a header line, ``NA`` for missing, and a declared schema."""
    declared = ddl or schema(table)
    return lower_names(spark.read.csv(path, header=True, nullValue="NA", schema=declared))


def landed_layouts(spark: SparkSession, path: str | list[str], needed: Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """Header line (as a tuple of lower-case names) to the files below ``path`` that have it.

    A file's header is its line that names all the ``needed`` columns, in any order and case, found in one pass over
    the lines.  A file without such a line is an error: its values would land in the wrong columns.  What comes back is
    a name per file, as the listing of the folder has it.
    """
    names = F.transform(F.split(F.lower("value"), ","), lambda c: F.btrim(c, F.lit(' \t"')))
    whole = F.size(F.array_intersect(names, F.array(*[F.lit(n) for n in needed]))) == len(set(needed))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.when(whole, names).alias("names"))
    found: dict[tuple[str, ...], list[str]] = {}
    for r in lines.groupBy("file").agg(F.max("names").alias("names")).collect():
        if r.names is None:
            raise ValueError(f"no header with {sorted(needed)} in landed file {r.file}")
        found.setdefault(tuple(r.names), []).append(unquote(r.file))
    return found


def scan_landed_csv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Observer catch as landed: header case, column order and extra columns vary between releases.

    ``lat400sqkm`` is the cell latitude.  Files are grouped by their own header line and each group is read by name,
    so a folder may hold several layouts; every group is an ordinary pruned scan.
    """
    types = dict(part.strip().split(" ") for part in schema("observer_catch").split(","))
    out = None
    for names, files in sorted(landed_layouts(spark, path, list(types)).items()):
        twice = {n for n in types if names.count(n) > 1}
        if twice:
            raise ValueError(f"landed files name {sorted(twice)} more than once: {sorted(files)[:3]}")
        # Names that are not needed may repeat; only their places matter.
        ddl = ", ".join(f"`{n}` {types[n]}" if n in types else f"`_other{i}` string" for i, n in enumerate(names))
        part = spark.read.csv(sorted(files), header=True, nullValue="NA", schema=ddl).select(*types)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema("observer_catch"))
    return out.withColumnsRenamed({"lat400sqkm": "lat", "lon400sqkm": "lon"})


def scan_pull(
    spark: SparkSession, name: str, columns: Sequence[str] | None = None, where: str | Column | None = None
) -> DataFrame:
    """A declared pull (``writers.declare_pull``): only the years and columns a plan needs are read.

    Pulls with the same key and number of buckets are joined on the key without an exchange, and a join with a
    filtered table of years prunes the years at run time.
    """
    df = lower_names(spark.table(name))
    if where is not None:
        df = df.where(where)
    return df.select(*columns) if columns else df


def scan_polygons(spark: SparkSession, path: str) -> DataFrame:
    """Polygon layer ``(poly_id, rings)`` with the bounding box of each polygon.

    A polygon is a list of rings: parts, holes and islands.  Files with one ``ring`` a polygon are read as well.
    """
    df = spark.read.schema(schema("polygons")).parquet(path)
    return with_bounds(df.select("poly_id", F.coalesce("rings", F.when(F.col("ring").isNotNull(), F.array("ring"))).alias("rings")))


def with_bounds(polys: DataFrame) -> DataFrame:
    """``poly_id, rings`` with ``xmin, xmax, ymin, ymax`` over all rings; vertices without a coordinate do not count."""
    vertices = F.filter(F.flatten("rings"), placed)
    xs, ys = F.transform(vertices, lambda v: v.x), F.transform(vertices, lambda v: v.y)
    return polys.select(
        "poly_id",
        "rings",
        F.array_min(xs).alias("xmin"),
        F.array_max(xs).alias("xmax"),
        F.array_min(ys).alias("ymin"),
        F.array_max(ys).alias("ymax"),
    )
