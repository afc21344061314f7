"""Incremental cycles: mergeable states per year, recomputed only where a year's files have changed.

A source table lies in a folder per year (``year=...``).  For each year the
store keeps sums that can be merged - never finished figures - and the digest
of the files they came from.  An update lists the source, reads the years whose
digest is new, and replaces their states; a year that has left the source is no
longer used.  Results are finished from the states of all years, and are those
of a full run.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import index as ix
from ..operators import length as ln
from ..sources.lookups import StrataScheme


def year_digests(spark: SparkSession, source: str) -> dict[int, str]:
    """Digest of name, length and time of the files of each year; no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(source)
    entry = F.concat_ws("|", "path", F.col("length").cast("string"), F.col("modificationTime").cast("string"))
    year = F.regexp_extract("path", r"/year=(-?\d+)/", 1).cast("int")
    rows = files.select(year.alias("year"), entry.alias("e")).groupBy("year").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("e"))), 256).alias("d"))
    return {r.year: r.d for r in rows.collect()}


def stored(spark: SparkSession, store: str) -> DataFrame | None:
    try:
        return spark.read.parquet(store)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def update(spark: SparkSession, source: str, store: str, states: Callable[[DataFrame], DataFrame]) -> list[int]:
    """Bring the store up to date; the years that were read.

    ``states`` turns source rows into state rows with a column ``year``.  It is applied to changed years only, and each
    of its rows comes from one year.  A year's states are replaced together, so an update that breaks off is repeated.
    """
    now, old = year_digests(spark, source), stored(spark, store)
    before = {} if old is None else {r.year: r.digest for r in old.select("year", "digest").distinct().collect()}
    changed = sorted(y for y, d in now.items() if before.get(y) != d)
    if changed:
        digest = F.create_map(*[F.lit(x) for y in changed for x in (y, now[y])])
        rows = states(spark.read.parquet(source).where(F.col("year").isin(changed)))
        writer = rows.withColumn("digest", F.element_at(digest, F.col("year"))).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(store)
    return changed


def current(spark: SparkSession, source: str, store: str) -> DataFrame:
    """States of the years the source has now; one that is not up to date is an error."""
    now = year_digests(spark, source)
    rows = stored(spark, store)
    if rows is None:
        raise ValueError(f"nothing is stored in {store}")
    known = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(d).alias("d")) for y, d in sorted(now.items())])
    rows = rows.where(F.col("year").isin(list(now)))
    stale = F.raise_error(F.concat(F.lit("stale states of year "), F.col("year").cast("string"))).cast("boolean")
    return rows.where(F.when(F.exists(known, lambda k: (k.y == F.col("year")) & (k.d == F.col("digest"))), F.lit(True)).otherwise(stale)).drop("digest")


def trawl_states(scheme: StrataScheme, by: Sequence[str] = ()) -> Callable[[DataFrame], DataFrame]:
    """States of ``trawl_index``: hauls with how many are known, biomass and variance."""

    def states(biom: DataFrame) -> DataFrame:
        rows = ix.assign_strata(ix.impute_variance(biom), scheme).groupBy(*by, "year", "strata")
        return rows.agg(
            F.count(F.lit(1)).alias("rows"), F.count("n_haul").alias("known"), F.sum("n_haul").alias("n"),
            F.sum("biomass_mt").alias("biomass"), F.sum("biomass_var").alias("var"),
        )

    return states


def trawl_index_from(states: DataFrame, scheme: StrataScheme, by: Sequence[str] = ()) -> DataFrame:
    """``index.trawl_index`` from its states."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    sums = (
        states.groupBy(*by, "year", "strata")
        .agg(
            F.when(F.sum("known") == F.sum("rows"), F.sum("n")).alias("n"),
            zero("biomass").alias("biomass"),
            zero("var").alias("_var"),
        )
        .select(*by, "year", "strata", "n", "biomass", ix.pooled_cv("_var", "biomass").alias("cv"))
    )
    return ix.clean_cv(ix.scaffold(sums, scheme.strata, by))


def length_states(by: Sequence[str] = ()) -> Callable[[DataFrame], DataFrame]:
    """States of ``length_comp_by_year``: frequency by length."""
    return lambda rows: rows.groupBy(*by, "year", "length").agg(F.sum("freq").alias("freq"))


def length_comp_from(states: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``length.length_comp_by_year`` (missing frequencies skipped) from its states."""
    return ln.length_comp_by_year(states, by)
