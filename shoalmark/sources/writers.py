"""Sinks.  Every writer leaves one directory of part files; none funnels rows through the driver."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """A fresh sub-folder of the shared folder the cluster names.

    Only a local session without that setting gets a folder of its own; on a
    cluster a machine-local folder would not be seen by the executors.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_KEY} to a folder all executors can reach")
        base = tempfile.mkdtemp(prefix="shoalmark-")
        spark.conf.set(CHECKPOINT_KEY, base)
    return os.path.join(base, uuid.uuid4().hex)


def land(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    For a table several later steps read: it is computed once, and a lost
    executor costs a re-read, not a recomputation.
    """
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sink_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """CSV with a header and ``NA`` for missing."""
    df.write.mode(mode).option("header", True).option("nullValue", "NA").csv(path)
    return path


def sink_csv_keyed(df: DataFrame, path: str, key: str = "year", mode: str = "overwrite") -> str:
    """CSV whose rows are identified by a key column, which comes first.

    Stands in for files with a leading row number: row numbers need a global
    order, and readers that zip by row number break when a row is missing.
    """
    return sink_csv(df.select(key, *[c for c in df.columns if c != key]), path, mode)


def tagged_lines(df: DataFrame) -> DataFrame:
    """``(ord, tag, value)`` rows to report lines: a ``#TAG`` line, then the value line if there is a value."""
    lines = df.select(
        "ord",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("part"), F.concat(F.lit("#"), F.col("tag")).alias("value")),
                F.struct(F.lit(1).alias("part"), F.col("value").alias("value")),
            )
        ).alias("line"),
    )
    return lines.select("ord", "line.part", "line.value").where("value is not null")


def sink_tagged_text(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Tagged report as text, in order.  A report has some dozens of lines, so it is written as one part."""
    lines = tagged_lines(df).repartition(1).sortWithinPartitions("ord", "part")
    lines.select("value").write.mode(mode).text(path)
    return path


def sink_versioned(df: DataFrame, path: str, assessment: str, mode: str = "overwrite") -> str:
    """One partition directory per assessment cycle; writing a cycle leaves the others alone."""
    (
        df.withColumn("assessment", F.lit(assessment))
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("assessment")
        .parquet(path)
    )
    return path


def declare_pull(df: DataFrame, name: str, key: str, buckets: int, year: str = "year", path: str | None = None) -> str:
    """A pulled table as catalog table ``name``: a folder per year, ``buckets`` files by ``key`` in each.

    Later scans read the years they need and join pulls of the same key and number of buckets without an exchange.
    ``path`` is in shared storage; by default a fresh folder below the one the session names.
    """
    spread = df.repartition(buckets, key)  # as the buckets are dealt, so a year has one file per bucket
    writer = spread.write.format("parquet").mode("overwrite").partitionBy(year).bucketBy(buckets, key).sortBy(key)
    writer.option("path", path or shared_folder(df.sparkSession)).saveAsTable(name)
    return name


def dataset_bundle(views: dict[str, DataFrame], register: bool = False) -> dict[str, DataFrame]:
    """Named set of tables for downstream steps, optionally also as temporary views."""
    if register:
        for name, df in views.items():
            df.createOrReplaceTempView(name)
    return dict(views)
