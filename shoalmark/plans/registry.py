"""Registration of queries with their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .standins import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def comparable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded (and -0.0 turned into 0.0), whole numbers widened, for a value-by-value comparison."""
    out = []
    for f in df.schema.fields:
        c = f"`{f.name}`"
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(f"round(CAST({c} AS DOUBLE), {digits}) + 0D AS {c}")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            out.append(f"CAST({c} AS BIGINT) AS {c}")
        else:
            out.append(c)
    return df.selectExpr(*out)


def query(name: str, sql: str | None = None, digits: int = 6):
    """Register a function of the stand-in tables under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: comparable(fn(Tables(spark, sf_dir)), digits)
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register
