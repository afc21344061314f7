"""Joins that stay even when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Lookup tables are configuration (strata, gears, scenarios).  They are built
#: from Python rows, so their size is known before anything is broadcast.
MAX_LOOKUP_ROWS = 100_000


def lookup(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """Configuration rows as a DataFrame marked for broadcasting.

    Refuses more rows than a broadcast can safely carry, so the hint below is
    backed by a checked size.  The rows become part of the plan (a local table),
    no job is needed to read them.
    """
    rows = list(rows)
    if len(rows) > MAX_LOOKUP_ROWS:
        raise ValueError(f"{len(rows)} rows are too many for a lookup; store them as a table and join it")
    fields = T.StructType.fromDDL(schema).fields

    def column(i: int, kind: T.DataType) -> pa.Array:
        values = [r[i] for r in rows]
        if isinstance(kind, T.MapType):
            values = [None if v is None else list(v.items()) for v in values]
        return pa.array(values, to_arrow_type(kind))

    table = pa.table({f.name: column(i, f.dataType) for i, f in enumerate(fields)})
    return F.broadcast(spark.createDataFrame(table, schema))


def checked_broadcast(df: DataFrame, most: int = MAX_LOOKUP_ROWS) -> DataFrame:
    """A derived table that is small by design, marked for broadcasting; more than ``most`` rows are an error.

    The rows are counted by the plan itself, before the first of them is sent.
    """
    rows = df.agg(F.count(F.lit(1))).scalar()
    wrong = F.raise_error(F.concat(rows.cast("string"), F.lit(f" rows are too many to broadcast; the limit is {most}")))
    return F.broadcast(df.where(F.when(rows > most, wrong.cast("boolean")).otherwise(F.lit(True))))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a missing key matches a missing key; the keys of ``left`` are kept.

    Stays a hash or sort-merge join.  For inner, left and left-semi joins.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"the keys of the right side would be needed for a {how} join")
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = None
    for k in keys:
        nullable = left.schema[k].nullable and right.schema[k].nullable
        hit = left[k].eqNullSafe(renamed[f"_r_{k}"]) if nullable else left[k] == renamed[f"_r_{k}"]
        on = hit if on is None else on & hit
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    how: str = "left",
    salts: int = 32,
) -> DataFrame:
    """Equi-join of row-level data with a table that has one row per key; missing keys match.

    ``big`` may have most of its rows on one key: each key is spread over
    ``salts`` sub-keys by a hash of the row, and the per-key rows of ``small``
    are repeated once per sub-key.  No broadcast is forced: adaptive execution
    measures ``small`` and converts the join where it is tiny, and splits a
    sub-key that is still too large.
    """
    spread = [c for c in big.columns if c not in keys] or list(keys)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return null_safe_join(left, right, [*keys, "_salt"], how).drop("_salt")
