"""Exact positions and quantiles of groups too large for one task.

A window ordered over a whole group, or the built-in exact percentile, brings
every distinct value of a group into a single task.  Here a group is cut into
value buckets first; only a bucket is ever sorted by one task, and the position
of a bucket inside its group comes from the bucket totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import salted_join
from .radix import interpolated, neighbours_in, radix_quantiles

#: Rows a bucket should hold.  Groups below this size stay whole.
BUCKET_ROWS = 65_536
#: Sampled values per bucket, and the most sampled values that are cut in one step.
PER_BUCKET = 8
MAX_SAMPLE = 16_384


def _group_key(by: Sequence[str]) -> Column:
    """Keys as one struct: structs join field by field with a missing field equal to a missing field."""
    return (F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))).alias("_g")


def _rank_in(cuts: Column, v: Column, bits: int) -> Column:
    """Number of sorted ``cuts`` (fewer than ``2 ** bits``) below ``v`` by binary search; 0 without cuts."""
    steps = F.expr(f"array({', '.join(str(1 << i) for i in reversed(range(bits)))})")

    def step(at: Column, width: Column) -> Column:
        return F.when(F.coalesce(F.get(cuts, at + width - 1) < v, F.lit(False)), at + width).otherwise(at)

    # Never null, and known to be: a join on it then needs no second evaluation to test for null.
    return F.coalesce(F.when(cuts.isNotNull(), F.aggregate(steps, F.lit(0), step)), F.lit(0))


def _cuts(sample: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Every ``PER_BUCKET``-th of a key's sampled values, in order."""
    ordered = sample.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_all"))
    return ordered.select(*keys, F.filter("_all", lambda _, i: i % PER_BUCKET == PER_BUCKET - 1).alias("_cuts"))


def _with_bucket(vals: DataFrame, value: str, bucket_rows: int) -> DataFrame:
    """Attach an order-preserving bucket number, about equally filled per group.

    The cut points are the values whose hash falls on a fixed lattice.  A group
    with more than ``MAX_SAMPLE`` of them is cut in two steps: by a coarser
    lattice first, and each part again by its own points of the fine one, so
    the number of buckets follows the number of values while no list of cut
    points holds them all.  They depend on nothing but the data: a recomputed
    task, or a second evaluation of the plan, finds the same buckets.  They
    decide only how evenly the work is spread - any cut points give exact
    results.
    """
    base = max(1, bucket_rows // PER_BUCKET)
    bits = (MAX_SAMPLE // PER_BUCKET).bit_length() + 1
    h = F.xxhash64(value)
    candidates = vals.select("_g", value).where(F.pmod(h, F.lit(base)) == 0)
    found = candidates.groupBy("_g").agg(F.count(F.lit(1)).alias("_found"))
    counted = salted_join(candidates, found, ["_g"], "inner")
    coarser = F.ceil(F.col("_found") / MAX_SAMPLE) * base
    top = _cuts(counted.where(F.pmod(h, coarser) == 0), ["_g"], value)

    def parted(df: DataFrame) -> DataFrame:
        return salted_join(df, top, ["_g"], "left").withColumn("_part", _rank_in(F.col("_cuts"), F.col(value), bits)).drop("_cuts")

    # A part holds as many points as the coarser lattice skips, so their number is that of the group over MAX_SAMPLE.
    fine = _cuts(parted(counted.where(F.col("_found") > MAX_SAMPLE).drop("_found")), ["_g", "_part"], value)
    rows = salted_join(parted(vals), fine, ["_g", "_part"], "left")
    inner = _rank_in(F.col("_cuts"), F.col(value), 2 * bits).cast("long")
    return rows.withColumn("_bucket", F.col("_part").cast("long") * F.lit(1 << 32) + inner).drop("_cuts", "_part")


def positions(df: DataFrame, by: Sequence[str], value: str, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Add ``before``: the 0-based position of each row in its group, ordered by ``value``.

    ``(by, value)`` must be unique, otherwise the order among equal values is
    arbitrary.
    """
    rows = _with_bucket(df.withColumn("_g", _group_key(by)), value, bucket_rows)
    sizes = rows.groupBy("_g", "_bucket").agg(F.count(F.lit(1)).alias("_bw"))
    # One row per bucket reaches this window.
    earlier = Window.partitionBy("_g").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_g", "_bucket", F.coalesce(F.sum("_bw").over(earlier), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_g", "_bucket").orderBy(value)
    return (
        rows.join(starts, ["_g", "_bucket"])
        .withColumn("before", F.col("_start") + F.row_number().over(inside) - 1)
        .select(*df.columns, "before")
    )


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Sequence[float],
    weight: str | None = None,
    bucket_rows: int = BUCKET_ROWS,
    few_groups: bool = False,
) -> DataFrame:
    """Linearly interpolated quantiles, one row per group and probability.

    The definition is the one of ``percentile``: position ``p * (n - 1)`` among
    the ``n`` values in order.  Missing values are skipped; ``weight`` is a
    whole-number frequency, and a fractional one is an error.  Columns:
    ``by..., prob, n, q``.

    ``few_groups`` says that the groups are configuration (parameters, samplers,
    models): rows are then not shuffled at all, see ``radix.py``, and more bins
    than ``MAX_LOOKUP_ROWS`` are an error.
    """
    times = F.lit(1).cast("long")
    if weight:
        w = F.col(weight)
        wrong = F.raise_error(F.lit(f"{weight} must hold whole numbers")).cast("long")
        times = F.when(w != F.floor(w), wrong).otherwise(w.cast("long"))
    grid = doubles(probs)
    known = df.where(F.col(value).isNotNull()).select(_group_key(by), F.col(value).cast("double").alias("_v"), times.alias("_w"))
    if few_groups:
        out = radix_quantiles(known.where("_w > 0"), grid)
        return out.select(*[F.col("_g")[c].alias(c) for c in by], "prob", "n", "q")
    # Equal values collapse before they travel, so a repeated value costs one row.
    vals = known.groupBy("_g", "_v").agg(F.sum("_w").alias("_w")).where("_w > 0")
    rows = _with_bucket(vals, "_v", bucket_rows)
    totals = rows.groupBy("_g", "_bucket").agg(F.sum("_w").alias("_bw"))
    # One row per bucket reaches these windows.
    group = Window.partitionBy("_g")
    upto = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = (
        totals.withColumn("_n", F.sum("_bw").over(group))
        .withColumn("_start", F.sum("_bw").over(upto) - F.col("_bw"))
        .withColumn("_ps", neighbours_in(grid, F.col("_n"), F.col("_start"), F.col("_start") + F.col("_bw")))
        .where(F.size("_ps") > 0)
        .drop("_bw")
    )
    inside = Window.partitionBy("_g", "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("_start") + F.coalesce(F.sum("_w").over(inside), F.lit(0))
    out = interpolated(rows.join(starts, ["_g", "_bucket"]).withColumn("_first", first), ["_g"])
    return out.select(*[F.col("_g")[c].alias(c) for c in by], "prob", "n", "q")


def doubles(values: Sequence[float]) -> Column:
    """Array literal of doubles."""
    return F.expr(f"array({', '.join(f'{float(v)!r}D' for v in values)})")


def grid_probs(steps: int = 100) -> list[float]:
    """0 to 1 in equal steps."""
    return [i / steps for i in range(steps + 1)]
