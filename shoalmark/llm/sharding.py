"""Shards by a consistent-hash ring with virtual nodes and bounded loads.

Every shard has some virtual nodes on a ring, a key belongs to the first node
clockwise from its own place, and a shard takes no more keys than its bound:
keys that find it full go on clockwise to the next shard.  All keys of an arc
between two nodes meet the same shards in the same order, so who goes where is
settled on counts per arc - a table as large as the ring, whatever the number
of rows.  A row then needs only its rank within its arc, which comes from the
totals of bounded buckets of the ring; no task holds an arc or a shard.
DataFrame operations throughout.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places on the ring: 0 to 2**60 - 1, fifteen hexadecimal digits of an MD5.
PLACE_BITS = 60
#: Rows of a ring bucket on average, and copies of one row that are written out together.
BUCKET_ROWS = 8192
#: The lookup of arcs is as large as the ring; a ring beyond this is refused, so its broadcast has a bound.
MAX_NODES = 65_536


def ring(shards: int, nodes: int) -> list[tuple[int, int]]:
    """Sorted ``(place, shard)`` of the virtual nodes."""
    if not 0 < shards * nodes <= MAX_NODES:
        raise ValueError(f"a ring has 1 to {MAX_NODES} nodes")
    place = lambda s, v: int(hashlib.md5(f"{s}/{v}".encode()).hexdigest()[:15], 16)
    return sorted((place(s, v), s) for s in range(shards) for v in range(nodes))


def bounds(rows: int, shards: int, slack: float) -> list[int]:
    """Most rows of each shard.  Without slack the bounds add up to the rows, so all shards get full."""
    if slack:
        return [-(-int(rows * (1 + slack) + 1) // shards)] * shards
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def settle(counts: dict[int, int], nodes: list[tuple[int, int]], most: list[int]) -> list[tuple[int, int, int, int, int]]:
    """``(arc, first rank, end rank, shard, first slot)``: in each round every arc offers its rest to its next shard clockwise."""
    left, done, used = dict(counts), dict.fromkeys(counts, 0), [0] * len(most)
    clockwise = {}
    for arc in counts:
        order = dict.fromkeys(nodes[(arc + i) % len(nodes)][1] for i in range(len(nodes)))
        clockwise[arc] = list(order)
    out = []
    for step in range(len(most)):
        for arc in sorted(left):
            shard = clockwise[arc][step]
            take = min(left[arc], most[shard] - used[shard])
            if take:
                out.append((arc, done[arc], done[arc] + take, shard, used[shard]))
                left[arc], done[arc], used[shard] = left[arc] - take, done[arc] + take, used[shard] + take
        left = {a: n for a, n in left.items() if n}
    return out


def _below(cuts: list[int], v: Column) -> Column:
    """Number of sorted ``cuts`` below ``v``, by binary search in a literal array."""
    array = F.expr(f"array({', '.join(f'{c}L' for c in cuts)})")
    widths = F.expr(f"array({', '.join(str(1 << i) for i in reversed(range(len(cuts).bit_length())))})")
    step = lambda at, w: F.when(F.coalesce(F.get(array, at + w - 1) < v, F.lit(False)), at + w).otherwise(at)
    return F.aggregate(widths, F.lit(0), step)


def assign(
    docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 24, nodes: int = 64, slack: float = 0.0
) -> DataFrame:
    """``key, size, text_crc32, shard, slot``, one row per input row.

    ``size`` is the UTF-8 bytes of the text plus 8.  Slots of a shard count from 0 without gaps.  With ``slack`` 0 the
    row counts of any two shards differ by one at most; a larger slack bounds a shard at ``1 + slack`` times the mean
    and moves fewer rows when a shard is added.  A missing text has size 8.  Rows without a key are placed by their
    text.  Repeated rows are counted and share their ranks in any order, as nothing tells them apart.
    """
    spark, on_ring = docs.sparkSession, ring(shards, nodes)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{key}`").alias("_key"),
        (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    name = F.coalesce(F.col("_key").cast("string"), F.concat_ws("/", F.lit("no key"), "text_crc32", "size"))
    rows = rows.withColumn("_at", F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long"))
    rows = rows.withColumn("_arc", F.pmod(_below([p for p, _ in on_ring], F.col("_at")), F.lit(len(on_ring))))
    # One row per arc, so no more than the ring has nodes.
    counts = {r["_arc"]: r["n"] for r in rows.groupBy("_arc").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    pieces = settle(counts, on_ring, bounds(total, shards, slack)) or [(-1, 0, 0, 0, 0)]
    values = ", ".join(f"({a}, {lo}L, {hi}L, {s}, {slot}L)" for a, lo, hi, s, slot in pieces)
    lookup = spark.sql(f"SELECT * FROM VALUES {values} AS t(_arc, _lo, _hi, shard, _first)")

    bits = max(0, (total // BUCKET_ROWS).bit_length())
    same = ["_arc", "_at", "_key", "size", "text_crc32"]
    distinct = rows.groupBy(*same).agg(F.count(F.lit(1)).alias("_m"))
    distinct = distinct.withColumn("_bucket", F.shiftright("_at", PLACE_BITS - bits))
    earlier = Window.partitionBy("_arc").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        distinct.groupBy("_arc", "_bucket")
        .agg(F.sum("_m").alias("_n"))
        .select("_arc", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy("_arc", "_bucket").orderBy("_at", "_key", "text_crc32", "size")
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    ranked = distinct.withColumn("_within", F.coalesce(F.sum("_m").over(inside), F.lit(0))).join(offsets, ["_arc", "_bucket"])
    first = F.col("_before") + F.col("_within")
    each = (
        ranked.withColumn("_rank", first)
        .withColumn("_part", F.explode(F.expr(f"sequence(0L, (_m - 1) div {BUCKET_ROWS})")))
        .withColumn("_from", F.col("_part") * BUCKET_ROWS)
        .withColumn("_i", F.explode(F.expr(f"sequence(_from, least(_from + {BUCKET_ROWS}, _m) - 1)")))
        .withColumn("_rank", F.col("_rank") + F.col("_i"))
    )
    here = (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))
    return (
        each.join(F.broadcast(lookup.withColumnRenamed("_arc", "_a")), (F.col("_arc") == F.col("_a")) & here)
        .select(F.col("_key").alias(key), "size", "text_crc32", "shard", (F.col("_first") + F.col("_rank") - F.col("_lo")).alias("slot"))
    )
