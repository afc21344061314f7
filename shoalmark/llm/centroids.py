"""Centroid clustering of integer vectors with scalar lookup tables.

Components become integers once, and vectors are landed in blocks: for each
dimension the sorted values that occur in the block, and for each vector their
places.  A round tabulates, for each dimension, occurring value and centroid,
the squared difference; a vector's distances to all centroids are then sums of
table rows.  Tables are as large as the values of one block, whatever the table
of vectors holds.  A task returns sums and counts by centroid, Spark adds them
up exactly, and centroids (k x dimensions integers) go out with the next round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import importable, land

#: Vectors of a block: their table sums take this many x k numbers.
BLOCK = 4096
#: Components beyond this could make a distance of 64 dimensions that a long does not hold.
LARGEST = 1 << 27
#: What is known of a vector in the end.
FIGURES = [("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid", "array<long>")]


def usable(vector: Column, dims: int) -> Column:
    """A vector with exactly ``dims`` components, none missing or not finite."""
    infinite = [float("inf"), float("-inf")]
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & ~x.isin(infinite)), F.lit(False))


def integers(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component, computed in double precision; it fails beyond ``LARGEST``."""
    whole = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    high = F.forall(whole, lambda v: v.between(-LARGEST, LARGEST))
    return F.when(high, whole).otherwise(F.raise_error(F.lit(f"a component is beyond {LARGEST} after scaling; distances would leave a long")))


def start(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The ``k`` vectors (``_key``, ``_v``) whose key hashes smallest; equal keys go by their components."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_key").cast("string"), F.lit("")))
    rows = vectors.select(F.sha2(named, 256).alias("h"), "_v").orderBy("h", "_v").limit(k).collect()
    return [r._v for r in rows]


def _blocks(dims: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                values = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
                occurring, places = zip(*(np.unique(c, return_inverse=True) for c in values.T), strict=True)
                sizes = [len(o) for o in occurring]
                narrow = np.uint8 if max(sizes) <= 256 else np.uint16
                key = part.column(0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.ListArray.from_arrays(pa.array([0, len(key)], pa.int32()), key),
                        pa.array([sizes], pa.list_(pa.int32())),
                        pa.array([np.concatenate(occurring)], pa.list_(pa.int64())),
                        pa.array([np.stack(places).astype(narrow).tobytes()], pa.binary()),
                    ],
                    schema=schema,
                )

    return run


def quantised(vectors: DataFrame, dims: int) -> DataFrame:
    """``_key``, ``_v`` (integers) as landed blocks: keys, number of values by dimension, values, places by dimension."""
    from pyspark.sql.pandas.types import to_arrow_schema

    key = vectors.schema["_key"].dataType
    fields = [("keys", T.ArrayType(key)), ("sizes", T.ArrayType(T.IntegerType())), ("occurring", T.ArrayType(T.LongType())), ("places", T.BinaryType())]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    return land(vectors.mapInArrow(_blocks(dims, to_arrow_schema(schema)), schema))


def _unpacked(batches: Iterator[pa.RecordBatch], dims: int):
    """Keys, occurring values by dimension and places by dimension of each block."""
    for batch in batches:
        keys, sizes, occurring, places = (batch.column(i) for i in range(4))
        for i in range(batch.num_rows):
            size = sizes[i].values.to_numpy()
            values = np.split(occurring[i].values.to_numpy(), np.cumsum(size)[:-1])
            raw = places[i].as_buffer()
            n = len(keys[i].values)
            kind = np.uint8 if raw.size == n * dims else np.uint16
            yield keys[i].values, values, np.frombuffer(raw, kind).reshape(dims, n)


def nearest(occurring: list[np.ndarray], places: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (the smaller of equals) and the squared distance, by table gathers and sums."""
    table = [(values[:, None] - centroids[:, d]) ** 2 for d, values in enumerate(occurring)]
    # Narrower sums are quicker and as exact where no distance can leave them.
    kind = np.int32 if sum(int(t.max()) for t in table) < 2**31 else np.int64
    total = np.zeros((places.shape[1], len(centroids)), kind)
    row = np.empty_like(total)
    for squares, place in zip(table, places, strict=True):
        np.take(squares.astype(kind), place, axis=0, out=row, mode="clip")
        total += row
    best = total.argmin(axis=1)
    return best, total[np.arange(len(best)), best].astype(np.int64)


def _round(centroids: np.ndarray):
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for _, occurring, places in _unpacked(batches, dims):
            cluster, _ = nearest(occurring, places, centroids)
            counts += np.bincount(cluster, minlength=k)
            for d, values in enumerate(occurring):
                width = len(values)
                seen = np.bincount(cluster * width + places[d], minlength=k * width).reshape(k, width)
                sums[:, d] += seen @ values
        held = np.flatnonzero(counts)
        if len(held):
            column = lambda x: pa.array(x, pa.int64())
            # Dimension -1 holds the count.
            number, dim = np.repeat(held, dims + 1), np.tile(np.arange(-1, dims), len(held))
            total = np.concatenate([counts[held, None], sums[held]], axis=1).ravel()
            yield pa.RecordBatch.from_arrays([column(number), column(dim), column(total)], ["cluster", "dim", "total"])

    return run


def moved(blocks: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """Centroids after one round: the floor of the mean of their vectors; one without vectors stays."""
    sent = np.array(centroids, np.int64)
    parts = blocks.mapInArrow(_round(sent), "cluster long, dim long, total long")
    sums = parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    total = {(r.cluster, r.dim): int(r.total) for r in sums}
    return [[total[c, d] // total[c, -1] for d in range(len(old))] if (c, -1) in total else old for c, old in enumerate(centroids)]


def _assign(centroids: np.ndarray, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, occurring, places in _unpacked(batches, centroids.shape[1]):
            cluster, distance = nearest(occurring, places, centroids)
            yield pa.RecordBatch.from_arrays([keys, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], schema=schema)

    return run


def cluster(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    dims: int = 64,
    scale: int = 256,
    seed: int = 2,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """Cluster and distance of every usable vector after ``rounds`` of moving ``k`` centroids.

    Vectors of another length than ``dims``, missing ones, and those with a missing or infinite component or a NaN are
    left out.  Components are ``floor(scale * x)``; one beyond 2**27 makes the call fail, as distances might not fit a
    long.  Centroids start as the vectors with the smallest ``sha256("<seed>:<key>")`` (a missing key hashes as '';
    equal keys go by their components); with fewer than ``k`` vectors there are as many centroids.  A vector goes to
    the nearest centroid, of equals to the one with the smaller number.  Returns ``key, cluster, distance,
    cluster_inertia, inertia, centroid`` (its components), one row per vector kept, repeated rows each by itself; other
    columns are not returned.  An empty table gives an empty one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = vectors.sparkSession
    importable(spark)
    kept = vectors.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{vector}`").alias("_v")).where(usable(F.col("_v"), dims))
    kept = kept.withColumn("_v", integers(F.col("_v"), scale))
    centroids = start(kept, k, seed)
    key_type = kept.schema["_key"].dataType
    if not centroids:
        return spark.range(0).select(F.lit(None).cast(key_type).alias(key), *[F.lit(None).cast(t).alias(n) for n, t in FIGURES])
    blocks = quantised(kept, dims)
    for _ in range(rounds):
        centroids = moved(blocks, centroids)
    fields = [T.StructField("_key", key_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())]
    schema = T.StructType(fields)
    placed = land(blocks.mapInArrow(_assign(np.array(centroids, np.int64), to_arrow_schema(schema)), schema))
    sums = {r.cluster: int(r.n) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()}
    total = sum(sums.values())
    rows = [(c, sums.get(c, 0), total, v) for c, v in enumerate(centroids)]
    of_cluster = spark.createDataFrame(rows, "_c int, cluster_inertia long, inertia long, centroid array<long>")
    found = placed.join(F.broadcast(of_cluster), F.col("cluster") == F.col("_c"))  # k rows
    return found.select(F.col("_key").alias(key), *[n for n, _ in FIGURES])
