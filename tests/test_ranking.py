"""Positions and quantiles against numpy, with one group holding most of the rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalmark.functions import ranking
from shoalmark.functions.joins import lookup, salted_join
from shoalmark.functions.radix import with_digits
from shoalmark.functions.ranking import exact_quantiles, grid_probs, positions


@pytest.fixture(scope="module")
def skewed(spark):
    rng = np.random.default_rng(7)
    rows = []
    for key, n in (("hot", 6000), ("b", 37), ("c", 1), (None, 400)):
        for i, v in enumerate(np.exp(rng.normal(size=n) * 3)):
            rows.append((key, i, float(round(v, 1)), int(rng.integers(0, 4))))
    rows += [("hot", 100000, None, 1), ("only_null", 0, None, 1)]
    return spark.createDataFrame(rows, "k string, id int, v double, w int")


@pytest.mark.parametrize("bucket_rows", [8, 64, 65536])
def test_quantiles_equal_numpy(skewed, bucket_rows):
    probs = [0.0, 0.025, 0.25, 0.5, 0.9, 1.0]
    got = {(r.k, r.prob): (r.n, r.q) for r in exact_quantiles(skewed, ["k"], "v", probs, bucket_rows=bucket_rows).collect()}
    pdf = skewed.toPandas()
    for key in ("hot", "b", "c", None):
        x = pdf[pdf.k.isna() if key is None else pdf.k == key].v.dropna().to_numpy()
        for p in probs:
            n, q = got[(key, p)]
            assert n == len(x)
            assert q == pytest.approx(np.quantile(x, p), rel=1e-12)
    assert ("only_null", 0.5) not in got


@pytest.mark.parametrize("bucket_rows", [8, 65536])
def test_weighted_quantiles_equal_expanded(skewed, bucket_rows):
    got = exact_quantiles(skewed, ["k"], "v", grid_probs(), "w", bucket_rows).where(F.col("k") == "hot").collect()
    pdf = skewed.toPandas()
    pdf = pdf[(pdf.k == "hot") & pdf.v.notna()]
    x = np.repeat(pdf.v.to_numpy(), pdf.w.to_numpy())
    assert len(got) == 101
    for r in got:
        assert r.n == len(x)
        assert r.q == pytest.approx(np.quantile(x, r.prob), rel=1e-12)


def test_quantiles_without_keys(skewed):
    row = exact_quantiles(skewed, [], "v", [0.5], bucket_rows=16).collect()
    x = skewed.toPandas().v.dropna()
    assert len(row) == 1 and row[0].q == pytest.approx(np.quantile(x, 0.5))


@pytest.mark.parametrize("bucket_rows", [8, 65536])
def test_positions_number_rows_in_order(skewed, bucket_rows):
    out = positions(skewed.select("k", "id"), ["k"], "id", bucket_rows).toPandas()
    assert len(out) == skewed.count()
    for _, g in out.groupby("k", dropna=False):
        g = g.sort_values("id")
        assert list(g.before) == list(range(len(g)))


def test_a_large_group_is_really_cut(skewed):
    from shoalmark.functions.ranking import _group_key, _with_bucket

    vals = skewed.where("v is not null").select(_group_key(["k"]), F.col("v").alias("_v")).distinct()
    sizes = _with_bucket(vals, "_v", 64).where("_g.k = 'hot'").groupBy("_bucket").count().toPandas()["count"]
    total = sizes.sum()
    assert len(sizes) > total / 64 / 3
    assert sizes.max() < total / 4


def test_buckets_do_not_depend_on_row_order(spark, skewed):
    from shoalmark.functions.ranking import _group_key, _with_bucket

    vals = skewed.where("v is not null").select(_group_key(["k"]), F.col("v").alias("_v")).distinct()
    a = _with_bucket(vals, "_v", 64).groupBy("_g", "_bucket").count()
    b = _with_bucket(vals.repartition(3).orderBy(F.rand(1)), "_v", 64).groupBy("_g", "_bucket").count()
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_salted_join_keeps_every_row_once(spark):
    big = spark.range(5000).select(F.when(F.col("id") < 4000, 1).otherwise(F.col("id") % 7).alias("k"), "id")
    small = spark.createDataFrame([(1, "x"), (2, "y")], "k long, t string")
    left = salted_join(big, small, ["k"]).toPandas()
    assert len(left) == 5000 and left.id.is_unique
    assert (left[left.k == 1].t == "x").all() and left[left.k == 3].t.isna().all()
    assert salted_join(big, small, ["k"], "inner").count() == big.where("k in (1, 2)").count()
    with pytest.raises(ValueError):
        salted_join(big, small, ["k"], "right")


def test_lookup_refuses_what_is_too_large_to_broadcast(spark):
    with pytest.raises(ValueError):
        lookup(spark, [(i,) for i in range(100_001)], "a int")


def test_missing_keys_match_in_both_joins(spark):
    from shoalmark.functions.joins import null_safe_join

    a = spark.createDataFrame([(None, 1, 1), ("x", 1, 2), ("y", None, 3)], "k string, y int, v int")
    b = spark.createDataFrame([(None, 1, "n"), ("y", None, "m")], "k string, y int, t string")
    got = {(r.v, r.t) for r in null_safe_join(a, b, ["k", "y"], "left").collect()}
    assert got == {(1, "n"), (2, None), (3, "m")}
    assert {(r.v, r.t) for r in salted_join(a, b, ["k", "y"], "inner").collect()} == {(1, "n"), (3, "m")}
    plan = null_safe_join(a, b, ["k", "y"], "left")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_fractional_frequencies_are_refused(spark):
    df = spark.createDataFrame([("a", 1.0, 0.5)], "k string, v double, w double")
    with pytest.raises(Exception, match="whole numbers"):
        exact_quantiles(df, ["k"], "v", [0.5], "w").collect()


def test_buckets_follow_the_number_of_values(spark, monkeypatch):
    monkeypatch.setattr(ranking, "MAX_SAMPLE", 64)
    for rows in (2_000, 8_000, 32_000):
        vals = spark.range(rows).select(F.struct(F.lit(0).alias("_all")).alias("_g"), (F.col("id") * 1.5).alias("_v"))
        sizes = [r["count"] for r in ranking._with_bucket(vals, "_v", 64).groupBy("_bucket").count().collect()]
        assert sum(sizes) == rows and max(sizes) < 4 * 64 and len(sizes) > rows / 128


ODD = [0.0, -0.0, 1.0, -1.0, 2.0**-1074, -(2.0**-1074), 2.0**-1022, 2.0**1023, -(2.0**1023), 1.7976931348623157e308, 0.1, -0.1, 3.0, 4.0, 5.0]
ODD += [math.nextafter(2.0**k, s * math.inf) for k in range(-60, 61, 3) for s in (1, -1)] + [2.0**k for k in range(-1074, 1024, 41)]


def test_digits_never_fall_when_values_grow(spark):
    rnd = random.Random(2)
    values = ODD + [-v for v in ODD] + [rnd.gauss(0, 1) * 10 ** rnd.randint(-12, 12) for _ in range(3000)] + [1000 + i * 1e-12 for i in range(500)]
    df = spark.createDataFrame([(v,) for v in [*values, math.inf, -math.inf, math.nan]], "v double")
    rows = sorted(((r.v, r._d1, r._d2) for r in with_digits(df, "v").collect()), key=lambda r: (math.isnan(r[0]), r[0]))
    keys = [r[1:] for r in rows]
    assert keys == sorted(keys)
    # A bin of both digits is a narrow one.
    first, last = {}, {}
    for v, *k in rows[1:-2]:
        first.setdefault(tuple(k), v)
        last[tuple(k)] = v
    assert all(last[k] - first[k] <= 2.0**-31 * abs(last[k]) or abs(last[k]) < 1e-300 for k in first)


@pytest.mark.parametrize("weight", [None, "w"])
def test_radix_quantiles_equal_a_sorted_list(spark, weight):
    rnd = random.Random(7)
    groups = {
        "spread": [rnd.lognormvariate(0, 8) * rnd.choice([-1, 1]) for _ in range(4000)], "narrow": [1000 + rnd.random() * 1e-9 for _ in range(3000)],
        "one": [5.5], "two": [-1.0, 2.0], "equal": [7.25] * 900, "hot": [0.0] * 2000 + [rnd.gauss(0, 1) for _ in range(999)], None: [1.0, 2.0, 4.0],
        "infinite": [-math.inf, -math.inf, -math.inf, 1.0, 2.0, 3.0, math.inf, math.inf, math.inf],
    }
    rows = [(k, v, rnd.randint(0, 3)) for k, vs in groups.items() for v in vs] + [("spread", None, 2), ("gone", None, 1)]
    df = spark.createDataFrame(rows, "k string, v double, w int")
    probs = [0.0, 0.025, 0.25, 1 / 3, 0.5, 0.975, 1.0]
    got = {(r.k, r.prob): (r.n, r.q) for r in exact_quantiles(df, ["k"], "v", probs, weight, few_groups=True).collect()}
    want = {}
    for k in groups:
        vs = sorted(v for g, v, w in rows if g == k and v is not None for _ in range(w if weight else 1))
        for p in probs if vs else ():
            h = p * (len(vs) - 1)
            lo, hi = vs[math.floor(h)], vs[math.ceil(h)]
            want[k, p] = (len(vs), lo if lo == hi else lo + (hi - lo) * (h - math.floor(h)))
    assert got.keys() == want.keys()
    for key, (n, q) in want.items():
        assert got[key][0] == n and (got[key][1] == pytest.approx(q, rel=1e-12) or math.isnan(q) and math.isnan(got[key][1])), key


def test_radix_quantiles_shuffle_no_rows_and_check_their_groups(spark):
    df = spark.range(20_000).selectExpr("id % 3 AS k", "cast(id as double) AS v")
    out = exact_quantiles(df, ["k"], "v", [0.5], few_groups=True)
    assert sorted(r.q for r in out.collect()) == [9999.0, 9999.0, 10000.0] or len(out.collect()) == 3
    many = spark.range(120_000).selectExpr("id AS k", "1D AS v")
    with pytest.raises(Exception, match="too many to broadcast"):
        exact_quantiles(many, ["k"], "v", [0.5], few_groups=True).collect()
