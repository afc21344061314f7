"""Plans under skew: what adaptive execution and salting do with a dominant key."""

import pytest
from pyspark.sql import functions as F

from shoalmark.functions.joins import salted_join
from shoalmark.functions.ranking import exact_quantiles
from shoalmark.operators import depth as dp
from shoalmark.operators import index as ix
from shoalmark.plans.standins import S9, Tables


@pytest.fixture
def small_limits(spark):
    """Thresholds so low that a test table counts as large."""
    new = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    old = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def skewed_tables(spark, data_dir, folder):
    """The test tables with half of lineitem on one part."""
    src = Tables(spark, data_dir)
    li = src.base("lineitem")
    hot = F.when(F.col("l_orderkey") % 2 == 0, F.lit(7).cast("long")).otherwise(F.col("l_partkey"))
    li.withColumn("l_partkey", hot).repartition(8).write.mode("overwrite").parquet(f"{folder}/lineitem.parquet")
    src.base("part").write.mode("overwrite").parquet(f"{folder}/part.parquet")
    return Tables(spark, folder)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_row_level_join_splits_the_hot_key(spark, data_dir, tmp_path, small_limits):
    t = skewed_tables(spark, data_dir, str(tmp_path))
    df = ix.trawl_index(t.gap_area, S9, ["species"])
    plan = final_plan(df)
    assert "SortMergeJoin(skew=true)" in plan


def test_skew_does_not_change_the_result(spark, data_dir, tmp_path, small_limits):
    t = skewed_tables(spark, data_dir, str(tmp_path))
    want = t.base("lineitem").toPandas().merge(t.base("part").toPandas(), left_on="l_partkey", right_on="p_partkey")
    got = t.length_freq.groupBy("area_id").agg(F.count("*").alias("n"), F.sum("length").alias("s")).toPandas()
    assert got.n.sum() == len(want)
    by_size = want.groupby("p_size").l_quantity.sum()
    assert {int(r.area_id): r.s for r in got.itertuples()} == by_size.to_dict()


def test_salting_spreads_the_hot_key(spark, small_limits):
    big = spark.range(20000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.col("id").cast("string")).alias("k"), "id")
    small = big.groupBy("k").agg(F.max("id").alias("m"))
    joined = salted_join(big, small, ["k"], "inner").withColumn("p", F.spark_partition_id())
    sizes = [r["count"] for r in joined.groupBy("p").count().collect()]
    assert sum(sizes) == 20000 and max(sizes) < 20000 * 0.5


def test_quantiles_under_forced_shuffle_joins(spark, small_limits):
    df = spark.range(30000).select(F.when(F.col("id") % 3 < 2, "hot").otherwise("cold").alias("k"), ((F.col("id") * 7919) % 30011).alias("v"))
    got = {(r.k, r.prob): r.q for r in exact_quantiles(df, ["k"], "v", [0.1, 0.5], bucket_rows=256).collect()}
    want = df.groupBy("k").agg(F.expr("percentile(v, array(0.1, 0.5))").alias("p")).collect()
    assert got == {(r.k, p): q for r in want for p, q in zip([0.1, 0.5], r.p)}


def test_hot_haul_is_one_row_before_the_join(spark, small_limits):
    hauls = spark.range(100).select(F.col("id").alias("haul"), (F.col("id") * 10.0 + 1).alias("depth"), F.lit("a").alias("geo"))
    catch = spark.range(50000).select(F.when(F.col("id") % 2 == 0, 5).otherwise(F.col("id") % 100).alias("haul"), F.lit(1.0).alias("weight_kg"))
    df = dp.depth_profile_hauls(hauls, catch)
    plan = df._jdf.queryExecution().executedPlan().toString()
    join = plan.index("LeftOuter")
    assert "partial_sum" in plan[join:]  # the catch is summed below the join
    # Hauls 5 (25,500 rows), 7 and 9 (500 each) caught 1 kg per row, hauls 6 and 8 nothing.
    assert {r.bin: r.mean_cpue for r in df.collect()}[50] == pytest.approx(26500 / 26502)


def test_index_reads_three_columns(spark, data_dir):
    df = ix.trawl_index(Tables(spark, data_dir).gap_area, S9, ["species"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_partkey:bigint,l_extendedprice:double,l_shipdate:timestamp_ntz>" in plan
