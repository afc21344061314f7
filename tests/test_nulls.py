"""One small test per rule on missing values, rounding and alignment."""

import pytest
from pyspark.sql import functions as F

from shoalmark.functions import nulls as nl
from shoalmark.functions.bins import right_closed_bin, threshold_label, unit_bin
from shoalmark.functions.text import estimate_with_cv, one_decimal
from shoalmark.operators import catch as ct
from shoalmark.operators import index as ix
from shoalmark.operators import length as ln
from shoalmark.sources import lookups as lk


def one(df, c):
    """The single value of an expression over a DataFrame."""
    rows = df.select(c.alias("v")).collect()
    assert len(rows) == 1
    return rows[0].v


@pytest.fixture(scope="module")
def xs(spark):
    return spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 4.0), ("c", None)], "k string, x double")


def by_key(df, c):
    return {r.k: r.v for r in df.groupBy("k").agg(c.alias("v")).collect()}


def test_sum_of_only_missing_is_zero(xs):
    assert by_key(xs, nl.sum_or_zero("x")) == {"a": 1.0, "b": 6.0, "c": 0.0}


def test_strict_sum_and_mean_are_missing_with_any_missing(xs):
    assert by_key(xs, nl.strict_sum("x")) == {"a": None, "b": 6.0, "c": None}
    assert by_key(xs, nl.strict_mean("x")) == {"a": None, "b": 3.0, "c": None}


def test_undefined_division_is_null(spark):
    df = spark.range(1)
    for a, b in ((0.0, 0.0), (1.0, 0.0), (None, 1.0)):
        assert one(df, nl.ratio(F.lit(a), F.lit(b))) is None
    assert one(df, nl.ratio(F.lit(3), F.lit(2))) == 1.5


def test_nan_and_infinity_are_missing(spark):
    for v in (float("nan"), float("inf"), float("-inf")):
        assert one(spark.range(1), nl.finite(F.lit(v))) is None
    assert one(spark.range(1), nl.finite(F.lit(2.5))) == 2.5


def test_not_in_keeps_missing_and_not_equal_drops_it(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "s string")
    assert {r.s for r in df.where(nl.not_in("s", ["a"])).collect()} == {"b", None}
    assert {r.s for r in df.where(F.col("s") != "a").collect()} == {"b"}


def test_ifelse_with_missing_condition_is_missing(spark):
    df = spark.createDataFrame([(1,), (3,), (None,)], "x int")
    got = [r.v for r in df.select(nl.ifelse(F.col("x") > 2, F.lit("y"), F.lit("n")).alias("v")).collect()]
    assert got == ["n", "y", None]


def test_missing_keys_match_null_safely(spark):
    a = spark.createDataFrame([(None, 1)], "k string, x int")
    b = spark.createDataFrame([(None, 2)], "k string, y int").withColumnRenamed("k", "k2")
    assert a.join(b, nl.same_key(F.col("k"), F.col("k2"))).count() == 1
    assert a.join(b, F.col("k") == F.col("k2")).count() == 0


@pytest.mark.parametrize("v,d,want", [(2.5, 0, 2.0), (3.5, 0, 4.0), (-2.5, 0, -2.0), (0.125, 2, 0.12), (None, 0, None)])
def test_rounding_is_half_even(spark, v, d, want):
    assert one(spark.range(1), nl.half_even(F.lit(v).cast("double"), d)) == want


@pytest.mark.parametrize(
    "d,want", [(0.0, None), (-1.0, None), (0.5, 0), (50.0, 0), (50.1, 50), (100.0, 50), (1100.0, 1050), (1100.1, None), (None, None)]
)
def test_bins_are_closed_on_the_right(spark, d, want):
    assert one(spark.range(1), right_closed_bin(F.lit(d).cast("double"))) == want


@pytest.mark.parametrize("x,w,want", [(12.0, 1.0, 12.0), (12.5, 1.0, 12.0), (12.6, 1.0, 13.0), (10.0, 4.0, 8.0), (10.1, 4.0, 12.0)])
def test_unit_bins(spark, x, w, want):
    assert one(spark.range(1), unit_bin(F.lit(x), w)) == want


def test_depth_classes_cover_both_ends(spark):
    df = spark.createDataFrame([(50.0,), (100.9,), (101.0,), (1000.9,), (1001.0,), (None,)], "d double")
    label = threshold_label("d", lk.DEPTH_CLASSES, lk.DEEPEST_CLASS)
    got = [r.v for r in df.select(label.alias("v")).collect()]
    assert got == ["1-100m", "1-100m", "101-200m", "801-1000m", ">1000m", None]
    assert set(got) - {None} <= set(lk.DEPTH_ORDER)


def test_frequency_zero_or_missing_expands_to_nothing(spark):
    df = spark.createDataFrame([("a", 0), ("b", 3), ("c", None), ("d", 10_000)], "k string, n int")
    got = {r.k: r["count"] for r in ln.expand_by_frequency(df, "n").groupBy("k").count().collect()}
    assert got == {"b": 3, "d": 10_000}


def test_cv_floor_keeps_missing(spark):
    df = spark.createDataFrame([(0.1,), (0.3,), (None,)], "cv double")
    assert [r.cv for r in ix.cv_floor(df, 0.15).collect()] == [0.15, 0.3, None]


def test_variance_imputation_order(spark):
    rows = [(10.0, None), (10.0, 0.0), (0.0, 0.0), (None, 0.0), (None, None), (10.0, 4.0)]
    df = spark.createDataFrame(rows, "biomass_mt double, biomass_var double")
    assert [r.biomass_var for r in ix.impute_variance(df).collect()] == [25.0, 25.0, 0.0, None, None, 4.0]


def test_clean_cv(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, None), (None, None), (0.0, None), (1.0, 0.2)], "biomass double, cv double")
    assert [r.cv for r in ix.clean_cv(df).collect()] == [0.5, 0.5, None, 0.5, 0.2]


def test_fallback_for_missing_or_zero(spark):
    df = spark.createDataFrame([(None, 7.0), (0.0, 7.0), (3.0, 7.0), (0.0, None)], "a double, b double")
    assert [r.v for r in df.select(nl.first_present("a", "b").alias("v")).collect()] == [7.0, 7.0, 3.0, None]


def test_year_text_that_is_no_number_is_missing(spark):
    df = spark.createDataFrame([("1999", "WG", "D", "HAL", "x", 1.0), ("n/a", "XX", None, None, "x", 1.0)],
                               "year string, fmp_subarea string, retained_or_discarded string, agency_gear_code string, "
                               "trip_target_name string, weight_posted double")
    got = ct.tidy_catch(df, lk.CATCH_AREAS, "EGOA").collect()
    assert [(r.year, r.area, r.retention) for r in got] == [(1999, "WGOA", "Discarded"), (None, "EGOA", None)]


def test_recode_defaults(spark):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "s string")
    m = {"a": "A"}

    def values(c):
        return [r.v for r in df.select(c.alias("v")).collect()]

    assert values(lk.recode("s", m)) == ["A", None, None]
    assert values(lk.recode("s", m, "other")) == ["A", "other", None]
    assert values(lk.recode("s", m, "other", missing_is_other=True)) == ["A", "other", "other"]
    assert values(lk.recode("s", m, F.col("s"))) == ["A", "z", None]


def test_unknown_categories_sort_last_and_survive(spark):
    df = spark.createDataFrame([("b",), ("x",), (None,)], "s string")
    assert [r.v for r in df.select(lk.category_rank("s", ["a", "b"]).alias("v")).collect()] == [2, 3, None]


@pytest.mark.parametrize(
    "b,cv,want",
    [
        (5940.672835, 0.2499101, "5,941 (0.250)"),
        (999.4, 0.1, "999 (0.100)"),
        (1234567.5, 0.12345, "1,234,568 (0.123)"),
        (100000.0, 0.0, "100,000 (0.000)"),
        (2.5, None, "2 (NA)"),
        (None, 0.5, None),
    ],
)
def test_estimate_text(spark, b, cv, want):
    assert one(spark.range(1), estimate_with_cv(F.lit(b).cast("double"), F.lit(cv).cast("double"))) == want


def test_label_text(spark):
    assert one(spark.range(1), one_decimal(F.lit(-3.25), "Median RE=", "%")) == "Median RE=-3.2%"


def test_stacking_aligns_by_name(spark):
    a = spark.createDataFrame([(1999, 1.0)], "year int, biomass double")
    b = spark.createDataFrame([(2.0, 2001)], "biomass double, year int")
    got = {(r.year, r.biomass) for r in ix.splice_redesign(a, b, 2000).collect()}
    assert got == {(1999, 1.0), (2001, 2.0)}


def test_schemes_are_disjoint_and_complete():
    for scheme, n in ((lk.NINE_STRATA, 9), (lk.SIX_STRATA, 6)):
        codes = scheme.codes()
        assert len(scheme.strata) == n and len({c for c, _, _ in codes}) == len(codes)
    assert dict((c, s) for c, _, s in lk.NINE_STRATA.codes())[13] == "WGOA_0_500"
    assert 14 not in {c for c, _, _ in lk.NINE_STRATA.codes()}
    assert dict((c, s) for c, _, s in lk.SIX_STRATA.codes())[14] == "WGOA_0_700"
    with pytest.raises(ValueError):
        lk.StrataScheme("x", (("A", "A1", 1, 5), ("A", "A2", 5, 6))).codes()
