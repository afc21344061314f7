"""Index building on small hand-made surveys."""

import math

import pytest
from pyspark.sql import functions as F

from shoalmark.operators import grid
from shoalmark.operators import index as ix
from shoalmark.plans.cycle import flagship, model_inputs
from shoalmark.sources import lookups as lk


@pytest.fixture(scope="module")
def biom(spark):
    rows = [
        (1990, 10, 100.0, 400.0, 5),
        (1990, 11, 50.0, None, 3),  # variance (0.5 * 50)^2
        (1990, 20, 0.0, 0.0, 2),  # no catch: CV undefined, set to the default
        (1990, 40, 30.0, 9.0, 2),
        (1990, 999, 1e6, 1.0, 1),  # unmapped
        (1993, 10, 80.0, 0.0, 4),  # zero variance (0.5 * 80)^2
        (1993, 410, 8.0, 4.0, 1),
        (1993, 420, None, 4.0, None),
        (1993, 520, 5.0, 1.0, 1),
        (2025, 14, 7.0, 1.0, 1),  # only in the six-stratum scheme
        (2025, 511, 3.0, 1.0, 1),
    ]
    return spark.createDataFrame(rows, "year int, area_id int, biomass_mt double, biomass_var double, n_haul int")


def cells(df, *cols):
    return {(r.year, r.strata): tuple(r[c] for c in cols) for r in df.collect()}


def test_trawl_index_nine_strata(biom):
    got = cells(ix.trawl_index(biom, lk.NINE_STRATA), "n", "biomass", "cv")
    assert len(got) == 2 * 9  # 2025 has no code of this scheme
    n, b, cv = got[(1990, "WGOA_0_500")]
    assert (n, b) == (8, 150.0) and cv == pytest.approx(math.sqrt(400 + 625) / 150)
    assert got[(1990, "CGOA_0_500")] == (2, 0.0, 0.5)
    assert got[(1993, "WGOA_0_500")] == (4, 80.0, 0.5)
    assert got[(1993, "CGOA_501_700")] == (None, 0.0, 0.5)  # rows exist, all missing: sum is 0
    assert got[(1990, "WGOA_501_700")] == (None, None, None)


def test_trawl_index_six_strata_covers_redesigned_codes(biom):
    got = cells(ix.trawl_index(biom, lk.SIX_STRATA), "biomass")
    assert len(got) == 3 * 6
    assert got[(2025, "WGOA_0_700")] == (7.0,) and got[(2025, "WGOA_701_1000")] == (3.0,)
    assert got[(1993, "WGOA_0_700")] == (88.0,)


def test_by_key_gives_each_stock_its_own_grid(biom):
    two = biom.withColumn("species", F.lit("x")).unionByName(biom.where("year = 1993").withColumn("species", F.lit("y")))
    out = ix.trawl_index(two, lk.NINE_STRATA, ["species"])
    assert {r.species: r["count"] for r in out.groupBy("species").count().collect()} == {"x": 18, "y": 9}


def test_combine_is_missing_if_a_part_is(spark):
    df = spark.createDataFrame(
        [
            (1990, "WGOA_0_500", 10.0, 0.2),
            (1990, "WGOA_501_700", 5.0, 0.4),
            (1990, "CGOA_0_500", 10.0, 0.2),
            (1990, "CGOA_501_700", None, None),
            (1990, "WGOA_701_1000", 3.0, 0.3),
        ],
        "year int, strata string, biomass double, cv double",
    )
    got = cells(ix.combine_strata(df, lk.MERGE_SHALLOW), "biomass", "cv")
    b, cv = got[(1990, "WGOA_0_700")]
    assert b == 15.0 and cv == pytest.approx(math.sqrt(4 + 4) / 15)
    assert got[(1990, "CGOA_0_700")] == (None, None)
    assert got[(1990, "WGOA_701_1000")] == (3.0, 0.3)


def test_imputation_reference_period_and_condition(spark):
    rows = [
        (1990, "EGOA_0_500", 1.0, 0.1),
        (1990, "EGOA_501_700", None, None),
        (1993, "EGOA_0_500", None, None),
        (1993, "EGOA_501_700", None, None),
        (1996, "EGOA_0_500", 2.0, 0.1),
        (1996, "EGOA_501_700", 4.0, 0.1),
        (2025, "EGOA_0_500", 2.0, 0.1),
        (2025, "EGOA_501_700", 100.0, 0.1),
    ]
    df = spark.createDataFrame(rows, "year int, strata string, biomass double, cv double")
    fills = {"EGOA_501_700": "EGOA_0_500"}
    every = cells(ix.impute_stratum_mean(df, fills), "biomass", "cv")
    assert every[(1990, "EGOA_501_700")] == (52.0, 0.5)
    assert every[(1993, "EGOA_501_700")] == (None, None)  # shallow stratum not surveyed
    early = cells(ix.impute_stratum_mean(df, fills, (1990, 2024)), "biomass", "cv")
    assert early[(1990, "EGOA_501_700")] == (4.0, 0.5)


def test_longline_index(spark):
    rows = [
        (1991, "Western Gulf of Alaska", 9.0, 1.0),
        (1992, "Western Gulf of Alaska", 9.0, 1.0),
        (1992, "Western Gulf of Alaska", None, None),
        (1992, "Bering Sea", 7.0, 1.0),
        (1993, "Bering Sea", 7.0, 1.0),
    ]
    lls = spark.createDataFrame(rows, "year int, council_management_area string, rpw double, rpw_var double")
    got = cells(ix.longline_index(lls, lk.LONGLINE_AREAS), "cpue", "cv")
    # A year that has only unlisted areas keeps its grid rows.
    assert len(got) == 2 * 3
    assert got[(1992, "WGOA")] == (9.0, pytest.approx(1 / 9))
    assert got[(1993, "WGOA")] == (None, None)


def test_depredation_exclusions(spark):
    rows = [
        (1996, "Aleutians", "a", 1.0, 1.0),
        (1997, "Aleutians", "a", 2.0, 1.0),
        (1997, "Aleutians", "NW Aleutians slope", 50.0, 1.0),
        (1997, "Aleutians", None, 4.0, 1.0),
        (1996, "Bering Sea", "b", 8.0, 4.0),
    ]
    lls = spark.createDataFrame(
        rows, "year int, council_sablefish_management_area string, geographic_area_name string, rpw double, rpw_var double"
    )
    got = cells(
        ix.depredation_index(lls, lk.DEPREDATION_AREAS, ["NW Aleutians slope", "SW Aleutians slope"], [(1996, "Aleutians")]),
        "biomass",
        "cv",
    )
    assert len(got) == 2 * 6
    assert got[(1996, "AI")] == (None, None) and got[(1997, "AI")][0] == 6.0
    assert got[(1996, "BS")] == (8.0, 0.25)


def test_fill_years_and_grid_expand(spark):
    df = spark.createDataFrame([(1990, 1.0), (1993, 2.0), (1999, 3.0)], "year int, v double")
    got = {r.year: r.v for r in grid.fill_years(df, 1995).collect()}
    assert got == {1990: 1.0, 1991: None, 1992: None, 1993: 2.0, 1994: None, 1995: None}
    assert grid.fill_years(df, 1980).count() == 0
    long = spark.createDataFrame([(1990, "a"), (1992, "b")], "year int, strata string")
    assert grid.grid_expand(long, 1993).count() == 4 * 2


def test_wide_report_shape(biom):
    out = flagship(biom, lk.NINE_STRATA, 1994)
    rows = {r.year: r for r in out.collect()}
    assert sorted(rows) == [1990, 1991, 1992, 1993, 1994]
    assert rows[1990]["WGOA_0_500"] == "150 (0.213)" and rows[1991]["WGOA_0_500"] is None


def test_model_inputs_bundle(spark, biom):
    lls = spark.createDataFrame(
        [(1992, "Western Gulf of Alaska", 9.0, 1.0)], "year int, council_management_area string, rpw double, rpw_var double"
    )
    tables = model_inputs(biom, lls)
    assert list(tables) == [
        "biomass_dat_3strat",
        "biomass_dat_3strat_impute",
        "biomass_dat_2strat",
        "biomass_dat_2strat_impute",
        "cpue_dat",
        "model_yrs",
    ]
    assert [r.year for r in model_inputs(biom, lls, years=(2023, 2026))["model_yrs"].orderBy("year").collect()] == [2023, 2024, 2025, 2026]
    got = cells(tables["biomass_dat_2strat_impute"], "biomass")
    assert got[(2025, "WGOA_0_700")] == (7.0,)  # raw from the redesign year on
    assert got[(1990, "WGOA_0_700")] == (158.0,)  # 150 + the 501-700 mean of 8
    assert got[(1990, "EGOA_0_700")] == (None,)  # that stratum was never surveyed, so there is no mean


def test_model_inputs_since(spark, biom):
    rows = [(y, "Western Gulf of Alaska", 9.0, 1.0) for y in (1990, 1993, 1995, 1996)]
    lls = spark.createDataFrame(rows, "year int, council_management_area string, rpw double, rpw_var double")
    years = lambda **k: {r.year for r in model_inputs(biom, lls, **k)["cpue_dat"].collect()}
    assert years() == {1993, 1995, 1996} and years(since=1995) == {1996} and years(since=1980) == {1990, 1993, 1995, 1996}


def test_species_ratio(spark):
    df = spark.createDataFrame([(1, "A", 2.0), (1, "B", 4.0), (2, "A", 1.0), (3, "B", 0.0), (3, "A", 1.0)], "year int, species string, v double")
    got = {r.year: (r.a, r.b, r.ratio) for r in ix.species_ratio(df, "A", "B", "v").collect()}
    assert got == {1: (2.0, 4.0, 0.5), 2: (1.0, None, None), 3: (1.0, 0.0, None)}
