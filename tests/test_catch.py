import pytest
from pyspark.sql import functions as F

from shoalmark.operators import catch as ct
from shoalmark.sources import lookups as lk
from shoalmark.sources import writers as wr


@pytest.fixture(scope="module")
def tidy(spark):
    rows = [
        ("2010", "WG", "D", "HAL", "Sablefish", 1.0),
        ("2010", "WG", "R", "HAL", "Sablefish", 2.0),
        ("2010", "CG", "R", "NPT", "Rockfish", 4.0),
        ("2010", "SE", "R", "JIG", "Rockfish", 8.0),
        ("2011", "WG", "R", "PTR", "Rockfish", None),
        ("2011", "WG", "R", "PTR", "Rockfish", 16.0),
        ("2011", "CG", "D", None, "Flatfish", 32.125),
    ]
    raw = spark.createDataFrame(
        rows,
        "year string, fmp_subarea string, retained_or_discarded string, agency_gear_code string, trip_target_name string, "
        "weight_posted double",
    )
    return ct.tidy_catch(raw, lk.CATCH_AREAS, "EGOA")


def test_grains_agree_with_separate_group_bys(tidy):
    out = ct.catch_totals(tidy, None)
    strict = F.when(F.count("weight") == F.count(F.lit(1)), F.sum("weight")).alias("catch")
    for members, grain in ct.GRAINS.items():
        want = {tuple(r) for r in tidy.groupBy(*members).agg(strict).select(*members, "catch").collect()}
        got = {tuple(r) for r in out.where(F.col("grain") == grain).select(*members, "catch").collect()}
        assert got == want, grain
    assert out.where("grain is null").count() == 0


def test_a_missing_weight_makes_its_total_missing(tidy):
    got = {(r.year, r.catch) for r in ct.catch_totals(tidy).where("grain = 'year'").collect()}
    assert got == {(2010, 15.0), (2011, None)}


def test_missing_gear_is_a_group_of_its_own(tidy):
    rows = ct.catch_totals(tidy, None).where("grain = 'gear' and year = 2011").collect()
    assert {(r.gear, r.catch) for r in rows} == {("PTR", None), (None, 32.125)}


def test_gear_groups_drop_other_gears(tidy):
    got = {(r.year, r.gear, r.retention, r.catch) for r in ct.catch_by_gear_group(tidy, lk.GEAR_GROUPS).collect()}
    assert got == {
        (2010, "longline", "Discarded", 1.0),
        (2010, "longline", "Retained", 2.0),
        (2010, "trawl", "Retained", 4.0),
        (2011, "trawl", "Retained", None),
    }


def test_discards(tidy):
    got = {(r.year, r.target, r.catch) for r in ct.discards_by_target(tidy).collect()}
    assert got == {(2010, "Sablefish", 1.0), (2011, "Flatfish", 32.125)}


def test_limits_fan_out_over_retention(spark, tidy):
    specs = spark.createDataFrame(
        [("GOA", 99.0, 2010), ("W", 5.0, 2010), ("C", 6.0, 2010), ("E", 7.0, 2011), ("W", 1.0, 2009)],
        "area_label string, acceptable_biological_catch double, year int",
    )
    limits = ct.area_limits(specs, lk.LIMIT_AREAS, "EGOA", "GOA")
    rows = ct.catch_vs_limit(limits, ct.catch_by_area(tidy)).collect()
    got = {(r.year, r.area, r.abc, r.retention, r.catch) for r in rows}
    assert got == {
        (2010, "WGOA", 5.0, "Discarded", 1.0),
        (2010, "WGOA", 5.0, "Retained", 2.0),
        (2010, "CGOA", 6.0, "Retained", 4.0),
        (2011, "EGOA", 7.0, None, None),
    }


def test_compound_exclusion_keeps_the_rest(spark):
    df = spark.createDataFrame(
        [(2003, 136, "CG", 1.0), (2003, 136, "SE", 2.0), (2003, 5, "CG", 4.0), (2003, 5, None, 8.0), (2002, 5, "CG", 16.0)],
        "year int, cas_code int, fmp_subarea string, tot_catch double",
    )
    out = ct.catch_series(df, [ct.exclude_codes("cas_code", [136], "fmp_subarea", ["CG", "WG"])]).collect()
    assert [(r.year, r.catch) for r in out] == [(2003, 14.0)]


def report(spark):
    biomass = spark.createDataFrame([(2022, 10.0), (2023, 20.0)], "year int, biomass double")
    survey = spark.createDataFrame([(2021, 5.0), (2019, None)], "year int, survey_biomass double")
    catch = spark.createDataFrame([(2023, 7.0), (2022, 6.0)], "year int, catch double")
    limits = spark.createDataFrame([(2024, "OFL", 99.0), (2024, "ABC", 50.0)], "year int, hl string, total double")
    return ct.status_report(biomass, survey, catch, limits, 2024, {"STOCK": "AB1", "TIER": "5"})


def test_status_report_values(spark):
    rows = report(spark).orderBy("ord").collect()
    assert [r.tag for r in rows] == ct.REPORT_TAGS
    got = {r.tag: r.value for r in rows}
    assert got["STOCK"] == "AB1" and got["LAST_DATA_YEAR"] == "2023" and got["BEST_B_ESTIMATE"] == "20"
    assert got["FISHERYYEAR"] == "2022 2023" and got["TOTALBIOMASS"] == "10 20" and got["TOTALCATCH"] == "6 7"
    assert got["BEST_F_ESTIMATE"] == "7" and got["F_LIMIT"] == "99" and got["SURVEY_ESTIMATES"] == "NA 5"
    assert got["SPAWNBIOMASS"] == "NA"


def test_status_report_refuses_two_rows_for_a_year(spark):
    twice = spark.createDataFrame([(2023, 1.0), (2023, 2.0)], "year int, biomass double")
    other = spark.createDataFrame([], "year int, survey_biomass double, catch double, hl string, total double")
    with pytest.raises(Exception, match="more than one row"):
        ct.status_report(twice, other, other, other, 2024).collect()


def test_status_report_refuses_unknown_tags(spark):
    empty = spark.createDataFrame([], "year int, biomass double, survey_biomass double, catch double")
    with pytest.raises(ValueError):
        ct.status_report(empty, empty, empty, empty, 2024, {"STCK": "x"})


def test_tagged_text_keeps_order(spark, tmp_path):
    import glob

    path = wr.sink_tagged_text(report(spark), str(tmp_path / "r"))
    lines = [ln.rstrip("\n") for f in sorted(glob.glob(f"{path}/part-*")) for ln in open(f)]
    assert lines[:4] == ["#STOCK", "AB1", "#STOCK_NAME", "NA"] and len(lines) == 2 * len(ct.REPORT_TAGS) - 3
    assert lines[lines.index("#BIOMASS_ESTIMATES") + 1] == "#B_YEAR"
