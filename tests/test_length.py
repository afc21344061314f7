import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalmark.operators import depth as dp
from shoalmark.operators import length as ln
from shoalmark.sources import lookups as lk


@pytest.fixture(scope="module")
def lengths(spark):
    rng = np.random.default_rng(3)
    rows = [
        (["F", "O"][int(rng.integers(2))], int(2000 + rng.integers(3)), float(rng.integers(10, 40)), int(rng.integers(0, 5)))
        for _ in range(600)
    ]
    rows += [("F", 2000, 12.0, None)]
    return spark.createDataFrame(rows, "survey string, year int, length double, freq int")


def fish(df):
    p = df.toPandas().dropna(subset=["freq"])
    return p.loc[p.index.repeat(p.freq.astype(int))]


def test_weighted_statistics_equal_expanded(lengths):
    whole = fish(lengths)
    got = {(r.survey, r.year): (r.total, r["mean"]) for r in ln.weighted_mean(lengths, ["survey", "year"]).collect()}
    for key, g in whole.groupby(["survey", "year"]):
        assert got[key] == (len(g), pytest.approx(g.length.mean()))
    expanded = ln.expand_by_frequency(lengths, "freq")
    assert expanded.count() == len(whole)


def test_composition_attaches_group_mean(lengths):
    comp = ln.length_comp_by_year(lengths, ["survey"]).toPandas()
    whole = fish(lengths)
    for key, g in comp.groupby(["survey", "year"]):
        w = whole[(whole.survey == key[0]) & (whole.year == key[1])]
        assert g.freq.sum() == len(w) == g.total.iloc[0]
        assert g["mean"].iloc[0] == pytest.approx(w.length.mean())


def test_strict_composition_is_missing_where_a_frequency_is(lengths):
    rows = ln.length_comp(lengths, ["survey", "year"], strict=True).where("survey = 'F' and year = 2000").collect()
    assert {r["mean"] for r in rows} == {None}
    assert {r.length for r in rows if r.freq is None} == {12.0}


def test_density_sums_to_one(lengths):
    out = ln.length_density(ln.length_comp_by_year(lengths, ["survey"]), ["survey", "year"], 2.0, 12, 38).toPandas()
    for _, g in out.groupby(["survey", "year"]):
        assert (g.density * 2.0).sum() == pytest.approx(1.0)


def test_box_stats_equal_numpy_on_expanded_rows(lengths):
    skewed = lengths.unionByName(lengths.sparkSession.createDataFrame([("F", 2000, 500.0, 3)], lengths.schema))
    whole = fish(skewed)
    for r in ln.box_stats(skewed, ["survey"], "length", "freq").collect():
        x = whole[whole.survey == r.survey].length.to_numpy()
        q1, q2, q3 = np.quantile(x, [0.25, 0.5, 0.75])
        keep = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
        assert (r.n, r.q1, r.median, r.q3) == (len(x), q1, q2, q3)
        assert (r.whisker_low, r.whisker_high, r.outliers) == (keep.min(), keep.max(), len(x) - len(keep))


def test_known_bad_cell_is_blanked(spark):
    df = spark.createDataFrame([(2017, 38, 29.0, 5.0), (2017, 38, 30.0, 5.0), (None, 38, 29.0, 5.0)], "year int, area int, length double, rpn double")
    out = ln.null_outliers(df, [{"year": 2017, "area": 38, "length": 29.0}], "rpn").collect()
    assert [r.rpn for r in out] == [None, 5.0, 5.0]


def test_fishery_filters_and_grains(spark):
    rows = [
        (1, 610, 2000, 20.0, 2),
        (1, 610, 2001, 20.0, 3),
        (8, 650, 2000, 30.0, 4),
        (8, 649, 2000, 30.0, 100),  # excluded area
        (2, 620, 2000, 30.0, 100),  # other gear
        (1, 651, 2000, 30.0, 100),  # outside
        (1, 609, 2000, 30.0, 100),
    ]
    df = spark.createDataFrame(rows, "gear int, nmfs_area int, year int, length double, frequency int")
    got = {(r.grain, r.gear, r.year, r.freq, r.total) for r in ln.fishery_length_comp(ln.fishery_lengths(df)).collect()}
    assert got == {
        ("gear_year", "Trawl", 2000, 2, 2),
        ("gear_year", "Trawl", 2001, 3, 3),
        ("gear_year", "Longline", 2000, 4, 4),
        ("gear", "Trawl", None, 5, 5),
        ("gear", "Longline", None, 4, 4),
    }


def test_depth_lengths_of_both_surveys(spark):
    lls = spark.createDataFrame(
        [
            (2000, 3, "201-300m", "Western Gulf of Alaska", 20.0, 2),
            (2000, 1, "0-100m", "Western Gulf of Alaska", 20.0, 2),
            (2000, 3, "201-300m", "Aleutians", 20.0, 2),
            (2000, 3, "201-300m", None, 20.0, 2),
            (2000, 9, "1201m +", "West Yakutat", 20.0, 2),
        ],
        "year int, stratum int, stratum_description string, council_sablefish_mgmt_area string, length double, frequency int",
    )
    out = ln.longline_depth_lengths(lls, lk.LONGLINE_AREAS).collect()
    assert {(r.region, r.strat) for r in out} == {("WGOA", "201-300m"), ("EGOA", "1201m +")}
    bts = spark.createDataFrame(
        [
            (2000, "CENTRAL GOA - INPFC", 0.0, 150.0, 255, 1),
            (2000, "SOMEWHERE", None, 1500.0, 255, 1),
            (2000, "WESTERN GOA - NMFS", 99.0, 500.0, 250, 3),
        ],
        "year int, regulatory_area string, depth_gear_m double, depth_m double, length_mm int, frequency int",
    )
    rows = {(r.region, r.strat): r.length for r in ln.trawl_depth_lengths(bts).collect()}
    assert rows == {("CGOA", "101-200m"): 25.5, ("EGOA", ">1000m"): 25.5, ("WGOA", "1-100m"): 25.0}
    both = ln.longline_depth_lengths(lls, lk.LONGLINE_AREAS).unionByName(ln.trawl_depth_lengths(bts))
    got = {(r.strat, r.region): (r.n, r.mean_length) for r in ln.length_by_depth(both).collect()}
    assert got[("1-100m", "WGOA")] == (3, 25.0)


def test_hauls_without_catch_count_as_zero(spark):
    hauls = spark.createDataFrame([(1, 30.0, "a"), (2, 40.0, "a"), (3, 60.0, "a"), (4, 2000.0, "a")], "haul long, depth double, geo string")
    catch = spark.createDataFrame([(1, 6.0), (1, None), (3, 8.0)], "haul long, weight_kg double")
    got = {r.bin: (r.mean_cpue, r.scaled) for r in dp.depth_profile_hauls(hauls, catch).collect()}
    # haul 1 has two catch rows (6 and none), haul 2 none: (6 + 0 + 0) / 3
    assert got == {0: (2.0, 0.25), 50: (8.0, 1.0), None: (0.0, 0.0)}


def test_hook_cpue(spark):
    sets = spark.createDataFrame([("a", 10.0, 5, 8.0), ("a", 20.0, 0, None), ("a", 30.0, 6, 9.0)], "region string, depth double, ineffective int, catch_freq double")
    assert sorted(r.cpue for r in dp.hook_cpue(sets).collect()) == [0.0, 0.2]
    assert [(r.bin, r.mean_cpue, r.scaled) for r in dp.depth_profile_sets(sets).collect()] == [(0, 0.1, 1.0)]
