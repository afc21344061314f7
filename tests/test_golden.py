"""Published input and output files, where they are at hand.

GOLDEN_INDEX_CSV  long trawl index: year, strata, n, biomass, cv
GOLDEN_WIDE_CSV   the wide report made from it
GOLDEN_CPUE_CSV   long longline index: year, strata, cpue, cv
"""

import csv
import os

import pytest
from pyspark.sql import functions as F

from shoalmark.operators import compare as cp
from shoalmark.operators import index as ix
from shoalmark.operators import infer as nf
from shoalmark.sources.readers import scan_csv


def path(name):
    p = os.environ.get(name)
    if not p:
        pytest.skip(f"{name} is not set")
    return p


@pytest.fixture(scope="module")
def trawl(spark):
    return scan_csv(spark, path("GOLDEN_INDEX_CSV"), "index_csv")


@pytest.fixture(scope="module")
def cpue(spark):
    return scan_csv(spark, path("GOLDEN_CPUE_CSV"), "cpue_csv")


def test_wide_report_cell_by_cell(trawl):
    with open(path("GOLDEN_WIDE_CSV"), newline="") as f:
        want = list(csv.DictReader(f))
    strata = [c for c in want[0] if c != "year"]
    got = {r.year: r for r in ix.index_wide_report(trawl, 2022, strata).collect()}
    n = 0
    for row in want:
        for s in strata:
            assert (got[int(row["year"])][s] or "NA") == row[s], (row["year"], s)
            n += 1
    assert n == 297 and len(got) == len(want)


def test_change_2019_to_2021(trawl, cpue):
    area = cp.area_of("strata", ["CGOA", "EGOA"], "WGOA")
    a = {r.area: r.frac_change for r in cp.stratum_change(trawl, 2019, 2021, "biomass", area).collect()}
    b = {r.area: r.frac_change for r in cp.stratum_change(cpue, 2019, 2021, "cpue", "strata").collect()}
    assert a == pytest.approx({"WGOA": -0.2175128, "CGOA": -0.1376707, "EGOA": -0.0588073}, abs=1e-7)
    assert b == pytest.approx({"WGOA": -0.5644797, "CGOA": -0.1552668, "EGOA": -0.4069043}, abs=1e-7)


def test_stratum_means(trawl):
    mid = trawl.where(F.col("strata").contains("501-700")).groupBy("strata").agg(F.avg("biomass").alias("m"), F.count("biomass").alias("n"))
    got = {r.strata[:4]: (r.m, r.n) for r in mid.collect()}
    assert got["WGOA"] == (pytest.approx(4417.420005, abs=1e-6), 11)
    assert got["CGOA"] == (pytest.approx(6949.753130, abs=1e-6), 11)
    assert got["EGOA"] == (pytest.approx(4589.309875, abs=1e-6), 11)


def test_smoother_anchors(trawl):
    out = nf.smooth_index(trawl, 1990, 2024).toPandas()
    assert len(out) == 9 * 35
    assert out.ln_pe.unique() == pytest.approx([-1.65])
    assert out.loglik.iloc[0] == pytest.approx(-41.675672, abs=1e-6)
    assert out[out.year == 2022].pred.sum() == pytest.approx(81034.811, abs=1e-3)
    at = out.set_index(["strata", "year"])
    for stratum, year, pred, se in (
        ("WGOA (0-500 m)", 1991, 3155.224107, 0.261991),
        ("CGOA (701-1000 m)", 2021, 7156.010003, 0.478784),
        ("EGOA (0-500 m)", 2001, 23984.868253, 0.201684),
        ("CGOA (701-1000 m)", 1990, 3189.307826, 0.594172),
    ):
        assert at.loc[(stratum, year), "pred"] == pytest.approx(pred, abs=1e-5)
        assert at.loc[(stratum, year), "se"] == pytest.approx(se, abs=1e-6)
