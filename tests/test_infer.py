import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalmark.operators import infer as nf
from shoalmark.plans.standins import Tables


def kalman(y, r, s2):
    """Plain random-walk filter and smoother with a diffuse start."""
    x, p, ll, hist = None, None, 0.0, []
    for yt, rt in zip(y, r):
        if x is not None:
            p = p + s2
        if yt is not None:
            if x is None:
                x, p = yt, rt
            else:
                f = p + rt
                ll -= 0.5 * (math.log(2 * math.pi * f) + (yt - x) ** 2 / f)
                x, p = x + p / f * (yt - x), p * (1 - p / f)
        hist.append((x, p))
    out = [hist[-1]]
    for x, p in reversed(hist[:-1]):
        nx, np_ = out[-1]
        if x is None:
            out.append((nx, np_ + s2))
        else:
            j = p / (p + s2)
            out.append((x + j * (nx - x), p + j * j * (np_ - p - s2)))
    return out[::-1], ll


def test_smoother_equals_plain_loop(spark):
    rng = np.random.default_rng(5)
    rows, series = [], {}
    for s in ("A", "B", "C"):
        y, r = [], []
        for t in range(1990, 2006):
            seen = rng.random() < 0.6 and not (s == "C" and t < 1995)
            v, cv = float(np.exp(rng.normal(8, 0.5))), float(rng.uniform(0.1, 0.5))
            if seen:
                rows.append((s, t, v, cv))
            y.append(math.log(v) if seen else None)
            r.append(math.log(1 + cv * cv))
        series[s] = (y + [None] * 2, r + [0.1] * 2)
    df = spark.createDataFrame(rows, "strata string, year int, biomass double, cv double")
    groups = {"A": "g1", "B": "g1", "C": "g2"}
    out = nf.smooth_index(df, 1990, 2007, groups).toPandas()
    for g, members in (("g1", "AB"), ("g2", "C")):
        best = max(nf.pe_grid(), key=lambda s: sum(kalman(*series[m], math.exp(2 * s))[1] for m in members))
        for m in members:
            path, _ = kalman(*series[m], math.exp(2 * best))
            got = out[out.strata == m].sort_values("year")
            assert got.ln_pe.unique() == pytest.approx([best])
            assert list(got.pred) == pytest.approx([math.exp(x) for x, _ in path], rel=1e-10)
            assert list(got.se) == pytest.approx([math.sqrt(p) for _, p in path], rel=1e-9)
            assert (got.pred_lci < got.pred).all() and (got.pred < got.pred_uci).all()


def test_smoother_edges(spark):
    one = spark.createDataFrame([("A", 2000, 5.0, 0.2), ("B", 2000, None, None), ("B", 2001, 0.0, 0.1)], "strata string, year int, biomass double, cv double")
    out = {(r.strata, r.year): r for r in nf.smooth_index(one, 1999, 2001).collect()}
    assert out[("A", 2000)].pred == pytest.approx(5.0) and out[("A", 1999)].se > out[("A", 2000)].se
    assert out[("A", 2000)].ln_pe == -4.0  # nothing to choose by: the smaller one
    assert out[("B", 2000)].pred is None
    twice = spark.createDataFrame([("A", 2000, 5.0, 0.2)] * 2, one.schema)
    with pytest.raises(Exception, match="repeated year"):
        nf.smooth_index(twice, 1999, 2001).collect()


def test_correlation_and_covariance_equal_pandas(spark):
    rng = np.random.default_rng(2)
    data = {s: np.exp(rng.normal(size=12)) for s in "abc"}
    rows = [(s, 2000 + i, float(v)) for s, vs in data.items() for i, v in enumerate(vs) if not (s == "b" and i == 3)]
    df = spark.createDataFrame(rows, "strata string, year int, pred double")
    wide = df.toPandas().pivot(index="year", columns="strata", values="pred")
    got = {(r.strata_a, r.strata_b): r["corr"] for r in nf.strata_correlation(df, list("abc")).collect()}
    assert len(got) == 6
    cov = {(r.strata_a, r.strata_b): r.covar_samp for r in nf.log_covariance(df, list("abc")).collect()}
    for (a, b), v in got.items():
        assert v == pytest.approx(wide.corr().loc[a, b])
        assert cov[(a, b)] == pytest.approx(np.log(wide).cov().loc[a, b])


def test_peels_and_projections(spark):
    df = spark.createDataFrame([(y, float(y)) for y in range(2015, 2022)], "year int, v double")
    peeled = nf.retrospective_peels(df, [2017, 2020])
    assert {r.peel: r["count"] for r in peeled.groupBy("peel").count().collect()} == {2017: 3, 2020: 6}
    pred = spark.createDataFrame([(p, y, 1.0) for p in (2017, 2020) for y in range(2015, 2024)], "peel int, year int, pred double")
    got = {(r.peel, r.year) for r in nf.peel_projections(pred).collect()}
    assert got == {(2017, 2018), (2020, 2021), (2020, 2022)}


def test_scenarios_select_years_floor_and_groups(spark):
    data = spark.createDataFrame(
        [("d3", y, s, 0.1) for y in (1990, 1993, 1996) for s in ("WGOA_a", "CGOA_a")] + [("d2", 1990, "WGOA_b", None)],
        "dataset string, year int, strata string, cv double",
    )
    scen = [
        nf.Scenario("base", "d3", 1990, 1996),
        nf.Scenario("drop", "d3", 1992, 1996, (1996,), 0.15, {"WGOA_a": "w"}, {"CGOA_a": "q"}),
        nf.Scenario("other", "d2", 1980, 2000, (), 0.2),
    ]
    out = nf.scenario_fanout(data, scen, {"WGOA_a": "WGOA", "CGOA_a": "CGOA", "WGOA_b": "WGOA"}).toPandas()
    assert out.groupby("scenario").size().to_dict() == {"base": 6, "drop": 2, "other": 1}
    drop = out[out.scenario == "drop"].set_index("strata")
    assert drop.cv.tolist() == [0.15, 0.15] and set(drop.year) == {1993}
    assert drop.pe_group.to_dict() == {"WGOA_a": "w", "CGOA_a": "all"} and drop.q_group.to_dict() == {"WGOA_a": "WGOA", "CGOA_a": "q"}
    assert out[out.scenario == "other"].cv.isna().all()


def test_relative_error_with_one_dominant_parameter(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", i, float(v)) for i, v in enumerate(rng.normal(2, 0.1, 3000))] + [("b", 0, 1.0), ("b", 1, None), ("c", 0, None)]
    rec = spark.createDataFrame(rows, "parameter string, replicate int, estimate double")
    true = spark.createDataFrame([("hot", 2.0), ("b", 4.0), ("c", 1.0)], "parameter string, model double")
    out = nf.relative_error(true, rec).toPandas()
    assert len(out) == len(rows)
    hot = out[out.parameter == "hot"]
    re = (2.0 - hot.estimate) / 2.0 * 100
    assert hot.re.to_numpy() == pytest.approx(re.to_numpy()) and hot.median_re.iloc[0] == pytest.approx(np.median(re))
    b = out[out.parameter == "b"].iloc[0]
    assert b.share_missing == 0.5 and b.median_re == 75.0 and b.label == "Median RE=75.0%"
    c = out[out.parameter == "c"].iloc[0]
    assert c.share_missing == 1.0 and c.label is None


@pytest.fixture(scope="module")
def draws(spark):
    rng = np.random.default_rng(9)
    rows = [(s, i, float(rng.normal(m)), float(rng.normal(0, 2))) for s, m in (("la", 0.0), ("mcmc", 0.2)) for i in range(300)]
    return spark.createDataFrame(rows, "sampler string, draw_id long, V1 double, V2 double")


def test_chains(draws):
    got = nf.chain_index(draws, 3, ["sampler"]).groupBy("chain").agg(F.min("iter"), F.max("iter"), F.count("*"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, 100, 200), (2, 1, 100, 200), (3, 1, 100, 200)]


def test_draws_are_numbered_within_each_event_type(spark, data_dir):
    t = Tables(spark, data_dir)
    events = t.base("events").select("event_type", "event_id", "value").toPandas().sort_values("event_id")
    got = t.draws.toPandas()
    assert set(got.sampler) == set(events.event_type) and len(got) == len(events)
    for sampler, g in got.groupby("sampler"):
        g = g.sort_values("draw_id")
        assert g.draw_id.tolist() == list(range(len(g)))
        assert g.V2.to_numpy() == pytest.approx((events[events.event_type == sampler].value / 100).to_numpy())


def test_unnumbered_values_change_no_chain_and_no_summary(draws):
    values, names = draws.drop("draw_id"), {"V1": "log_PE", "V2": "log_q"}
    chained = [sorted(map(tuple, nf.chain_index(draws, 3, ["sampler"], values=v).collect())) for v in (None, values)]
    summed = [sorted(map(tuple, nf.posterior_summary(draws, names, values=v).collect())) for v in (None, values)]
    assert chained[0] == chained[1] and len(summed[0]) == 4
    for a, b in zip(*summed):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:])


def test_qq_and_summary(spark, draws):
    names = {"V1": "log_PE", "V2": "log_q"}
    p = draws.toPandas()
    qq = nf.posterior_qq(draws, names, ("la", "mcmc")).toPandas()
    assert len(qq) == 2 * 101
    r = qq[(qq.parameter == "log_PE") & (qq.quant == 0.37)].iloc[0]
    assert r.a == pytest.approx(np.quantile(p[p.sampler == "la"].V1, 0.37))
    assert r.b == pytest.approx(np.quantile(p[p.sampler == "mcmc"].V1, 0.37))
    point = spark.createDataFrame([("log_PE", -1.0, 0.5)], "parameter string, est double, sd double")
    out = nf.posterior_summary(draws, names, point).toPandas()
    assert len(out) == 5
    fit = out[out.sampler == "point fit"].iloc[0]
    assert (fit["median"], fit.lower, fit.upper) == (-1.0, pytest.approx(-1.98), pytest.approx(-0.02)) and math.isnan(fit.rhat)
    x = p[p.sampler == "mcmc"].sort_values("draw_id").V2.to_numpy().reshape(6, 50)
    w, b = x.var(axis=1, ddof=1).mean(), 50 * x.mean(axis=1).var(ddof=1)
    want = math.sqrt((49 / 50 * w + b / 50) / w)
    got = out[(out.sampler == "mcmc") & (out.parameter == "log_q")].iloc[0]
    assert got.rhat == pytest.approx(want)


def test_ratio_imputation(spark):
    df = spark.createDataFrame(
        [(1, "s", 10.0), (1, "m", 5.0), (2, "s", 20.0), (2, "m", None), (3, "s", None), (3, "m", None), (4, "s", 10.0), (4, "m", 1.0)],
        "year int, strata string, biomass double",
    )
    got = {(r.year, r.strata): r.biomass for r in nf.impute_stratum_ratio(df, {"m": "s"}).collect()}
    assert got[(2, "m")] == pytest.approx(0.3 * 20) and got[(3, "m")] is None


def test_smoother_keeps_series_with_a_missing_key(spark):
    df = spark.createDataFrame(
        [(None, "A", 2000, 5.0, 0.2), ("s", "A", 2000, 6.0, 0.2), ("s", "Z", 2000, 7.0, 0.2)],
        "species string, strata string, year int, biomass double, cv double",
    )
    out = nf.smooth_index(df, 2000, 2001, {"A": "g"}, by=["species"]).collect()
    assert {(r.species, r.strata): round(r.pred, 6) for r in out if r.year == 2000} == {(None, "A"): 5.0, ("s", "A"): 6.0, ("s", "Z"): 7.0}


def test_correlation_with_awkward_labels(spark):
    rows = [(s, y, float(v)) for s, vs in (("it's `a`", (1, 2, 4)), ("b (0-500 m)", (2, 4, 9))) for y, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "strata string, year int, pred double")
    got = {(r.strata_a, r.strata_b): r["corr"] for r in nf.strata_correlation(df, ["it's `a`", "b (0-500 m)"]).collect()}
    assert got[("it's `a`", "b (0-500 m)")] == pytest.approx(np.corrcoef([1, 2, 4], [2, 4, 9])[0, 1])


def test_correlation_of_many_strata_in_blocks(spark):
    rnd = random.Random(8)
    strata = [f"s{i}" for i in range(500)]
    rows = [(k, y, s, None if rnd.random() < 0.05 else rnd.gauss(0, 1)) for k in ("a", None) for y in range(12) for s in strata if rnd.random() > 0.1]
    rows += [("a", 99, "unlisted", 1.0), ("a", 0, "unlisted", 2.0), ("a", 0, "unlisted", 3.0)]
    df = spark.createDataFrame(rows, "model string, year int, strata string, pred double")
    got = {(r.model, r.strata_a, r.strata_b): r.corr for r in nf.strata_correlation(df, strata, by=["model"]).collect()}
    assert len(got) == 2 * 500 * 501 // 2
    series = {}
    for k, y, s, v in rows:
        if v is not None:
            series.setdefault((k, s), {})[y] = v
    for (k, a, b), c in rnd.sample(sorted(got.items(), key=str), 3000):
        x, y = series.get((k, a), {}), series.get((k, b), {})
        years = sorted(x.keys() & y.keys())
        u, v = [x[t] for t in years], [y[t] for t in years]
        if len(years) < 2:
            assert c is None
            continue
        mu, mv = sum(u) / len(u), sum(v) / len(v)
        sxy, sxx, syy = (sum((p - m) * (q - n) for p, q in zip(g, h)) for g, h, m, n in ((u, v, mu, mv), (u, u, mu, mu), (v, v, mv, mv)))
        assert c == pytest.approx(sxy / (sxx * syy) ** 0.5, abs=1e-9)
    twice = df.unionByName(df.where("strata = 's3' AND year = 5"))
    with pytest.raises(Exception, match="more than one row"):
        nf.strata_correlation(twice, strata, by=["model"]).collect()


def test_newton_equals_a_fine_grid(spark):
    rnd = random.Random(12)
    series = {}
    for model, scale in (("rough", 0.4), ("calm", 0.02), ("short", 0.1)):
        for stratum in ("a", "b", "c"):
            x, out = 5.0, []
            for year in range(1990, 2002 if model != "short" else 1992):
                x += rnd.gauss(0, scale)
                out.append((year, None if rnd.random() < 0.25 else x + rnd.gauss(0, 0.1)))
            series[model, stratum] = out
    rows = [(m, s, y, None if v is None else math.exp(v), 0.1) for (m, s), vs in series.items() for y, v in vs] + [("empty", "a", 1995, None, 0.1)]
    df = spark.createDataFrame(rows, "model string, strata string, year int, biomass double, cv double")
    out = nf.smooth_index(df, 1990, 2003, grid=[i / 4 - 4 for i in range(17)], by=["model"], newton=12)
    got = {r.model: (r.ln_pe, r.loglik) for r in out.select("model", "ln_pe", "loglik").distinct().collect()}
    r2 = math.log(1 + 0.01)
    for model in ("rough", "calm", "short"):
        def total(s):
            years = range(1990, 2004)
            ys = [[dict(vs).get(t) for t in years] for (m, _), vs in series.items() if m == model]
            return sum(kalman(y, [r2] * len(years), math.exp(2 * s))[-1] for y in ys)

        tried = [-4 + i / 500 for i in range(2001)]
        best = max(tried, key=total)
        assert got[model][1] == pytest.approx(total(got[model][0]), abs=1e-9) and got[model][1] >= total(best) - 1e-9
        assert abs(got[model][0] - best) <= 0.003 or abs(total(got[model][0]) - total(best)) < 1e-7
    assert got["empty"][1] == 0.0
