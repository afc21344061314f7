"""Simulation, posterior, scenario and retrospective summaries, and the index smoother."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import let
from ..functions.joins import checked_broadcast, lookup, null_safe_join, salted_join
from ..functions.nulls import finite, ratio
from ..functions.ranking import doubles, exact_quantiles, grid_probs
from ..functions.text import one_decimal
from ..sources.lookups import recode

Z95 = 1.959963984540054


#: Strata whose pairs are worked on by one task.
PAIR_BLOCK = 32


def strata_correlation(
    df: DataFrame, strata: Sequence[str], value: str = "pred", by: Sequence[str] = (), stat: str = "corr"
) -> DataFrame:
    """Upper triangle of the correlation (or ``covar_samp``) matrix of the strata's yearly series.

    A group's series become one array per year, in the order of the list, and the matrix is cut into blocks of
    ``PAIR_BLOCK`` strata by as many: a row per pair of blocks holds the two pieces of every year, and all its cells
    are computed there.  Nothing is joined, no pair is an aggregate or a row before it is a result.  Years in which
    one of the two is missing do not count for that pair.  A second row for a year and stratum is an error; undefined
    values are missing.
    """
    strata = list(dict.fromkeys(strata))
    if stat not in ("corr", "covar_samp"):
        raise ValueError(f"unknown statistic {stat}")
    names = F.array(*[F.lit(s) for s in strata])
    cell = F.when(F.col("strata").isin(strata), F.struct("strata", F.col(value).cast("double").alias("v")))
    second = F.raise_error(F.lit("more than one row for a year and stratum")).cast("array<double>")
    cells = F.col("_cells")
    dense = F.transform(names, lambda s: F.try_element_at(F.map_from_entries(cells), s)["v"])
    keyed = F.transform(cells, lambda c: F.struct(c["strata"].alias("key"), c.alias("value")))
    yearly = (
        df.groupBy(*by, "year")
        .agg(F.collect_list(cell).alias("_cells"))
        .withColumn("_once", F.size(F.array_distinct(F.transform(cells, lambda c: c["strata"]))) == F.size(cells))
        .withColumn("_cells", F.when(F.col("_once"), keyed))
        .select(*by, F.when(F.col("_once"), dense).otherwise(second).alias("_v"))
    )
    count = -(-len(strata) // PAIR_BLOCK)
    pairs = F.array(*[F.struct(F.lit(a).alias("_a"), F.lit(b).alias("_b")) for a in range(count) for b in range(a, count)])

    def piece(rows: Column, block: Column) -> Column:
        """Columns of a block: an array over the years for each of its strata."""
        width = F.least(F.lit(PAIR_BLOCK), F.lit(len(strata)) - block * PAIR_BLOCK)
        return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.transform(rows, lambda r: F.get(r, block * PAIR_BLOCK + i)))

    blocks = (
        yearly.groupBy(*by)
        .agg(F.collect_list("_v").alias("_rows"))
        .select(*by, "_rows", F.explode(pairs).alias("_p"))
        .select(*by, "_p.*", piece(F.col("_rows"), F.col("_p._a")).alias("_x"), piece(F.col("_rows"), F.col("_p._b")).alias("_y"))
        .repartition(*by, "_a", "_b")
    )

    total = lambda values: F.aggregate(values, F.lit(0.0), lambda s, v: s + v)

    def of_pair(x: Column, y: Column) -> Column:
        both = F.filter(F.zip_with(x, y, lambda p, q: F.struct(p.alias("x"), q.alias("y"))), lambda p: p.x.isNotNull() & p.y.isNotNull())

        def centred(w: Column) -> Column:
            n = F.size(w)
            means = F.struct(ratio(total(F.transform(w, lambda p: p.x)), n).alias("x"), ratio(total(F.transform(w, lambda p: p.y)), n).alias("y"))
            return let(means, lambda m: F.struct(n.alias("n"), *[
                total(F.transform(w, lambda p: (p[i] - m[i]) * (p[j] - m[j]))).alias(i + j) for i, j in ("xx", "xy", "yy")
            ]))

        def result(s: Column) -> Column:
            return ratio(s.xy, F.sqrt(s.xx * s.yy)) if stat == "corr" else F.when(s.n > 1, ratio(s.xy, s.n - 1))

        return let(let(both, centred), result)

    matrix = F.transform("_x", lambda x, i: F.transform("_y", lambda y, j: F.struct(i.alias("i"), j.alias("j"), of_pair(x, y).alias("_s"))))
    at = lambda block, place: F.col(block) * PAIR_BLOCK + F.col(f"_c.{place}")
    return (
        blocks.select(*by, "_a", "_b", F.explode(F.flatten(matrix)).alias("_c"))
        .where(at("_a", "i") <= at("_b", "j"))
        .select(*by, F.get(names, at("_a", "i")).alias("strata_a"), F.get(names, at("_b", "j")).alias("strata_b"), finite("_c._s").alias(stat))
    )


def relative_error(true: DataFrame, recovered: DataFrame) -> DataFrame:
    """Relative error of each replicate, with its parameter's median, label and share of failed replicates.

    ``true(parameter, model)`` has one row per parameter; ``recovered(parameter,
    replicate, estimate)`` may have any number.  The error is linear in the
    estimate, so its median is that of the estimates, and all per-parameter
    values reach the replicates by one salted join.
    """
    medians = exact_quantiles(recovered, ["parameter"], "estimate", [0.5], few_groups=True).select("parameter", F.col("q").alias("_median"))
    failed = recovered.groupBy("parameter").agg(F.avg(F.col("estimate").isNull().cast("int")).alias("share_missing"))
    error = lambda estimate: ratio(F.col("model") - F.col(estimate), "model") * 100
    per_parameter = (
        null_safe_join(null_safe_join(true, failed, ["parameter"]), medians, ["parameter"], "left")
        .withColumn("median_re", error("_median"))
        .withColumn("label", one_decimal("median_re", "Median RE=", "%"))
        .drop("_median")
    )
    return salted_join(recovered, per_parameter, ["parameter"], "inner").withColumn("re", error("estimate"))


def chain_index(
    df: DataFrame, chains: int, by: Sequence[str], draw: str = "draw_id", few_groups: bool = False, values: DataFrame | None = None
) -> DataFrame:
    """Chain number and iteration from an explicit 0-based draw number, chains stored one after another.

    ``few_groups`` says that the groups are configuration (samplers): their sizes are then broadcast, checked.
    ``values`` are the same draws before they were numbered, so that counting them does not number them again.
    """
    sizes = (df if values is None else values).groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / chains).cast("long").alias("_per"))
    sized = null_safe_join(df, checked_broadcast(sizes), list(by), "left") if few_groups else salted_join(df, sizes, list(by), "left")
    return (
        sized.withColumn("chain", (F.floor(F.col(draw) / F.col("_per")) + 1).cast("int"))
        .withColumn("iter", F.col(draw) % F.col("_per") + 1)
        .withColumnRenamed("_per", "draws_per_chain")
    )


def long_draws(draws: DataFrame, ids: Sequence[str], names: dict[str, str]) -> DataFrame:
    """Parameter columns to rows: ``ids..., parameter, value``, parameters under their reported names."""
    long = draws.unpivot(list(ids), list(names), "parameter", "value")
    return long.withColumn("parameter", recode("parameter", names, F.col("parameter")))


def posterior_qq(
    draws: DataFrame, names: dict[str, str], samplers: tuple[str, str], probs: Sequence[float] | None = None
) -> DataFrame:
    """Matched quantiles of two samplers: ``parameter, quant, a, b``."""
    long = long_draws(draws, ["sampler"], names).where(F.col("sampler").isin(*samplers))
    q = exact_quantiles(long, ["sampler", "parameter"], "value", probs or grid_probs(), few_groups=True)

    def of(s: str) -> Column:
        return F.max(F.when(F.col("sampler") == s, F.col("q")))

    return q.groupBy("parameter", F.col("prob").alias("quant")).agg(of(samplers[0]).alias("a"), of(samplers[1]).alias("b"))


def split_rhat(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """Potential scale reduction of split chains; needs ``chain, iter, draws_per_chain, value``."""
    half = F.when(F.col("iter") <= F.col("draws_per_chain") / 2, 1).otherwise(2)
    parts = long.groupBy(*by, "chain", half.alias("half")).agg(
        F.avg("value").alias("_m"), F.var_samp("value").alias("_v"), F.count("value").alias("_n")
    )
    n = F.col("_nbar")
    return (
        parts.groupBy(*by)
        .agg(F.avg("_v").alias("_w"), F.var_samp("_m").alias("_bm"), F.avg("_n").alias("_nbar"))
        .withColumn("rhat", F.sqrt(ratio((n - 1) / n * F.col("_w") + F.col("_bm"), "_w")))
        .select(*by, "rhat")
    )


def posterior_summary(
    draws: DataFrame,
    names: dict[str, str],
    point: DataFrame | None = None,
    chains: int = 3,
    point_label: str = "point fit",
    values: DataFrame | None = None,
) -> DataFrame:
    """Median, 95 % interval and split R-hat per sampler and parameter, and the point fit's normal interval.

    ``point(parameter, est, sd)`` adds rows with ``est`` and ``est +- 1.96 sd``
    and no R-hat.  ``values`` are the same draws before they were numbered:
    quantiles and counts need no numbers.
    """
    by = ["sampler", "parameter"]
    unnumbered = draws if values is None else values
    q = exact_quantiles(long_draws(unnumbered, ["sampler"], names), by, "value", [0.025, 0.5, 0.975], few_groups=True)
    chained = long_draws(chain_index(draws, chains, ["sampler"], few_groups=True, values=unnumbered), ["sampler", "chain", "iter", "draws_per_chain"], names)

    def at(p: float) -> Column:
        return F.max(F.when(F.col("prob") == p, F.col("q")))

    spread = q.groupBy(*by).agg(at(0.5).alias("median"), at(0.025).alias("lower"), at(0.975).alias("upper"))
    summary = null_safe_join(spread, split_rhat(chained, by), by, "left")
    if point is None:
        return summary
    fit = point.select(
        F.lit(point_label).alias("sampler"),
        "parameter",
        F.col("est").alias("median"),
        (F.col("est") - 1.96 * F.col("sd")).alias("lower"),
        (F.col("est") + 1.96 * F.col("sd")).alias("upper"),
    )
    return summary.unionByName(fit, allowMissingColumns=True)


@dataclass(frozen=True)
class Scenario:
    """One model configuration: which data it sees and how its strata share parameters."""

    name: str
    dataset: str
    first_year: int
    last_year: int
    dropped: tuple[int, ...] = ()
    floor: float | None = None
    pe_groups: dict[str, str] = field(default_factory=dict)
    q_groups: dict[str, str] = field(default_factory=dict)


def scenario_fanout(data: DataFrame, scenarios: Sequence[Scenario], areas: dict[str, str]) -> DataFrame:
    """One copy of the rows each scenario uses, tagged with scenario and parameter groups.

    ``data(dataset, year, strata, ..., cv)``.  The scenario list is
    configuration, so rows meet it by an equality join on the dataset version.
    Strata without an explicit group share the scenario's only process error
    and their area's catchability.
    """
    table = lookup(
        data.sparkSession,
        [
            (s.name, s.dataset, s.first_year, s.last_year, list(s.dropped), s.floor, dict(s.pe_groups), dict(s.q_groups))
            for s in scenarios
        ],
        "scenario string, dataset string, _first int, _last int, _dropped array<int>, _floor double, "
        "_pe map<string,string>, _q map<string,string>",
    )
    year, cv = F.col("year"), F.col("cv")
    return (
        data.join(table, "dataset")
        .where(year.between(F.col("_first"), F.col("_last")) & ~F.array_contains("_dropped", year.cast("int")))
        .withColumn("cv", F.when(cv < F.col("_floor"), F.col("_floor")).otherwise(cv))
        .withColumn("pe_group", F.coalesce(F.try_element_at("_pe", F.col("strata")), F.lit("all")))
        .withColumn("q_group", F.coalesce(F.try_element_at("_q", F.col("strata")), recode("strata", areas)))
        .drop("_first", "_last", "_dropped", "_floor", "_pe", "_q")
    )


def retrospective_peels(series: DataFrame, peel_years: Sequence[int]) -> DataFrame:
    """For every terminal year a copy of the data up to it, tagged ``peel``.

    A row finds its own peels in the list, so nothing is cross-joined.
    """
    peels = F.array(*[F.lit(int(p)) for p in peel_years])
    return series.withColumn("peel", F.explode(F.filter(peels, lambda p: p >= F.col("year"))))


def peel_projections(
    pred: DataFrame, horizon: int = 2, one_year_peels: Sequence[int] = (2017,)
) -> DataFrame:
    """Predictions after the terminal year of their peel, one year only for the listed peels."""
    ahead = F.col("year") - F.col("peel")
    reach = F.when(F.col("peel").isin(list(one_year_peels)), F.lit(1)).otherwise(F.lit(horizon))
    return pred.where((ahead > 0) & (ahead <= reach))


def retrospective_abc(
    projections: DataFrame, limits: DataFrame, area_catch: DataFrame, m: float = 0.03, factor: float = 0.75
) -> DataFrame:
    """ABC implied by each peel next to the adopted limit and the catch.

    Inputs have one row per (peel,) year and area; catch is summed over
    retention first, so the limit is not repeated.
    """
    catch = area_catch.groupBy("year", "area").agg(F.sum("catch").alias("catch"))
    implied = projections.withColumn("implied_abc", F.lit(factor) * F.lit(m) * F.col("pred"))
    adopted = null_safe_join(implied, limits.select("year", "area", "abc"), ["year", "area"], "left")
    return null_safe_join(adopted, catch, ["year", "area"], "left")


# --- random-walk smoother ----------------------------------------------------


def pe_grid(lo: float = -4.0, hi: float = 0.0, step: float = 0.05) -> list[float]:
    """Log process errors to try."""
    return [round(lo + i * step, 10) for i in range(round((hi - lo) / step) + 1)]


# State of the forward filter: level x, its variance p, log-likelihood ll.  One observation o has the log index y
# and its variance r; both are null in a year without one.  The first observation sets the state.
_START = "named_struct('x', CAST(NULL AS DOUBLE), 'p', CAST(NULL AS DOUBLE), 'll', 0D)"
_STEP = """
CASE
  WHEN o.y IS NULL OR o.r IS NULL THEN named_struct('x', {s}.x, 'p', {s}.p + {var}, 'll', {s}.ll)
  WHEN {s}.x IS NULL THEN named_struct('x', o.y, 'p', o.r, 'll', {s}.ll)
  ELSE named_struct(
    'x', {s}.x + ({s}.p + {var}) / ({s}.p + {var} + o.r) * (o.y - {s}.x),
    'p', ({s}.p + {var}) * (1 - ({s}.p + {var}) / ({s}.p + {var} + o.r)),
    'll', {s}.ll - (ln(2 * pi() * ({s}.p + {var} + o.r)) + (o.y - {s}.x) * (o.y - {s}.x) / ({s}.p + {var} + o.r)) / 2)
END"""


def _loglik(obs: str, var: str) -> Column:
    """Log-likelihood of a series under process variance ``var``, without keeping the states."""
    return F.expr(f"aggregate({obs}, {_START}, (s, o) -> {_STEP.format(s='s', var=var)}, s -> s.ll)")


def _smooth(obs: str, var: str) -> Column:
    """Filter forward keeping the states, then run backward over them; one struct (x, p) per year.

    A year before the first observation takes the following level, with the
    variance growing by ``var`` per year.
    """
    step = _STEP.format(s="coalesce(get(h, size(h) - 1), " + _START + ")", var=var)
    forward = f"""aggregate({obs}, CAST(array() AS ARRAY<STRUCT<x: DOUBLE, p: DOUBLE, ll: DOUBLE>>),
      (h, o) -> concat(h, array({step})))"""
    # b is newest first: its last element is the following year.
    nxt = "get(b, size(b) - 1)"
    gain = f"(f.p / (f.p + {var}))"
    back = f"""
    CASE
      WHEN size(b) = 0 THEN named_struct('x', f.x, 'p', f.p)
      WHEN f.x IS NULL THEN named_struct('x', {nxt}.x, 'p', {nxt}.p + {var})
      ELSE named_struct(
        'x', f.x + {gain} * ({nxt}.x - f.x),
        'p', f.p + {gain} * {gain} * ({nxt}.p - f.p - {var}))
    END"""
    return F.expr(f"""reverse(aggregate(reverse({forward}), CAST(array() AS ARRAY<STRUCT<x: DOUBLE, p: DOUBLE>>),
      (b, f) -> concat(b, array({back}))))""")


#: The filter's state with first and second derivatives by the log process error (names ending in 1 and 2).  With
#: ``v`` for the process variance, its derivatives are ``2 v`` and ``4 v``.
_SLOPES = "x x1 x2 p p1 p2 l l1 l2".split()
_SLOPE_START = "named_struct({})".format(", ".join(f"'{n}', CAST({'NULL' if n[0] in 'xp' else '0'} AS DOUBLE)" for n in _SLOPES))


def _let_sql(value: str, name: str, body: str) -> str:
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _slope_step(var: str) -> str:
    """SQL of one year of the filter, carrying the derivatives; the state's size does not grow with the years."""
    named = lambda pairs: "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in pairs.items()) + ")"
    passed = {**{n: f"s.{n}" for n in _SLOPES}, "p": f"s.p + {var}", "p1": f"s.p1 + 2 * {var}", "p2": f"s.p2 + 4 * {var}"}
    opened = {"x": "o.y", "x1": "0D", "x2": "0D", "p": "o.r", "p1": "0D", "p2": "0D", "l": "s.l", "l1": "s.l1", "l2": "s.l2"}
    # f: variance of the prediction, k: gain, e: error; the gain is 1 - r / f and the new variance r * k.
    first = {"f": f"s.p + {var} + o.r", "f1": f"s.p1 + 2 * {var}", "f2": f"s.p2 + 4 * {var}", "e": "o.y - s.x"}
    gain = {"k": "1 - o.r / q.f", "k1": "o.r * q.f1 / (q.f * q.f)", "k2": "o.r * q.f2 / (q.f * q.f) - 2 * o.r * q.f1 * q.f1 / (q.f * q.f * q.f)"}
    updated = {
        "x": "s.x + g.k * q.e",
        "x1": "s.x1 + g.k1 * q.e - g.k * s.x1",
        "x2": "s.x2 + g.k2 * q.e - 2 * g.k1 * s.x1 - g.k * s.x2",
        "p": "o.r * g.k", "p1": "o.r * g.k1", "p2": "o.r * g.k2",
        "l": "s.l - (ln(2 * pi() * q.f) + q.e * q.e / q.f) / 2",
        "l1": "s.l1 - (q.f1 / q.f - 2 * q.e * s.x1 / q.f - q.e * q.e * q.f1 / (q.f * q.f)) / 2",
        "l2": "s.l2 - (q.f2 / q.f - q.f1 * q.f1 / (q.f * q.f) + (2 * s.x1 * s.x1 - 2 * q.e * s.x2) / q.f "
        "+ 4 * q.e * s.x1 * q.f1 / (q.f * q.f) - q.e * q.e * q.f2 / (q.f * q.f) + 2 * q.e * q.e * q.f1 * q.f1 / (q.f * q.f * q.f)) / 2",
    }
    seen = _let_sql(named(first), "q", _let_sql(named(gain), "g", named(updated)))
    return f"CASE WHEN o.y IS NULL OR o.r IS NULL THEN {named(passed)} WHEN s.x IS NULL THEN {named(opened)} ELSE {seen} END"


def newton_error(obs: str, start: str, low: float, high: float, steps: int = 8) -> Column:
    """``struct<s, l>``: log process error of most likelihood and that likelihood, for series that share it.

    ``obs`` is an array of series, ``start`` a log process error near the best one.  Newton's steps on the sum of the
    series' likelihoods, uphill where it is not concave, at most a tenth at once and inside ``[low, high]``; the best
    of all values tried is returned.
    """
    inner = f"aggregate(w, {_SLOPE_START}, (s, o) -> {_slope_step('exp(2 * b.s)')})"
    parts = ", ".join(f"'l{n}', sum_.l{n} + one.l{n}" for n in ("", "1", "2"))
    scored = f"aggregate(transform({obs}, w -> {inner}), named_struct('l', 0D, 'l1', 0D, 'l2', 0D), (sum_, one) -> named_struct({parts}))"
    step = "CASE WHEN t.l2 < 0 THEN -t.l1 / t.l2 ELSE sign(t.l1) * 0.025D END"
    moved = f"least({high!r}D, greatest({low!r}D, b.s + least(0.1D, greatest(-0.1D, {step}))))"
    better = "b.best IS NULL OR t.l > b.best"
    state = f"named_struct('s', {moved}, 'at', IF({better}, b.s, b.at), 'best', IF({better}, t.l, b.best))"
    begun = f"named_struct('s', {start}, 'at', {start}, 'best', CAST(NULL AS DOUBLE))"
    walk = f"aggregate(sequence(0, {int(steps)}), {begun}, (b, i) -> {_let_sql(scored, 't', state)}, b -> named_struct('s', b.at, 'l', b.best))"
    return F.expr(walk)


def smooth_index(
    index: DataFrame,
    start: int,
    end: int,
    groups: dict[str, str] | None = None,
    grid: Sequence[float] | None = None,
    by: Sequence[str] = (),
    value: str = "biomass",
    cv: str = "cv",
    newton: int = 0,
) -> DataFrame:
    """Random-walk smoothing of each stratum's log index over ``start..end``.

    Strata of one group share a process error, chosen from ``grid`` (log scale)
    by the summed log-likelihood; ties go to the smaller one.  With ``newton``,
    that many steps on the likelihood's derivatives go on from there, inside the
    ends of the grid (``newton_error``); a coarse grid is then enough.  Observation
    variance is ``ln(1 + cv^2)``.  Years without an index have no update, so
    gaps are bridged and years after the data are projected.  Columns:
    ``by..., strata, year, pred, se, pred_lci, pred_uci, ln_pe, loglik``.

    ``index`` has one row per (by, stratum, year); repeated rows are an error.
    The series of a stratum is at most ``end - start + 1`` years long, so it
    fits in a row; all work is inside that row.
    """
    grid = list(grid if grid is not None else pe_grid())
    by = list(by)
    group = F.lit("all") if groups is None else recode("strata", groups)
    y = F.when(F.col(value) > 0, F.ln(value))
    once = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("smooth_index: repeated year in a series")).cast("double"))
    yearly = (
        index.withColumn("_y", y)
        .withColumn("_r", F.ln(1 + F.col(cv) * F.col(cv)))
        .groupBy(*by, "strata", "year")
        .agg(F.coalesce(once, F.max("_y")).alias("y"), F.max("_r").alias("r"))
    )
    in_span = F.when(F.col("year").between(start, end), F.struct(F.col("year").cast("int"), F.struct("y", "r").alias("o")))
    series = (
        yearly.groupBy(*by, "strata")
        .agg(F.map_from_entries(F.collect_list(in_span)).alias("_map"))
        .withColumn("_k", F.struct(*by, group.alias("_g")))
        .withColumn(
            "_obs",
            F.transform(
                F.sequence(F.lit(start), F.lit(end)),
                lambda t: F.coalesce(
                    F.try_element_at("_map", t),
                    F.struct(F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("r")),
                ),
            ),
        )
        .drop("_map")
    )
    scored = (
        series.withColumn("_s", F.explode(doubles(grid)))
        .withColumn("_ll", _loglik("_obs", "exp(2 * _s)"))
        .groupBy("_k", "_s")
        .agg(F.sum("_ll").alias("_ll"))
    )
    best = scored.groupBy("_k").agg(F.max(F.struct("_ll", (-F.col("_s")).alias("_neg"))).alias("_b"))
    best = best.select("_k", F.col("_b._ll").alias("loglik"), (-F.col("_b._neg")).alias("_s"))
    if newton:
        # The strata that share a process error are a model's: their series fit in a row.
        together = series.groupBy("_k").agg(F.collect_list("_obs").alias("_all")).join(best, "_k")
        found = newton_error("_all", "_s", min(grid), max(grid), newton)
        best = together.select("_k", found.alias("_f")).select("_k", F.col("_f.l").alias("loglik"), F.col("_f.s").alias("_s"))
    se = F.sqrt("_e.p")
    return (
        series.join(best, "_k")
        .withColumn("_path", _smooth("_obs", "exp(2 * _s)"))
        .select(
            *by,
            "strata",
            "loglik",
            F.col("_s").alias("ln_pe"),
            F.posexplode("_path").alias("_i", "_e"),
        )
        .select(
            *by,
            "strata",
            (F.col("_i") + start).cast("int").alias("year"),
            F.exp("_e.x").alias("pred"),
            se.alias("se"),
            F.exp(F.col("_e.x") - 1.96 * se).alias("pred_lci"),
            F.exp(F.col("_e.x") + 1.96 * se).alias("pred_uci"),
            "ln_pe",
            "loglik",
        )
    )


# --- forms the assessment keeps at hand but does not run by default ------------


def impute_stratum_ratio(
    df: DataFrame, pairs: dict[str, str], by: Sequence[str] = ()
) -> DataFrame:
    """Fill missing biomass of a stratum with mean(stratum / partner) x partner of the year.

    ``pairs`` maps the stratum to its partner.  The input has one row per year
    and stratum, so its windows are short.
    """
    b = F.col("biomass")
    year = Window.partitionBy(*by, "year")
    out, filled = df, b
    for i, (stratum, partner) in enumerate(pairs.items()):
        here = F.col("strata") == stratum
        out = out.withColumn(f"_p{i}", F.max(F.when(F.col("strata") == partner, b)).over(year))
        out = out.withColumn(f"_r{i}", F.avg(F.when(here, ratio(b, F.col(f"_p{i}")))).over(Window.partitionBy(*by, "strata")))
        filled = F.when(here & b.isNull(), F.col(f"_r{i}") * F.col(f"_p{i}")).otherwise(filled)
    return out.withColumn("biomass", filled).select(*df.columns)


def fixed_extra_cv(df: DataFrame, extra: float = 0.2) -> DataFrame:
    """Total log SD and CV with a fixed extra CV, and the bounds that follow from them."""
    sd = F.when(F.col("obs") > 0, F.sqrt(F.ln(F.pow("obs_cv", F.lit(2)) + extra * extra + 1)))
    return (
        df.withColumn("tot_sd_log_obs", sd)
        .withColumn("tot_obs_lci", F.exp(F.col("log_obs") - Z95 * F.col("tot_sd_log_obs")))
        .withColumn("tot_obs_uci", F.exp(F.col("log_obs") + Z95 * F.col("tot_sd_log_obs")))
        .withColumn("tot_cv", F.sqrt(F.exp(F.pow("tot_sd_log_obs", F.lit(2))) - 1))
        .withColumn("delta_cv", F.col("tot_cv") - F.col("obs_cv"))
    )


def log_covariance(df: DataFrame, strata: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Pairwise-complete covariance of the strata's log predictions, upper triangle."""
    logged = df.withColumn("_log", F.ln("pred"))
    return strata_correlation(logged, strata, "_log", by, "covar_samp")
