"""Stand-in survey tables over the generic test tables.

They give the operators inputs of the right shape, with missing and zero
variances, unmapped codes, unsurveyed areas and missing names on purpose.
Row-level joins are plain equality joins: where the dimension is small they are
broadcast by its measured size, where it is not, adaptive execution splits the
partition of a key with very many rows.  After such a join the rows are summed
before they are shuffled again.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ranking import positions
from ..sources.lookups import StrataScheme

# The stand-in stratification over part sizes.
S9 = StrataScheme(
    "s9",
    (
        ("WA", "WA_0_500", 1, 8),
        ("CA", "CA_0_500", 9, 18),
        ("EA", "EA_0_500", 19, 28),
        ("WA", "WA_501_700", 29, 31),
        ("CA", "CA_501_700", 32, 34),
        ("EA", "EA_501_700", 35, 37),
        ("WA", "WA_701_1000", 38, 40),
        ("CA", "CA_701_1000", 41, 43),
        ("EA", "EA_701_1000", 44, 46),
    ),
)
S6 = StrataScheme(
    "s6",
    (
        ("WA", "WA_0_700", 1, 8),
        ("WA", "WA_0_700", 29, 31),
        ("CA", "CA_0_700", 9, 18),
        ("CA", "CA_0_700", 32, 34),
        ("EA", "EA_0_700", 19, 28),
        ("EA", "EA_0_700", 35, 37),
        ("WA", "WA_701_1000", 38, 40),
        ("CA", "CA_701_1000", 41, 43),
        ("EA", "EA_701_1000", 44, 46),
    ),
)
MERGE = {
    "WA_0_500": "WA_0_700",
    "WA_501_700": "WA_0_700",
    "CA_0_500": "CA_0_700",
    "CA_501_700": "CA_0_700",
    "EA_0_500": "EA_0_700",
    "EA_501_700": "EA_0_700",
}
MODELS = ["STANDARD", "SMALL", "MEDIUM", "LARGE", "ECONOMY", "PROMO"]
REGION_AREAS = {"AFRICA": "AF", "AMERICA": "AM", "ASIA": "AS", "EUROPE": "EU"}


def _moments(x: str) -> list[Column]:
    """Count, sum and centred sum of squares of a first-level group."""
    return [F.count(x).alias("_n"), F.sum(x).alias("_s"), (F.var_pop(x) * F.count(x)).alias("_m2")]


def _merged_variance() -> Column:
    """``var_samp`` of the rows behind merged first-level groups."""
    n, s = F.sum("_n"), F.sum("_s")
    m2 = F.sum("_m2") + F.sum(F.col("_s") * F.col("_s") / F.col("_n")) - s * s / n
    return F.try_divide(F.greatest(m2, F.lit(0.0)), (n - 1).cast("double"))


# Declared schemas of the test tables: no file is opened to infer one.
BASE = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


class Tables:
    """Base tables and stand-in views of one data directory; every view is a lazy plan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def base(self, name: str) -> DataFrame:
        return self.spark.read.schema(BASE[name]).parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def _geo(self) -> DataFrame:
        nation, region = self.base("nation"), self.base("region")
        return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", "n_name", "r_name")

    @cached_property
    def survey_area(self) -> DataFrame:
        year, price = F.year("l_shipdate"), F.col("l_extendedprice")
        n = F.count(F.lit(1))
        return (
            self.base("lineitem")
            .join(self.base("part"), F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("p_type").alias("species"), year.alias("year"), F.col("p_size").alias("area_id"))
            .agg((F.sum(price) / 1000).alias("_b"), (F.var_samp(price) * n / 1_000_000).alias("_v"), n.alias("n_haul"))
            .select(
                "species",
                "year",
                "area_id",
                F.when(F.col("area_id") != 17, F.col("_b")).alias("biomass_mt"),
                F.when(F.col("area_id") % 10 == 0, F.lit(0.0))
                .when(F.col("area_id") % 13 != 0, F.col("_v"))
                .alias("biomass_var"),
                "n_haul",
            )
        )

    @cached_property
    def gap_area(self) -> DataFrame:
        """``survey_area`` with years in which some areas were not surveyed, for the operators whose feature is gaps."""
        area, year = F.col("area_id"), F.col("year")
        return self.survey_area.where(
            ~(area.between(29, 37) & year.isin(1996, 1998))
            & ~(area.between(38, 46) & year.isin(1996, 1997, 1998, 2000))
            & ~((area.between(19, 28) | area.between(35, 37)) & (year == 2001))
        )

    @cached_property
    def lls_area(self) -> DataFrame:
        per_supplier = (
            self.base("lineitem")
            .join(self.base("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
            .groupBy("l_suppkey", F.year("l_shipdate").alias("year"), "l_linestatus", "p_type")
            .agg(*_moments("l_quantity"))
        )
        n = F.sum("_n")
        key = F.col("n_nationkey")
        return (
            per_supplier.join(self.base("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(self._geo, F.col("s_nationkey") == key)
            .groupBy("year", "r_name", "n_nationkey", "n_name", "l_linestatus", "p_type")
            .agg(F.sum("_s").alias("_q"), (_merged_variance() * n).alias("_v"), n.alias("rpn"))
            .select(
                "year",
                F.col("r_name").alias("mgmt_area"),
                F.when(key != 7, F.col("n_name")).alias("geo_area"),
                F.col("l_linestatus").alias("exploitable"),
                F.col("p_type").alias("species"),
                F.when(key != 11, F.col("_q")).alias("rpw"),
                F.when(key != 11, F.col("_v")).alias("rpw_var"),
                "rpn",
            )
        )

    @cached_property
    def customer_geo(self) -> DataFrame:
        return (
            self.base("customer")
            .join(self._geo, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("c_custkey", "c_mktsegment", "r_name")
        )

    @cached_property
    def order_geo(self) -> DataFrame:
        return self.base("orders").join(self.customer_geo, F.col("o_custkey") == F.col("c_custkey"))

    @cached_property
    def catch_blend(self) -> DataFrame:
        return (
            self.base("lineitem")
            .join(
                self.order_geo.select("o_orderkey", "o_orderdate", "o_orderpriority", "c_mktsegment", "r_name"),
                F.col("l_orderkey") == F.col("o_orderkey"),
            )
            .select(
                F.year("o_orderdate").cast("string").alias("year"),
                F.col("r_name").alias("subarea"),
                F.when(F.col("l_returnflag") == "R", "D").otherwise("R").alias("retained_or_discarded"),
                F.col("o_orderpriority").alias("gear"),
                F.col("c_mktsegment").alias("target"),
                F.col("l_quantity").alias("weight_posted"),
            )
        )

    @cached_property
    def limits(self) -> DataFrame:
        total = F.sum("o_totalprice")
        return (
            self.order_geo.groupBy(F.year("o_orderdate").alias("year"), F.col("r_name").alias("area"))
            .agg((total / 100000).alias("abc"), (total / 75000).alias("ofl"))
        )

    @cached_property
    def length_freq(self) -> DataFrame:
        return (
            self.base("lineitem")
            .join(self.base("part").select("p_partkey", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
            .select(
                F.col("l_linestatus").alias("survey"),
                F.year("l_shipdate").alias("year"),
                F.col("p_size").alias("area_id"),
                F.col("l_returnflag").alias("gear"),
                F.col("l_quantity").alias("length"),
                F.when(F.col("l_linenumber") != 7, F.col("l_linenumber")).alias("freq"),
            )
        )

    @cached_property
    def hauls(self) -> DataFrame:
        return self.base("orders").select(
            F.col("o_orderkey").alias("haul"),
            (F.col("o_totalprice") / 400).alias("depth"),
            F.col("o_orderpriority").alias("geo"),
            F.col("o_orderstatus").alias("performance"),
        )

    @cached_property
    def haul_catch(self) -> DataFrame:
        return (
            self.base("lineitem")
            .select(
                F.col("l_orderkey").alias("haul"),
                F.col("l_quantity").alias("weight_kg"),
                F.col("l_linenumber").alias("cnt"),
            )
        )

    @cached_property
    def hook_sets(self) -> DataFrame:
        return self.base("lineitem").select(
            F.year("l_shipdate").alias("year"),
            F.col("l_returnflag").alias("region"),
            (F.col("l_extendedprice") / 90).alias("depth"),
            F.col("l_linenumber").alias("ineffective"),
            F.when(F.col("l_tax") != 0, F.col("l_quantity")).alias("catch_freq"),
        )

    @cached_property
    def obs_points(self) -> DataFrame:
        key = F.col("c_custkey")
        return self.base("customer").select(
            key.alias("id"),
            (F.lit(2023) + key % 3).alias("year"),
            F.col("c_mktsegment").alias("gear"),
            (F.lit(-170) + key % 40).cast("double").alias("lon"),
            (F.lit(52) + key % 9).cast("double").alias("lat"),
            F.col("c_acctbal").alias("kg"),
        )

    @cached_property
    def fit_by_strata(self) -> DataFrame:
        from ..operators.index import assign_strata

        b, v = F.sum("biomass_mt"), F.sum("biomass_var")
        return (
            assign_strata(self.survey_area, S6)
            .groupBy(F.col("species").alias("model_name"), "area", "strata", "year")
            .agg(b.alias("pred"), v.alias("_v"))
            .select(
                "model_name",
                F.concat_ws("_", "area", "strata").alias("strata"),
                "area",
                "year",
                F.lit("biomass_pred").alias("variable"),
                "pred",
                (F.col("pred") * 0.8).alias("pred_lci"),
                (F.col("pred") * 1.25).alias("pred_uci"),
                (F.sqrt("_v") / F.col("pred")).alias("obs_cv"),
                F.sqrt(F.ln(1 + F.col("_v") / F.pow("pred", F.lit(2)) + 0.01)).alias("tot_sd_log_obs"),
            )
        )

    @cached_property
    def recovered(self) -> DataFrame:
        return self.base("events").select(
            F.col("event_type").alias("parameter"),
            F.col("event_id").alias("replicate"),
            F.when(F.col("event_id") % 50 != 0, F.col("value")).alias("estimate"),
        )

    @cached_property
    def true_values(self) -> DataFrame:
        return (
            self.base("events")
            .groupBy(F.col("event_type").alias("parameter"))
            .agg(F.avg("value").alias("model"))
        )

    @cached_property
    def draw_values(self) -> DataFrame:
        """Draws as they arrive, one sampler per event type, in the order of ``event_id``."""
        return self.base("events").select(
            F.col("event_type").alias("sampler"),
            "event_id",
            F.when(F.col("value") > 0, F.ln("value")).alias("V1"),
            (F.col("value") / 100).alias("V2"),
        )

    @cached_property
    def draws(self) -> DataFrame:
        """``draw_values``, numbered from 0 in each sampler."""
        return positions(self.draw_values, ["sampler"], "event_id").select("sampler", F.col("before").alias("draw_id"), "V1", "V2")
