"""Strata, areas, gears and depth classes as data.

Everything below is a fixed value of the survey design or of the catch
accounting system: codes, labels and code ranges in their natural order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import lookup


@dataclass(frozen=True)
class StrataScheme:
    """A version of the stratification: inclusive code ranges per stratum."""

    name: str
    ranges: tuple[tuple[str, str, int, int], ...]  # area, stratum, first code, last code

    @property
    def strata(self) -> list[str]:
        return list(dict.fromkeys(s for _, s, _, _ in self.ranges))

    def codes(self) -> list[tuple[int, str, str]]:
        """One ``(code, area, stratum)`` per code; a code may belong to one stratum only."""
        seen: dict[int, tuple[str, str]] = {}
        for area, stratum, lo, hi in self.ranges:
            for code in range(lo, hi + 1):
                if seen.setdefault(code, (area, stratum)) != (area, stratum):
                    raise ValueError(f"code {code} is in {seen[code][1]} and in {stratum}")
        return [(code, *where) for code, where in seen.items()]

    def frame(self, spark: SparkSession) -> DataFrame:
        """Broadcastable ``(area_id, area, strata)``: an equality join, not a range join."""
        return lookup(spark, self.codes(), "area_id int, area string, strata string")


# Trawl survey codes by depth stratum, three depth zones.
NINE_STRATA = StrataScheme(
    "9",
    (
        ("WGOA", "WGOA_0_500", 10, 13),
        ("WGOA", "WGOA_0_500", 110, 112),
        ("WGOA", "WGOA_0_500", 210, 210),
        ("WGOA", "WGOA_0_500", 310, 310),
        ("CGOA", "CGOA_0_500", 20, 35),
        ("CGOA", "CGOA_0_500", 120, 134),
        ("CGOA", "CGOA_0_500", 220, 232),
        ("CGOA", "CGOA_0_500", 320, 320),
        ("CGOA", "CGOA_0_500", 330, 330),
        ("EGOA", "EGOA_0_500", 40, 50),
        ("EGOA", "EGOA_0_500", 140, 151),
        ("EGOA", "EGOA_0_500", 240, 251),
        ("EGOA", "EGOA_0_500", 340, 351),
        ("WGOA", "WGOA_501_700", 410, 410),
        ("CGOA", "CGOA_501_700", 420, 420),
        ("CGOA", "CGOA_501_700", 430, 430),
        ("EGOA", "EGOA_501_700", 440, 440),
        ("EGOA", "EGOA_501_700", 450, 450),
        ("WGOA", "WGOA_701_1000", 510, 510),
        ("CGOA", "CGOA_701_1000", 520, 520),
        ("CGOA", "CGOA_701_1000", 530, 530),
        ("EGOA", "EGOA_701_1000", 540, 540),
        ("EGOA", "EGOA_701_1000", 550, 550),
    ),
)

# The same survey after the redesign, two depth zones.
SIX_STRATA = StrataScheme(
    "6",
    (
        ("WGOA", "WGOA_0_700", 10, 15),
        ("WGOA", "WGOA_0_700", 110, 113),
        ("WGOA", "WGOA_0_700", 210, 211),
        ("WGOA", "WGOA_0_700", 310, 310),
        ("WGOA", "WGOA_0_700", 410, 410),
        ("CGOA", "CGOA_0_700", 20, 38),
        ("CGOA", "CGOA_0_700", 120, 136),
        ("CGOA", "CGOA_0_700", 220, 232),
        ("CGOA", "CGOA_0_700", 320, 321),
        ("CGOA", "CGOA_0_700", 330, 330),
        ("CGOA", "CGOA_0_700", 420, 420),
        ("CGOA", "CGOA_0_700", 430, 430),
        ("EGOA", "EGOA_0_700", 40, 51),
        ("EGOA", "EGOA_0_700", 140, 152),
        ("EGOA", "EGOA_0_700", 240, 252),
        ("EGOA", "EGOA_0_700", 340, 352),
        ("EGOA", "EGOA_0_700", 440, 440),
        ("EGOA", "EGOA_0_700", 450, 450),
        ("WGOA", "WGOA_701_1000", 510, 511),
        ("CGOA", "CGOA_701_1000", 520, 521),
        ("CGOA", "CGOA_701_1000", 530, 531),
        ("EGOA", "EGOA_701_1000", 540, 541),
        ("EGOA", "EGOA_701_1000", 550, 551),
    ),
)

# Which three-zone strata make up the merged shallow strata.
MERGE_SHALLOW = {
    "WGOA_0_500": "WGOA_0_700",
    "WGOA_501_700": "WGOA_0_700",
    "CGOA_0_500": "CGOA_0_700",
    "CGOA_501_700": "CGOA_0_700",
    "EGOA_0_500": "EGOA_0_700",
    "EGOA_501_700": "EGOA_0_700",
}

# Management areas in report order, and the names used by each source.
AREAS = ["WGOA", "CGOA", "EGOA"]
LONGLINE_AREAS = {
    "Western Gulf of Alaska": "WGOA",
    "Central Gulf of Alaska": "CGOA",
    "Eastern Gulf of Alaska": "EGOA",
}
DEPREDATION_AREAS = {
    "Western Gulf of Alaska": "WGOA",
    "Central Gulf of Alaska": "CGOA",
    "West Yakutat": "WY",
    "East Yakutat/Southeast": "EYSE",
    "Aleutians": "AI",
    "Bering Sea": "BS",
}
TRAWL_AREAS = {
    "WESTERN GOA - INPFC": "WGOA",
    "WESTERN GOA - NMFS": "WGOA",
    "CENTRAL GOA - INPFC": "CGOA",
    "CENTRAL GOA - NMFS": "CGOA",
    "EASTERN GOA - INPFC": "EGOA",
    "EASTERN GOA - NMFS": "EGOA",
}
CATCH_AREAS = {"WG": "WGOA", "CG": "CGOA"}  # any other subarea is EGOA
LIMIT_AREAS = {"W": "WGOA", "C": "CGOA"}  # any other label is EGOA
REGIONS = {"WGOA": "GOA", "CGOA": "GOA", "WY": "GOA", "EYSE": "GOA"}  # other areas stand for themselves

# Gears.
GEAR_GROUPS = {"PTR": "trawl", "NPT": "trawl", "HAL": "longline"}
OBSERVER_FIXED_GEARS = {"POT": "Fixed", "LGL": "Fixed"}  # any other gear is Trawl
FISHERY_GEARS = {1: "Trawl", 8: "Longline"}

# One depth-class list for both surveys, in order of depth.
DEPTH_CLASSES = [
    (101, "1-100m"),
    (201, "101-200m"),
    (301, "201-300m"),
    (401, "301-400m"),
    (601, "401-600m"),
    (801, "601-800m"),
    (1001, "801-1000m"),
]
DEEPEST_CLASS = ">1000m"
DEPTH_ORDER = [
    "0-100m",
    "1-100m",
    "101-200m",
    "201-300m",
    "301-400m",
    "401-600m",
    "601-800m",
    "801-1000m",
    "1001-1200m",
    "1201m +",
    ">1000m",
]


def recode(c, mapping: dict, default=None, missing_is_other: bool = False):
    """Value looked up in ``mapping``; ``default`` (a value or a column) where it is not listed.

    A missing value stays missing, also with a default, unless
    ``missing_is_other`` says that it counts as one more unlisted value.
    """
    c = F.col(c) if isinstance(c, str) else c
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    found = F.try_element_at(table, c)
    if default is None:
        return found
    other = F.coalesce(found, default if isinstance(default, Column) else F.lit(default))
    return other if missing_is_other else F.when(c.isNotNull(), other)


def category_rank(c, ordered: list[str]):
    """Position of a category in its display order; labels outside the list sort last, not to null."""
    c = F.col(c) if isinstance(c, str) else c
    at = F.array_position(F.array(*[F.lit(v) for v in ordered]), c)
    return F.when(c.isNotNull(), F.when(at > 0, at).otherwise(F.lit(len(ordered) + 1))).cast("int")
