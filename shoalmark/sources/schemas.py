"""Declared schemas: nothing is inferred, and scans read only these columns."""

from __future__ import annotations

_SCHEMAS = {
    "longline_area": "species_code int, fmp_management_area string, exploitable int, country string, year int, "
    "council_management_area string, rpw double, rpw_var double, rpn double",
    "longline_depredation": "country string, exploitable int, year int, geographic_area_name string, "
    "council_sablefish_management_area string, rpw double, rpw_var double",
    "trawl_biomass": "species_code int, survey_definition_id int, year int, area_id int, biomass_mt double, "
    "biomass_var double, n_haul int",
    "longline_length": "species_code int, year int, council_sablefish_management_area string, area_code int, "
    "length double, rpn double",
    "trawl_size": "species_code int, survey_definition_id int, year int, length_mm int, area_id int, "
    "population_count double",
    "fishery_length": "species int, gear int, nmfs_area int, year int, length double, frequency int",
    "longline_length_summary": "species_code int, year int, country string, stratum int, stratum_description string, "
    "council_sablefish_mgmt_area string, length double, frequency int",
    "trawl_length": "species_code int, survey_definition_id int, year int, length_mm int, frequency int, "
    "regulatory_area string, depth_gear_m double, depth_m double",
    "longline_catch": "species_code int, year int, ineffective int, catch_freq double, "
    "council_sablefish_management_area string, intrpdep double, habitat_type string, station_number int, "
    "start_latitude double, end_latitude double, start_longitude double, end_longitude double",
    "trawl_catch": "species_code int, survey_definition_id int, year int, haul bigint, weight_kg double, "
    "`count` double, depth_gear_m double",
    "trawl_haul": "survey_definition_id int, year int, haul bigint, depth_gear_m double, performance double, "
    "regulatory_area string",
    "trawl_cpue": "species_code int, survey_definition_id int, year int, hauljoin bigint, regulatory_area string, "
    "`count` double, latitude_dd_start double, latitude_dd_end double, longitude_dd_start double, "
    "longitude_dd_end double",
    "catch_blend": "species_group_code string, fmp_area string, year string, fmp_subarea string, "
    "retained_or_discarded string, agency_gear_code string, trip_target_name string, weight_posted double",
    "limits": "area_label string, acceptable_biological_catch double, year int",
    "observer_catch": "lat400sqkm double, lon400sqkm double, species string, year int, gear string, kg double",
    "index_csv": "year int, strata string, n int, biomass double, cv double",
    "cpue_csv": "year int, strata string, cpue double, cv double",
    "polygons": "poly_id string, ring array<struct<x: double, y: double>>, rings array<array<struct<x: double, y: double>>>",
}


def schema(name: str) -> str:
    """DDL schema of a known input table."""
    return _SCHEMAS[name]


def names() -> list[str]:
    return list(_SCHEMAS)
