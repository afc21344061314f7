import os

import pytest

from shoalmark.operators import index as ix
from shoalmark.operators import length as ln
from shoalmark.plans import incremental as inc
from shoalmark.plans.standins import S9
from shoalmark.sources import readers as rd
from shoalmark.sources import writers as wr
from shoalmark.sources.schemas import names, schema


def test_every_schema_parses(spark):
    for n in names():
        assert spark.createDataFrame([], schema(n)).columns


def test_csv_round_trip_with_missing(spark, tmp_path):
    df = spark.createDataFrame([(1990, "A, b", 3, 1.5, None), (1991, None, None, None, 0.1)], schema("index_csv"))
    path = wr.sink_csv(df, str(tmp_path / "c"))
    got = {tuple(r) for r in rd.scan_csv(spark, path, "index_csv").collect()}
    assert got == {(1990, "A, b", 3, 1.5, None), (1991, None, None, None, 0.1)}


def test_landed_csv_any_case_and_order(spark, tmp_path):
    p = tmp_path / "o.csv"
    p.write_text("YEAR,Species,KG,GEAR,LON400SQKM,LAT400SQKM,EXTRA\n2023,Cod,1.5,POT,-150.5,57.25,x\n2024,Cod,NA,LGL,-150,57,y\n")
    rows = rd.scan_landed_csv(spark, str(p)).orderBy("year").collect()
    assert rows[0].asDict() == {"lat": 57.25, "lon": -150.5, "species": "Cod", "year": 2023, "gear": "POT", "kg": 1.5}
    assert rows[1].kg is None
    (tmp_path / "bad.csv").write_text("YEAR,KG\n2023,1\n")
    with pytest.raises(ValueError):
        rd.scan_landed_csv(spark, str(tmp_path / "bad.csv"))


def test_table_scan_prunes_and_pushes(spark, tmp_path):
    spark.range(100).selectExpr("id AS ID", "id % 3 AS Area", "id * 2 AS X").write.parquet(str(tmp_path / "t"))
    df = rd.scan_table(spark, str(tmp_path / "t"), ["id"], "area = 1")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(Area,1)" in plan and "X" not in plan.split("ReadSchema")[1]
    assert df.columns == ["id"] and df.count() == 33


def test_versions_do_not_touch_each_other(spark, tmp_path):
    path = str(tmp_path / "v")
    wr.sink_versioned(spark.range(3), path, "2024")
    wr.sink_versioned(spark.range(5), path, "2026")
    wr.sink_versioned(spark.range(1), path, "2024")
    got = {str(r.assessment): r["count"] for r in spark.read.parquet(path).groupBy("assessment").count().collect()}
    assert got == {"2024": 1, "2026": 5}


def test_keyed_csv_has_the_key_first(spark, tmp_path):
    path = wr.sink_csv_keyed(spark.createDataFrame([("a", 1999)], "m string, year int"), str(tmp_path / "k"))
    part = [f for f in os.listdir(path) if f.startswith("part-")][0]
    assert open(os.path.join(path, part)).readline() == "year,m\n"


def test_shared_folder_comes_from_the_session(spark):
    assert wr.shared_folder(spark).startswith(spark.conf.get("spark.checkpoint.dir"))


def test_bundle_registers_views(spark):
    wr.dataset_bundle({"b_one": spark.range(2), "b_two": spark.range(3)}, register=True)
    assert spark.table("b_two").count() == 3


def test_jdbc_needs_a_driver_but_builds_the_scan(spark):
    with pytest.raises(Exception) as e:
        rd.scan_jdbc(spark, "jdbc:nosuch://x", "t", where="a = 1", partition_by=("id", 0, 10, 2))
    assert "driver" in str(e.value).lower()


def test_landed_files_of_several_layouts_are_read_by_name(spark, tmp_path):
    folder = tmp_path / "landed files"
    folder.mkdir()
    (folder / "a.csv").write_text("YEAR,Species,KG,GEAR,LON400SQKM,LAT400SQKM\n2023,Cod,1.5,POT,-150.5,57.25\n")
    (folder / "b.csv").write_text('lat400sqkm,"lon400sqkm",X,gear,X,kg,year,species\n58,-151,x,LGL,x,NA,2024,"Cod, Pacific"\n59,-152,x,NA,x,2,2024,Cod\n')
    (folder / "c.csv").write_text("YEAR,Species,KG,GEAR,LON400SQKM,LAT400SQKM\n")
    got = sorted(map(tuple, rd.scan_landed_csv(spark, str(folder)).select("year", "lat", "lon", "species", "gear", "kg").collect()), key=str)
    assert got == [(2023, 57.25, -150.5, "Cod", "POT", 1.5), (2024, 58.0, -151.0, "Cod, Pacific", "LGL", None), (2024, 59.0, -152.0, "Cod", None, 2.0)]
    (folder / "d.csv").write_text("YEAR,KG\n2023,1\n")
    with pytest.raises(ValueError, match="no header"):
        rd.scan_landed_csv(spark, str(folder))


def test_declared_pulls_join_without_an_exchange(spark, tmp_path):
    hauls = spark.range(500).selectExpr("id AS haul", "cast(2000 + id % 5 AS int) AS year", "id * 2 AS depth")
    lengths = spark.range(3000).selectExpr("id % 500 AS haul", "cast(2000 + id % 5 AS int) AS year", "id % 90 AS length")
    wr.declare_pull(hauls, "pull_hauls", "haul", 4, path=str(tmp_path / "h"))
    wr.declare_pull(lengths, "pull_lengths", "haul", 4, path=str(tmp_path / "l"))
    left = rd.scan_pull(spark, "pull_lengths", ["haul", "length"], "year = 2001")
    both = left.join(rd.scan_pull(spark, "pull_hauls", ["haul", "depth"]).hint("merge"), "haul")
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "PartitionFilters: [isnotnull(year" in plan
    assert both.count() == 600
    # The years come from another table: those that are not needed are not read.
    years = spark.createDataFrame([(2003, "x"), (2004, "y")], "year int, cycle string").where("cycle = 'x'")
    some = rd.scan_pull(spark, "pull_lengths").join(years, "year")
    assert "dynamicpruning" in some._jdf.queryExecution().executedPlan().toString().lower() and some.count() == 600
    for name in ("pull_hauls", "pull_lengths"):
        spark.sql(f"DROP TABLE {name}")


def survey(spark, years):
    rows = [(y, a, None if (y + a) % 7 == 0 else float(y % 10 + a), None if a == 3 else 0.5 * a, None if (y, a) == (2002, 2) else a) for y in years for a in (1, 2, 3, 9, 30, 40)]
    return spark.createDataFrame(rows, "year int, area_id int, biomass_mt double, biomass_var double, n_haul int")


def test_a_new_year_is_read_alone_and_equals_the_full_run(spark, tmp_path):
    source, store = str(tmp_path / "source"), str(tmp_path / "store")
    seen = []

    def states(rows):
        seen.append(sorted(r.year for r in rows.select("year").distinct().collect()))
        return inc.trawl_states(S9)(rows)

    def put(df, mode="append"):
        df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(source)

    def same(years):
        got = inc.trawl_index_from(inc.current(spark, source, store), S9).collect()
        want = ix.trawl_index(survey(spark, years), S9).collect()
        assert sorted(map(tuple, got), key=str) == sorted(map(tuple, want), key=str)

    put(survey(spark, [2000, 2001]))
    assert inc.update(spark, source, store, states) == [2000, 2001]
    same([2000, 2001])
    put(survey(spark, [2002]))
    with pytest.raises(Exception, match="(?i)stale|nothing"):
        put(survey(spark, [2001]).limit(2), "overwrite")
        inc.current(spark, source, store).collect()
    put(survey(spark, [2001]), "overwrite")
    assert inc.update(spark, source, store, states) == [2001, 2002]
    same([2000, 2001, 2002])
    assert inc.update(spark, source, store, states) == [] and seen == [[2000, 2001], [2001, 2002]]
    # A year leaves the source.
    survey(spark, [2001, 2002]).write.mode("overwrite").partitionBy("year").parquet(source)
    assert inc.update(spark, source, store, states) == [2001, 2002]
    same([2001, 2002])


def test_length_states_equal_the_full_run(spark, tmp_path):
    source, store = str(tmp_path / "source"), str(tmp_path / "store")
    rows = spark.range(400).selectExpr("cast(2000 + id % 3 AS int) AS year", "'a' AS survey", "cast(id % 11 AS double) AS length", "IF(id % 13 = 0, NULL, cast(id % 5 AS double)) AS freq")
    rows.write.partitionBy("year").parquet(source)
    assert inc.update(spark, source, store, inc.length_states(["survey"])) == [2000, 2001, 2002]
    got = inc.length_comp_from(inc.current(spark, source, store), ["survey"]).collect()
    want = ln.length_comp_by_year(rows, ["survey"]).select(*got[0].asDict()).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
