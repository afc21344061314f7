import math
import random

import pytest
from pyspark.sql import functions as F

from shoalmark.functions import geo
from shoalmark.functions.cover import cover
from shoalmark.operators import spatial as sp
from shoalmark.sources.readers import scan_polygons, with_bounds

RING = [(-165.0, 53.0), (-150.0, 53.0), (-158.0, 55.5), (-150.0, 58.0), (-165.0, 58.0)]
BOX = [(-160.0, 56.0), (-140.0, 56.0), (-140.0, 60.0), (-160.0, 60.0)]


def inside(x, y, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < (bx - ax) * ((y - ay) / (by - ay)) + ax:
            odd = not odd
    return odd


def on_edge(x, y, ring):
    def on(a, b):
        straight = (b[0] - a[0]) * (y - a[1]) == (b[1] - a[1]) * (x - a[0])
        return straight and min(a[0], b[0]) <= x <= max(a[0], b[0]) and min(a[1], b[1]) <= y <= max(a[1], b[1])

    return any(on(a, b) for a, b in zip(ring, ring[1:] + ring[:1]))


def inside_rings(x, y, rings):
    return sum(inside(x, y, r) for r in rings) % 2 == 1 or any(on_edge(x, y, r) for r in rings)


def layer(spark, polys):
    rows = [(k, None if rings is None else [[{"x": x, "y": y} for x, y in r] for r in rings]) for k, rings in polys.items()]
    return with_bounds(spark.createDataFrame(rows, "poly_id string, rings array<array<struct<x: double, y: double>>>"))


def wavy(cx, cy, radius, n, seed):
    """A ring of many short edges."""
    rnd = random.Random(seed)
    turn = [2 * math.pi * i / n for i in range(n)]
    far = [radius * (0.9 + 0.1 * math.sin(7 * t)) * rnd.uniform(0.999, 1.0) for t in turn]
    return [(cx + f * math.cos(t), cy + f * math.sin(t)) for f, t in zip(far, turn)]


@pytest.mark.parametrize(("few", "divisions"), [(16, 4), (1, 3), (1, 0)])
def test_membership_equals_plain_loop(spark, few, divisions):
    rnd = random.Random(1)
    polys = {
        "a": [RING], "b": [BOX + BOX[:1]],
        "holes": [wavy(-145, 55, 6, 400, 2), wavy(-145, 55, 4, 300, 3), wavy(-145, 55, 2, 200, 4), wavy(-132, 55, 1, 50, 5)],
        "none": None, "empty": [], "no vertex": [[]], "point": [[(-150.5, 60.5)]], "line": [[(-150.0, 61.0), (-149.0, 61.0)]],
        "gap": [[(-139.0, 61.0), (None, 61.5), (-138.0, 61.0), (-138.0, 62.0), (float("nan"), 0.0)]],
    }
    # Most of the points fall in one small place, many are the same.
    pts = [(i, rnd.uniform(-158.9, -158.1), rnd.uniform(55.1, 55.9)) for i in range(1000)]
    pts += [(1000 + i, rnd.uniform(-170, -130), rnd.uniform(48, 63)) for i in range(4000)]
    pts += [(5000 + i, -145.0, 55.0) for i in range(500)] + [(5500, None, 55.0), (5501, -145.0, None), (5502, float("nan"), 55.0)]
    places = [v for rings in polys.values() for r in rings or [] for v in r if None not in v and v[0] == v[0]]
    places += [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in zip(BOX, BOX[1:])] + [(-149.5, 61.0), (-138.5, 61.0)]
    pts += [(6000 + i, x, y) for i, (x, y) in enumerate(places)]
    df = spark.createDataFrame(pts, "id int, lon double, lat double")
    got = [r.id for r in sp.points_in_strata(df, layer(spark, polys), few=few, divisions=divisions).collect()]
    clean = {k: [[v for v in r if None not in v and v[0] == v[0]] for r in rings or []] for k, rings in polys.items()}
    known = [p for p in pts if p[1] is not None and p[2] is not None and p[1] == p[1]]
    want = [i for i, x, y in known if any(inside_rings(x, y, [r for r in rings if r]) for rings in clean.values())]
    assert sorted(got) == want and len(got) == len(set(got)) and len(want) > 1500


def test_one_large_polygon_and_many_small_ones(spark):
    rnd = random.Random(3)
    small = {}
    for i in range(10_000):
        x, y = rnd.uniform(0, 1000), rnd.uniform(0, 1000)
        small[f"s{i}"] = [[(x, y), (x + 1.5, y), (x + 1.5, y + 1.5), (x, y + 1.5)]]
    large = {"large": [wavy(500, 500, 400, 2000, 9), wavy(500, 500, 250, 500, 8)]}
    polys = layer(spark, {**small, **large})
    pts = [(i, rnd.uniform(0, 1001), rnd.uniform(0, 1001)) for i in range(3000)]
    df = spark.createDataFrame(pts, "id int, lon double, lat double")
    boxes = [(r[0][0][0], r[0][0][1]) for r in small.values()]
    want = [
        i for i, x, y in pts
        if inside_rings(x, y, large["large"]) or any(bx <= x <= bx + 1.5 and by <= y <= by + 1.5 for bx, by in boxes)
    ]
    assert sorted(r.id for r in sp.points_in_strata(df, polys).collect()) == want
    cells = cover(polys).groupBy("poly_id", "inside").agg(F.count("*").alias("n"), F.max(F.size("edges")).alias("edges")).collect()
    by = {(r.poly_id, r.inside): (r.n, r.edges) for r in cells}
    # Few cells, most of them inside; a point in one of the others meets a small part of the 2500 edges.
    assert 300 < by["large", True][0] < 4000 and by["large", False][0] < 4000 and by["large", False][1] < 250, by["large", False]
    assert all(n <= 4 for (k, _), (n, _) in by.items() if k != "large")


def test_projected_edges_follow_the_straight_ones_in_degrees(spark):
    # A parallel bends in the projection: halfway its projected ends lie kilometres off.
    ring = [(-170.0, 55.0), (-140.0, 55.0), (-140.0, 60.0), (-170.0, 60.0)]
    pts = [(1, -155.0, 55.01), (2, -155.0, 54.99), (3, -155.0, 59.99), (4, -155.0, 60.01)]
    df = sp.project_albers(spark.createDataFrame(pts, "id int, lon double, lat double"))
    polys = layer(spark, {"a": [ring]})
    ids = lambda step: sorted(r.id for r in sp.points_in_strata(df, sp.project_rings(polys, step=step), x="x", y="y").collect())
    assert ids(0.05) == [1, 3] and ids(100.0) != [1, 3]


def test_files_with_one_ring_a_polygon_are_read(spark, tmp_path):
    old = spark.createDataFrame([("a", [{"x": 0.0, "y": 1.0}, {"x": 2.0, "y": 3.0}])], "poly_id string, ring array<struct<x: double, y: double>>")
    old.write.parquet(str(tmp_path / "old"))
    row = scan_polygons(spark, str(tmp_path / "old")).first()
    assert (len(row.rings), row.xmin, row.xmax, row.ymin, row.ymax) == (1, 0.0, 2.0, 1.0, 3.0)


@pytest.mark.parametrize(
    "lon,lat,x,y",
    [
        (-154.0, 50.0, 0.0, 0.0),
        (-150.0, 58.0, 235680.078, 895823.605),
        (-165.0, 53.0, -737371.432, 393034.397),
        (-140.0, 59.5, 784197.717, 1139343.465),
    ],
)
def test_projection_anchors(spark, lon, lat, x, y):
    r = sp.project_albers(spark.createDataFrame([(lon, lat)], "lon double, lat double")).collect()[0]
    assert (r.x, r.y) == (pytest.approx(x, abs=2e-3), pytest.approx(y, abs=2e-3))


def test_cells(spark):
    r = sp.square_cells(spark.createDataFrame([(0.0, 100.0)], "x double, y double")).collect()[0]
    corners = [(p.x, p.y) for p in r.ring]
    assert corners == [(-1e4, -9900.0), (1e4, -9900.0), (1e4, 10100.0), (-1e4, 10100.0), (-1e4, -9900.0)]


def test_stations(spark):
    bts = spark.createDataFrame(
        [
            (30020, 2021, 1, "WESTERN GOA - INPFC", 2.0, 55.0, 56.0, -160.0, -161.0),
            (30020, 2021, 1, "WESTERN GOA - INPFC", 3.0, 57.0, 58.0, -160.0, -161.0),
            (30020, 2021, 2, None, None, 57.0, 58.0, -160.0, -161.0),
        ],
        "species_code int, year int, hauljoin long, regulatory_area string, count double, latitude_dd_start double, "
        "latitude_dd_end double, longitude_dd_start double, longitude_dd_end double",
    )
    lls = spark.createDataFrame(
        [
            (30020, 2021, "Bering Sea", "slope", 5, 1.0),
            (30020, 2021, None, "slope", 6, None),
            (30020, 2021, "Central Gulf of Alaska", None, 7, 1.0),
            (30020, 2021, "Central Gulf of Alaska", "Shallow cross-shelf gully", 7, 1.0),
            (30020, 2021, "West Yakutat", "slope", 500, 1.0),
            (30020, 2021, "West Yakutat", "slope", 499, 4.0),
        ],
        "species_code int, year int, council_sablefish_management_area string, habitat_type string, station_number int, catch_freq double",
    )
    for c in ("start_latitude", "end_latitude", "start_longitude", "end_longitude"):
        lls = lls.withColumn(c, F.lit(50.0))
    got = {(r.survey, r.region, r.station): (r["catch"], r.lat, r.present) for r in sp.station_catch(bts, lls).collect()}
    assert got == {
        ("BTS", "WGOA", 1): (5.0, 56.5, True),
        ("BTS", "CGOA", 2): (None, 57.5, None),
        ("LLS", None, 6): (0.0, 50.0, False),
        ("LLS", "EGOA", 499): (4.0, 50.0, True),
    }


def test_observer_cells(spark):
    obs = spark.createDataFrame(
        [(2023, 1.0, 2.0, "POT", "t", 500.0), (2023, 1.0, 2.0, "LGL", "t", 500.0), (2023, 1.0, 2.0, None, "t", 1.0), (2022, 1.0, 2.0, "POT", "t", 9.0), (2023, 1.0, 2.0, "POT", "u", 9.0)],
        "year int, lat double, lon double, gear string, species string, kg double",
    )
    assert {(r.gear, r.weight) for r in sp.gear_cell_catch(obs, "t").collect()} == {("Fixed", 1.0), ("Trawl", 0.001)}


def test_points_on_edges_and_corners_are_inside(spark):
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]
    ring = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in square])
    on = [(1.0, 0.5), (0.5, 1.0), (1.0, 1.0), (0.0, 0.5), (0.5, 0.0), (0.0, 0.0), (0.5, 0.5)]
    off = [(1.0000001, 0.5), (2.0, 1.0), (0.5, -0.1)]
    pts = spark.createDataFrame([(x, y, True) for x, y in on] + [(x, y, False) for x, y in off], "x double, y double, inside boolean")
    assert all(r.inside == r.got for r in pts.withColumn("got", geo.in_ring("x", "y", ring)).collect())
