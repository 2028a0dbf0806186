"""Spatial joins against brute force, with a third of all sites crowded into one spot."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellcast.operators import spatial as SP


@pytest.fixture(scope="module")
def world(spark):
    points = spark.range(0, 400).select("id", (F.rand(1) * 10 + 26).alias("lat"), (F.rand(2) * 12 - 106).alias("lon"))
    crowd = F.col("id") < 1500
    sites = spark.range(0, 4500).select(
        F.col("id").alias("sid"),
        F.when(crowd, F.rand(3) * 0.001 + 30).otherwise(F.rand(4) * 8 + 27).alias("slat"),
        F.when(crowd, F.rand(5) * 0.001 - 97).otherwise(F.rand(6) * 9 - 105).alias("slon"),
    )
    copies = sites.where("sid < 50").select((F.col("sid") + 10000).alias("sid"), "slat", "slon")
    return points.cache(), sites.unionByName(copies).cache()


def _km(a, b, c, d):
    p1, p2 = math.radians(a), math.radians(c)
    h = math.sin((p2 - p1) / 2) ** 2 + math.cos(p1) * math.cos(p2) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(h))


@pytest.mark.parametrize("metric", ["degree", "haversine"])
def test_nearest_equals_brute_force(world, metric):
    points, sites = world
    dist = (lambda a, b, c, d: math.hypot(a - c, b - d)) if metric == "degree" else _km
    spots = [(r["sid"], r["slat"], r["slon"]) for r in sites.collect()]
    got = {r["id"]: r for r in SP.nearest_join(points, sites, "lat", "lon", "slat", "slon", "sid", metric, leaf_sites=8).collect()}
    assert len(got) == 400
    for r in got.values():
        best = min(dist(r["lat"], r["lon"], a, o) for _, a, o in spots)
        assert r["distance"] == pytest.approx(best, rel=1e-6, abs=1e-6)


def test_radius_joins_equal_brute_force(world):
    points, sites = world
    spots = [(r["slat"], r["slon"]) for r in sites.collect()]
    kms = [5, 40, 300]
    got = SP.count_within(points, sites, "lat", "lon", "slat", "slon", "sid", kms, leaf_sites=8).collect()
    assert len(got) == 400
    far = {r["id"] for r in SP.exclude_within(points, sites, "lat", "lon", "slat", "slon", "sid", 12.0).collect()}
    for r in got:
        ds = [_km(r["lat"], r["lon"], a, o) for a, o in spots]
        assert [r[f"within_{k}"] for k in kms] == [sum(d <= k for d in ds) for k in kms]
        assert (r["id"] in far) == (min(ds) > 12.0)


def test_no_sites_and_null_places(spark):
    points = spark.createDataFrame([(1, 30.0, -97.0), (2, None, -97.0)], "id int, lat double, lon double")
    none = spark.createDataFrame([], "sid long, slat double, slon double")
    assert [r["site_id"] for r in SP.nearest_join(points, none, "lat", "lon", "slat", "slon", "sid").collect()] == [None, None]
    far = SP.distance_to_features(points, none, "lat", "lon", "slat", "slon", "sid")
    assert {r["distance_m"] for r in far.collect()} == {100000.0}


def test_plan_has_no_cross_join(world):
    points, sites = world
    df = SP.count_within(points, sites, "lat", "lon", "slat", "slon", "sid", [5])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_polygon_join(spark):
    points = spark.range(0, 500).select("id", (F.rand(1) * 4).alias("lat"), (F.rand(2) * 4).alias("lon"))
    square = "array(struct({x} as lon, {y} as lat), struct({x}+1.5D as lon, {y} as lat), struct({x}+1.5D as lon, {y}+1.5D as lat), struct({x} as lon, {y}+1.5D as lat))"
    polys = spark.sql(f"select 'a' as name, {square.format(x='0.2D', y='0.3D')} as ring union all select 'b', {square.format(x='1.1D', y='1.0D')}")
    got = {(r["id"], r["name"]) for r in SP.polygon_join(points, polys, "lat", "lon", "ring").collect()}
    want = {(r["id"], n) for r in points.collect() for n, x, y in (("a", 0.2, 0.3), ("b", 1.1, 1.0)) if x < r["lon"] < x + 1.5 and y < r["lat"] < y + 1.5}
    assert got == want


def test_places_off_the_globe_are_left_out(spark):
    points = spark.createDataFrame([(1, 30.0, -97.0), (2, 1e6, 5.0)], "id int, lat double, lon double")
    sites = spark.createDataFrame([(1, -1e7, 1e9), (2, 31.0, 263.0), (3, 40.0, -90.0)], "sid int, slat double, slon double")
    got = {r["id"]: r["site_id"] for r in SP.nearest_join(points, sites, "lat", "lon", "slat", "slon", "sid", "haversine").collect()}
    assert got == {1: 2, 2: None}


def test_a_crowded_spot_deepens_the_tree_only_there(spark):
    even = spark.range(20_000).select("id", (F.rand(1) * 40).alias("lat"), (F.rand(2) * 40).alias("lon"))
    spot = spark.range(500).select("id", (20 + F.rand(3) * 1e-9).alias("lat"), (20 + F.rand(4) * 1e-9).alias("lon"))
    tree = SP.site_tree(even.unionByName(spot), "lat", "lon", "id", "degree")
    levels = {r["lvl"]: r["n"] for r in tree.spots.groupBy("lvl").agg(F.count("*").alias("n")).collect()}
    assert sum(levels.values()) == 20_500 and max(levels) == tree.depth > 12
    assert sum(n for lvl, n in levels.items() if lvl > 6) < 570
    assert tree.spots.groupBy("lvl", "lty", "ltx").count().agg(F.max("count")).first()[0] <= SP.LEAF_SITES
    points = even.where("id < 40").unionByName(spot.where("id < 10"))
    near = SP.nearest_join(points, even.unionByName(spot), "lat", "lon", "lat", "lon", "id")
    assert near.where("distance <> 0").count() == 0 and near.count() == 50


def test_degrees_need_no_globe(spark):
    sites = [(i, 1000.0 * (i % 30), 250_000.0 + 700 * (i // 30)) for i in range(900)] + [(1000, float("nan"), 0.0), (1001, None, 1.0)]
    sites = spark.createDataFrame(sites, "sid long, y double, x double")
    points = spark.createDataFrame([(1, 10_400.0, 250_000.0), (2, 29_000.0, 1e7), (3, float("inf"), 0.0)], "id int, y double, x double")
    got = {r["id"]: r for r in SP.nearest_join(points, sites, "y", "x", "y", "x", "sid").collect()}
    assert (got[1]["site_id"], got[1]["distance"]) == (10, 400.0)
    assert got[2]["site_id"] == 899 and got[3]["site_id"] is None


def _holds(ring, lat, lon):
    """Even-odd rule over all edges of one ring."""
    odd = np.zeros(len(lat), bool)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if y1 != y2:
            odd ^= ((y1 > lat) != (y2 > lat)) & (lon < (x2 - x1) * (lat - y1) / (y2 - y1) + x1)
    return odd


def _rings():
    rng = np.random.default_rng(5)
    turn = np.sort(rng.uniform(0, 2 * np.pi, 20_000))
    coast = 8 + np.cos(5 * turn) + rng.normal(0, 0.02, len(turn))
    zigzag = [(float(rng.uniform(-3, 3)), float(rng.uniform(40, 44))) for _ in range(60)]
    return {
        "coast": list(zip((coast * np.cos(turn)).tolist(), (coast * np.sin(turn)).tolist())),
        "zigzag": zigzag,
        "grid": [(0.0, 40.0), (2.0, 40.0), (2.0, 41.0), (1.0, 41.0), (1.0, 42.0), (2.0, 42.0), (2.0, 44.0), (0.0, 44.0)],
        "needle": [(-10.0, -10.0), (10.0, -10.0), (10.0, -9.999)],
        "tiny": [(3.0, 3.0), (3.0 + 1e-7, 3.0), (3.0, 3.0 + 1e-7)],
        "bowtie": [(-2.0, -2.0), (2.0, 2.0), (2.0, -2.0), (-2.0, 2.0)],
        "flat": [(0.0, 1.0), (1.0, 1.0), (2.0, 1.0)],
        "pair": [(0.0, 0.0), (1.0, 1.0)],
        "spot": [(5.0, 5.0)] * 4,
    }


def test_polygon_join_equals_the_rule_over_whole_rings(spark):
    rings = _rings()
    rng = np.random.default_rng(6)
    lat = np.concatenate([rng.uniform(-11, 11, 6000), rng.uniform(39, 45, 3000), 3 + rng.uniform(0, 1e-7, 50), np.repeat([40.0, 41.0, 42.0, -2.0], 9), rng.uniform(-10, -9.99, 500)])
    lon = np.concatenate([rng.uniform(-11, 11, 6000), rng.uniform(-4, 4, 3000), 3 + rng.uniform(0, 1e-7, 50), np.tile(np.arange(-4, 5) / 2.0, 4), rng.uniform(-10, 10, 500)])
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(lat.tolist(), lon.tolist()))]
    points = spark.createDataFrame(rows + [(-1, None, 1.0), (-2, float("nan"), 1.0), (-3, 1.0, float("inf"))], "id long, lat double, lon double")
    shapes = [(name, [{"lon": x, "lat": y} for x, y in ring]) for name, ring in rings.items()]
    shapes += [("none", None), ("empty", []), ("gaps", [*shapes[2][1][:3], {"lon": None, "lat": 1.0}, {"lon": float("nan"), "lat": 1.0}, *shapes[2][1][3:]])]
    polys = spark.createDataFrame(shapes, "name string, ring array<struct<lon: double, lat: double>>")
    got = {(r["id"], r["name"]) for r in SP.polygon_join(points, polys, "lat", "lon", "ring").collect()}
    want = {(int(i), name) for name, ring in rings.items() for i in np.flatnonzero(_holds(ring, lat, lon))}
    want |= {(i, "gaps") for i, name in want if name == "grid"}
    assert got == want and {name for _, name in want} >= {"coast", "zigzag", "grid", "needle", "tiny", "bowtie", "gaps"}
    # repeated polygons and points stay apart
    twice = SP.polygon_join(points.unionByName(points), polys.unionByName(polys), "lat", "lon", "ring")
    assert twice.count() == 4 * len(want)
    assert SP.polygon_join(points, polys.where("name = 'none'"), "lat", "lon", "ring").count() == 0


def test_tiles_of_a_short_ring_reach_little_beyond_it(spark):
    ring = [{"lon": x, "lat": y} for x, y in [(30.0, 10.7), (30.7, 10.0), (30.0, 9.3), (29.3, 10.0)]]
    polys = spark.createDataFrame([("diamond", ring)], "name string, ring array<struct<lon: double, lat: double>>")
    tiles = SP.polygon_tiles(polys, "ring")
    got = tiles.agg(F.sum(F.pow(F.lit(4.0), "_k")).alias("area"), F.count("*").alias("tiles"), F.count(F.when(F.size("edges") == 0, 1)).alias("whole")).first()
    assert got["area"] < 3 * 0.98 and got["tiles"] < 3 * SP.FEWEST_TILES and got["whole"] > 0


def test_a_long_ring_costs_a_point_the_edges_of_one_tile(spark):
    ring = [{"lon": x, "lat": y} for x, y in _rings()["coast"]]
    polys = spark.createDataFrame([("coast", ring)], "name string, ring array<struct<lon: double, lat: double>>")
    tiles = SP.polygon_tiles(polys, "ring").select(F.size("edges").alias("n"))
    got = tiles.agg(F.count("*").alias("tiles"), F.sum("n").alias("edges"), F.max("n").alias("most")).first()
    assert got["tiles"] < 5 * len(ring) and got["edges"] < 5 * len(ring) and got["most"] < len(ring) / 50


def test_tiles_in_metres(spark):
    tiles = [(f"t{i}", 5e6 + 1e5 * i, 5e6 + 1e5 * (i + 1), 0.0, 1e5) for i in range(5)] + [("small", 5e6, 5e6 + 0.5, 0.0, 0.5), ("turned", 9.0, 1.0, 0.0, 1.0)]
    tiles = spark.createDataFrame(tiles, "tile string, left double, right double, bottom double, top double")
    points = spark.createDataFrame([(1, 5e6 + 0.25, 0.25), (2, 5.15e6, 7e4), (3, 5.2e6, 1e5), (4, 4e6, 0.0), (5, None, 1.0)], "id int, x double, y double")
    got = {r["id"]: r["tile"] for r in SP.point_in_tile(points, tiles, "x", "y").collect()}
    assert got == {1: "small", 2: "t1", 3: "t1", 4: None, 5: None}


def test_counted_points_are_spread_over_the_last_join(spark, monkeypatch):
    seen = []
    join = type(spark.range(1)).join

    def watched(left, right, on=None, how=None):
        if isinstance(on, list) and on == ["lvl", "lty", "ltx"]:
            seen.append(left)
        return join(left, right, on, how)

    points = spark.range(0, 300).select("id", (F.rand(1) + 30).alias("lat"), (F.rand(2) - 97).alias("lon"))
    monkeypatch.setattr(type(points), "join", watched)
    got = SP.count_within(points, points, "lat", "lon", "lat", "lon", "id", [500])
    monkeypatch.undo()
    assert {r["within_500"] for r in got.collect()} == {300}
    walk = seen[0]
    assert walk.where("lvl is null or lty is null or ltx is null").count() == 0
    assert walk.groupBy("lvl", "lty", "ltx").count().agg(F.max("count")).first()[0] <= 3


def _boxes(n, seed, width):
    rng = np.random.default_rng(seed)
    x, y = rng.uniform(0, 4, n), rng.uniform(0, 4, n)
    w, h = rng.uniform(0.2, 1, n) * width, rng.uniform(0.2, 1, n) * width
    return [(f"t{i:05d}", float(x[i]), float(x[i] + w[i]), float(y[i]), float(y[i] + h[i])) for i in range(n)]


def test_crowded_tiles_equal_brute_force_and_leave_few_to_a_square(spark):
    shape = "tile string, left double, right double, bottom double, top double"
    boxes = _boxes(3000, 3, 1.5) + [(f"s{i}", 9.0, 9.5, 9.0, 9.5) for i in range(500)] + [("n", None, 1.0, 0.0, 1.0), ("line", 8.0, 8.0, 0.0, 3.0)]
    rng = np.random.default_rng(4)
    spots = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.uniform(-0.5, 6, (400, 2)))]
    spots += [(1000 + i, b[1], b[4]) for i, b in enumerate(boxes[:200])] + [(2000, 9.2, 9.5), (2001, 8.0, 1.5), (2002, None, 1.0)]
    tiles, points = spark.createDataFrame(boxes, shape), spark.createDataFrame(spots, "id int, x double, y double")
    got = {r["id"]: r["tile"] for r in SP.point_in_tile(points, tiles, "x", "y").collect()}
    for i, x, y in spots:
        holds = [t for t, a, b, c, d in boxes if None not in (x, a) and a - 1e-9 <= x <= b + 1e-9 and c - 1e-9 <= y <= d + 1e-9]
        assert got[i] == min(holds, default=None)
    squares = SP.tile_squares(tiles)
    assert squares.where("left = 9.0").select("tile").distinct().count() == 1
    per = squares.where("left < 5").groupBy("_k", "_ty", "_tx").count()
    every = tiles.where("left < 5").count()
    assert per.agg(F.avg("count")).first()[0] < every / 50
