import math

import pytest
from pyspark.sql import functions as F

from cellcast.functions import cells, geo, scalars, timefn, weather


@pytest.mark.parametrize(
    "day,hhmm,state,fips,instant,window",
    [
        ("2018-11-08", "1430", "TX", "48001", "2018-11-08 20:30:00", 18),
        ("2019-07-04", "0300", "CA", None, "2019-07-04 10:00:00", 6),
        ("2018-11-04", "0130", "TX", "48001", "2018-11-04 07:30:00", 6),
        ("2018-03-11", "0230", "TX", "48001", "2018-03-11 08:30:00", 6),
        ("2018-06-01", None, "TX", "48141", "2018-06-01 18:00:00", 18),
        ("2018-12-31", "2000", "TX", "48001", "2019-01-01 02:00:00", 0),
        ("2018-06-01", "x", "TX", "48001", "2018-06-01 17:00:00", 12),
        ("2018-06-01", "2575", "TX", "48001", "2018-06-02 04:59:00", 0),
        ("garbage", "1200", "TX", "48001", None, None),
        ("2018-06-01 11:22", "nan", "CA", None, "2018-06-01 19:00:00", 18),
    ],
)
def test_local_time_to_utc_window(spark, day, hhmm, state, fips, instant, window):
    df = spark.createDataFrame([(day, hhmm, state, fips)], "d string, t string, s string, f string")
    u = timefn.local_to_utc("d", "t", timefn.tz_of("s", "f"))
    row = df.select(u.alias("u")).select(F.date_format("u", "yyyy-MM-dd HH:mm:ss").alias("i"), timefn.utc_window("u")["window_hour"].alias("w")).first()
    assert (row["i"], row["w"]) == (instant, window)


def test_decode_masks_before_scaling_and_clamps_after(spark):
    df = spark.createDataFrame([(32767,), (100,), (95000,)], "raw int")
    got = [r[0] for r in df.select(weather.decode_grid("raw", F.lit(32767), F.lit(0.1), F.lit(0.0))).collect()]
    assert got == [None, 10.0, None]


def test_physical_scale(spark):
    rows = [("NDVI", 5000.0), ("EVI", 0.4), ("LST", 15000.0), ("LST", 300.0), ("LST", 20.0), ("Temperature", 300.0), ("Wind", 300.0), ("LST", float("nan"))]
    got = [r[0] for r in spark.createDataFrame(rows, "l string, v double").select(weather.physical_scale("l", "v")).collect()]
    want = [0.5, 0.4, 26.85, 26.85, 20.0, 26.85, 300.0]
    assert got[:-1] == pytest.approx(want) and got[-1] is None


def test_weather_formulas_match_plain_math(spark):
    rows = [(30.0, 5.0, 10.0), (25.0, 30.0, 3.0), (10.0, 80.0, 0.5), (40.0, 100.0, 20.0)]
    df = spark.createDataFrame(rows, "t double, rh double, w double")
    got = df.select(weather.vpd("t", "rh").alias("vpd"), weather.ffwi("t", "rh", "w").alias("ffwi")).collect()
    for (t, rh, w), r in zip(rows, got):
        svp = 0.61078 * math.exp(17.27 * t / (t + 237.3))
        assert r["vpd"] == pytest.approx(max(svp * (1 - rh / 100), 0))
        tf, mph = t * 1.8 + 32, w * 2.23694
        if rh < 10:
            m = 0.03229 + 0.281073 * rh - 0.000578 * rh * tf
        elif rh <= 50:
            m = 2.22749 + 0.160107 * rh - 0.014784 * tf
        else:
            m = 21.0606 + 0.005531 * rh**2 - 0.100276 * rh - 0.001436 * rh * tf
        x = m / 30
        n = 0 if m > 30 else 1 - 2 * x + 1.5 * x**2 - 0.5 * x**3
        assert r["ffwi"] == pytest.approx(min(max(n * math.sqrt(1 + mph**2) / 0.3002, 0), 100))


def test_cells_round_trip_within_the_edge(spark):
    df = spark.range(0, 20000).select(
        (F.rand(1) * 10.66 + 25.84).alias("lat"), (F.rand(2) * 13.14 - 106.65).alias("lon")
    )
    for res in (4, 8):
        ids = df.withColumn("cell", cells.cell_id("lat", "lon", res))
        clat, clon = cells.cell_center("cell", digits=None, res=res)
        dx = (F.col("lon") - clon) * cells._scale(31.0)
        dy = (F.col("lat") - clat) * cells.KM_PER_DEG
        worst = ids.select(F.sqrt(dx * dx + dy * dy).alias("d")).agg(F.max("d")).first()[0]
        assert worst <= cells.EDGE_KM[res] * (1 + 1e-9)
        again = ids.select("cell", cells.cell_id(clat, clon, res).alias("back")).where("cell <> back").count()
        assert again == 0
        assert ids.select(cells.cell_resolution("cell")).distinct().collect()[0][0] == res


def test_boundary_corners_are_one_edge_away(spark):
    df = spark.createDataFrame([(30.0, -97.0)], "lat double, lon double").select(cells.cell_id("lat", "lon", 5).alias("cell"))
    row = df.select(cells.cell_boundary("cell").alias("b"), *[c.alias(n) for n, c in zip(("la", "lo"), cells.cell_center("cell"))]).first()
    for v in row["b"]:
        d = math.hypot((v["lat"] - row["la"]) * cells.KM_PER_DEG, (v["lon"] - row["lo"]) * cells._scale(31.0))
        assert d == pytest.approx(cells.EDGE_KM[5], rel=1e-4)


def test_polygon_literal_and_column_agree(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    df = spark.range(0, 3000).select((F.rand(3) * 6 - 1).alias("lat"), (F.rand(4) * 6 - 1).alias("lon"))
    lit = F.array(*[F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ring])
    both = df.select(geo.in_polygon("lat", "lon", ring).alias("a"), geo.in_ring("lat", "lon", lit).alias("b"))
    assert both.where("a <> b").count() == 0
    assert 0 < both.where("a").count() < 3000


def test_scalars(spark):
    df = spark.createDataFrame([("7", "NaN"), ("x", "1.5")], "a string, b string")
    assert [tuple(r) for r in df.select(scalars.to_number("a"), scalars.to_number("b")).collect()] == [(7.0, None), (None, 1.5)]
    long = spark.createDataFrame([("a" * 81,), ("b" * 80,)], "s string").select(scalars.truncate_example("s")).collect()
    assert long[0][0] == "a" * 77 + "..." and long[1][0] == "b" * 80
    row = spark.createDataFrame([("1,bad,hi",)], "l string").select(scalars.parse_row("l", "a int, b double, c string").alias("r")).first()["r"]
    assert tuple(row) == (1, 0.0, "hi")
    bands = spark.createDataFrame([(0.8,), (0.79,), (0.2,), (0.1,), (None,)], "s double").select(scalars.risk_band("s")).collect()
    assert [b[0] for b in bands] == ["CRITICAL", "HIGH", "LOW-MEDIUM", "LOW", None]


def test_seasons(spark):
    df = spark.range(1, 13)
    got = [tuple(r) for r in df.select(timefn.season_code("id"), timefn.season_name("id"), timefn.peak_flag("id")).collect()]
    assert [g[0] for g in got] == [0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 0]
    assert got[11][1] == "Winter" and [m + 1 for m, g in enumerate(got) if g[2]] == [2, 3, 4, 10, 11]


def test_reprojection_origin(spark):
    df = spark.createDataFrame([(23.0, -96.0)], "lat double, lon double")
    x, y = geo.reproject("lat", "lon", "albers")
    row = df.select(x.alias("x"), y.alias("y")).first()
    assert row["x"] == pytest.approx(0, abs=1e-6) and row["y"] == pytest.approx(0, abs=1e-6)
