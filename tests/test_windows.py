import datetime as dt

import pytest
from pyspark.sql import functions as F

from cellcast.operators import windows as W


def test_trailing_calendar_days(spark):
    d = dt.date
    rows = [(1, d(2014, 12, 28), 100.0)] + [(1, d(2014, 12, 29) + dt.timedelta(i), float(i)) for i in range(5)] + [(1, d(2015, 1, 3), 99.0), (2, d(2015, 5, 1), 4.0), (2, d(2015, 5, 4), float("nan"))]
    w = spark.createDataFrame(rows, "px int, d date, erc double")
    asked = spark.createDataFrame([(1, d(2015, 1, 3)), (2, d(2015, 5, 5)), (2, d(2015, 9, 9)), (3, d(2015, 1, 1))], "px int, d date")
    got = {(r["px"], r["d"]): (r["erc_5D_mean"], r["erc_5D_max"]) for r in W.trailing_stats(w, asked, "px", "d", {"erc": ("mean", "max")}).collect()}
    assert got == {(1, d(2015, 1, 3)): (2.0, 4.0), (2, d(2015, 5, 5)): (4.0, 4.0), (2, d(2015, 9, 9)): (None, None), (3, d(2015, 1, 1)): (None, None)}


def test_trailing_equals_range_join_over_chunk_borders(spark):
    days = spark.range(0, 400).select(F.lit(1).alias("px"), F.date_add(F.lit("2014-01-01").cast("date"), F.col("id").cast("int")).alias("d"), F.rand(3).alias("v")).where("v > 0.3").cache()
    asked = spark.range(0, 400).select(F.lit(1).alias("px"), F.date_add(F.lit("2014-01-02").cast("date"), F.col("id").cast("int")).alias("d"))
    got = {r["d"]: r["v_5D_mean"] for r in W.trailing_stats(days, asked, "px", "d", {"v": ("mean",)}).collect()}
    have = {r["d"]: r["v"] for r in days.collect()}
    for day, mean in got.items():
        past = [have[day - dt.timedelta(k)] for k in range(1, 6) if day - dt.timedelta(k) in have]
        assert mean == (pytest.approx(sum(past) / len(past)) if past else None)


def test_ignition_label(spark):
    df = spark.createDataFrame([(1, t, b) for t, b in enumerate([0, 0, 0, 1, 0])], "px int, t int, b int")
    got = [(r["ignition"], r["exclude"]) for r in W.ignition_label(df, "px", "t", "b").orderBy("t").collect()]
    assert got == [(0, 0), (1, 0), (1, 0), (None, 1), (None, 1)]


def test_fills(spark):
    df = spark.createDataFrame([(1, t, v) for t, v in enumerate([None, 1.0, None, 3.0, None])] + [(2, 0, None)], "px int, t int, v double")
    got = [r["v"] for r in W.impute_series(df, "px", "t", ["v"]).orderBy("px", "t").collect()]
    assert got == [1.0, 1.0, 1.0, 3.0, 3.0, 0.0]
    assert [r["v"] for r in W.impute_bands(df, ["v"]).orderBy("px", "t").collect()] == [2.0, 1.0, 2.0, 3.0, 2.0, 2.0]


def test_kelvin_only_for_hot_batches(spark):
    df = spark.createDataFrame([("tmmx", 1, 300.0), ("tmmx", 1, 290.0), ("tmmx", 2, 25.0), ("vs", 1, 300.0), ("tmmx", 1, None)], "var string, date int, value double")
    got = {(r["var"], r["date"], None if r["value"] is None else round(r["value"], 2)) for r in W.kelvin_to_c(df).collect()}
    assert got == {("tmmx", 1, 26.85), ("tmmx", 1, 16.85), ("tmmx", 2, 25.0), ("vs", 1, 300.0), ("tmmx", 1, None)}


def test_focal_matches_numpy_form(spark):
    import numpy as np

    z = np.round(np.random.default_rng(1).normal(100, 20, (7, 9)), 2)
    z[:, 5] = z[0, 5]
    df = spark.createDataFrame([(r, c, float(z[r, c])) for r in range(7) for c in range(9)], "row int, col int, z double")
    got = {(r["row"], r["col"]): r for r in W.focal_3x3(df, "z", 30.0).collect()}
    dy, dx = np.gradient(z, 30.0)
    slope, aspect = np.degrees(np.arctan(np.sqrt(dx**2 + dy**2))), np.arctan2(dy, -dx)
    for (r, c), g in got.items():
        near = [z[i, j] - z[r, c] for i in range(max(r - 1, 0), min(r + 2, 7)) for j in range(max(c - 1, 0), min(c + 2, 9)) if (i, j) != (r, c)]
        want = (slope[r, c], np.sin(aspect[r, c]), np.cos(aspect[r, c]), np.sqrt(np.mean(np.square(near))))
        assert (g["slope"], g["aspect_sin"], g["aspect_cos"], g["tri"]) == pytest.approx(want, abs=1e-9)


def test_flat_ground_aspect(spark):
    df = spark.createDataFrame([(r, c, 5.0) for r in range(3) for c in range(3)], "row int, col int, z double")
    got = W.focal_3x3(df, "z", 30.0).first()
    assert (got["slope"], got["aspect_cos"]) == (0.0, -1.0)
