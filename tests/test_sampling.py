import datetime as dt

import pytest
from pyspark.sql import functions as F

from cellcast.functions.geo import haversine_km
from cellcast.operators import sampling as N

DAY = dt.date(2018, 5, 1)


def _pos(spark, cells):
    return spark.createDataFrame([(c, DAY, 6) for c in cells], "cell long, date_utc date, window_hour int")


def _grid(spark, n):
    return spark.range(0, n).select((F.col("id") * 10).alias("cell"), F.col("id").alias("idx"))


@pytest.mark.parametrize(
    "cells,n,ratio,expected",
    [([70, 70], 25, 10, 20), ([0], 10, 10, 0), ([0, 0, 0], 25, 10, 24), ([0, 10, 20], 25, 10, 22), ([999], 25, 10, 10)],
)
def test_slot_sizes(spark, cells, n, ratio, expected):
    got = [r["cell"] for r in N.day_matched_negatives(_pos(spark, cells), _grid(spark, n), ratio).collect()]
    assert len(got) == len(set(got)) == expected and not set(got) & set(cells)


def test_hot_slot_spans_blocks_and_ignores_partitioning(spark):
    grid = _grid(spark, 50000)
    hot = spark.range(0, 3000).select((F.col("id") * 10).alias("cell"), F.lit(DAY).alias("date_utc"), F.lit(6).alias("window_hour"))
    rest = spark.range(0, 500).select((F.col("id") * 70).alias("cell"), F.date_add(F.lit(DAY), (F.col("id") % 90).cast("int") + 1).alias("date_utc"), F.lit(12).alias("window_hour"))
    pos = hot.unionByName(rest)
    one = N.day_matched_negatives(pos, grid, 10).cache()
    per = {r["date_utc"]: r["n"] for r in one.groupBy("date_utc").agg(F.count("cell").alias("n"), F.countDistinct("cell").alias("d")).where("n = d").collect()}
    want = {r["date_utc"]: r["n"] * 10 for r in pos.groupBy("date_utc").agg(F.count("cell").alias("n")).collect()}
    assert per == want and per[DAY] == 30000
    assert one.join(pos, ["cell", "date_utc", "window_hour"], "left_semi").count() == 0
    two = N.day_matched_negatives(pos.repartition(3), grid.repartition(5), 10)
    assert one.exceptAll(two).count() == 0


@pytest.mark.parametrize("size", [1, 2, 7, 1000, 4999])
def test_permutation_is_one_to_one(spark, size):
    order = N.Permutation(size)
    assert size <= order.places < size + order.rows
    rows = spark.range(0, order.places).select("id", order.at(F.col("id"), F.lit("k")).alias("place"))
    rows = rows.withColumn("back", order.step_of(F.col("place"), F.lit("k"))).collect()
    assert sorted(r["place"] for r in rows) == list(range(order.places))
    assert all(r["id"] == r["back"] for r in rows)


@pytest.mark.parametrize("size", [(1 << 30) - 24, 1073741800 * 5, 10**13, (1 << 62) - 3])
def test_permutation_spreads_evenly_over_large_sizes(spark, size):
    order = N.Permutation(size)
    rows = spark.range(0, 40000).select("id", order.at(F.col("id"), F.lit(42)).alias("place"))
    rows = rows.withColumn("ok", order.step_of(F.col("place"), F.lit(42)) == F.col("id"))
    tenth = F.floor(F.col("place").cast("double") * 10 / order.places)
    found = rows.groupBy(tenth.alias("tenth")).agg(F.count("id").alias("n"), F.countDistinct("place").alias("d"), F.every("ok").alias("ok")).collect()
    assert len(found) == 10 and all(r["ok"] and r["n"] == r["d"] and 3700 < r["n"] < 4300 for r in found)
    steps = [r["place"] for r in rows.orderBy("id").limit(500).collect()]
    assert len({b - a for a, b in zip(steps, steps[1:])}) > 490  # no fixed stride


def test_hyper_negatives(spark):
    grid = _grid(spark, 300)
    dates = spark.range(0, 20).select(F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("date_utc"), F.col("id").alias("date_idx"))
    events = _pos(spark, [0, 10, 20])
    got = N.hyper_negatives(grid, events, 5000, dates)
    assert got.count() == got.distinct().count() == 5000
    assert got.join(events, ["cell", "date_utc", "window_hour"], "left_semi").count() == 0
    assert {r[0] for r in got.select("window_hour").distinct().collect()} == {0, 6, 12, 18}


def test_spatial_negatives_repeat_only_when_short(spark):
    pool = spark.range(0, 100).select("id", (F.col("id") / 10.0 + 26).alias("lat"), F.lit(-100.0).alias("lon"))
    events = spark.createDataFrame([(1, 26.0, -100.0)], "eid int, elat double, elon double")
    args = (F.xxhash64("id"), "lat", "lon", "id", "elat", "elon", "eid")
    few = N.spatial_negatives(pool, events, 30, 200.0, *args)
    assert few.count() == few.select("id").distinct().count() == 30
    assert few.where(haversine_km("lat", "lon", F.lit(26.0), F.lit(-100.0)) <= 200).count() == 0
    many = N.spatial_negatives(pool, events, 250, 200.0, *args)
    sizes = many.groupBy("id").count().agg(F.min("count"), F.max("count")).first()
    assert many.count() == 250 and sizes[1] - sizes[0] <= 1


def test_no_free_pool_point_gives_no_negatives(spark):
    pool = spark.range(0, 5).select("id", (F.col("id") / 10.0 + 26).alias("lat"), F.lit(-100.0).alias("lon"))
    events = pool.select(F.col("id").alias("eid"), F.col("lat").alias("elat"), F.col("lon").alias("elon"))
    got = N.spatial_negatives(pool, events, 30, 5.0, F.xxhash64("id"), "lat", "lon", "id", "elat", "elon", "eid")
    assert got.collect() == [] and got.columns == ["id", "lat", "lon", "draw"]


def test_random_negatives_of_a_covered_box_may_be_empty(spark):
    events = spark.createDataFrame([(1, 28.5, -99.5)], "id int, la double, lo double")
    got = N.random_negatives(spark, events, (28.4, 28.6, -99.6, -99.4), 3, 60.0, "la", "lo", "id", least_share=1e-3, covered="empty")
    assert got.collect() == [] and got.columns == ["id", "lat", "lon"]


def test_places_by_tables_are_those_of_the_order(spark):
    order, key = N.Permutation(4999), F.concat_ws(":", F.lit(7), "slot")
    rows = spark.range(0, order.places).withColumn("slot", F.col("id") % 2)
    tables = [F.when(F.col("slot") == 0, table).alias(f"_t{r}") for r, table in enumerate(order.tables(key))]
    rows = order.looked_up(rows.select("*", *tables), "id", key, ["_t0", "_t1", "_t2", "_t3"], "place")
    assert rows.where(F.col("place") != order.at(F.col("id"), key)).count() == 0
    assert rows.where("place is not null").count() == order.places


def test_many_steps_of_a_slot_share_their_hashes(spark):
    got = N.day_matched_negatives(_pos(spark, range(0, 4000, 10)), _grid(spark, 70000), 200)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate explode(kept")]
    # no test for null works the places out a second time
    assert "_t0" in plan and "isnotnull(((" not in above and "isnotnull(coalesce" not in above
    assert got.count() == got.select("cell").distinct().count() == 69600


def test_random_negatives(spark):
    events = spark.range(0, 50).select("id", (F.rand(1) * 4 + 28).alias("la"), (F.rand(2) * 4 - 100).alias("lo")).cache()
    got = N.random_negatives(spark, events, (28.0, 32.0, -100.0, -96.0), 300, 25.0, "la", "lo", "id")
    near = got.crossJoin(events.select("la", "lo")).where(haversine_km("lat", "lon", "la", "lo") <= 25)
    assert got.count() == 300 and near.count() == 0


def test_random_negatives_of_a_nearly_covered_box(spark):
    # all but a corner of about two thousandths of the box lies near an event
    events = spark.range(0, 900).select("id", (28 + F.floor(F.col("id") / 30) / 29 * 0.94).alias("la"), (-100 + F.col("id") % 30 / 29 * 0.94).alias("lo"))
    box = (28.0, 29.0, -100.0, -99.0)
    got = N.random_negatives(spark, events, box, 3, 6.0, "la", "lo", "id", seed=5)
    assert got.count() == 3 and got.crossJoin(events.select("la", "lo")).where(haversine_km("lat", "lon", "la", "lo") <= 6).count() == 0
    with pytest.raises(ValueError, match="cover the box"):
        N.random_negatives(spark, events, (28.0, 28.9, -100.0, -99.1), 3, 60.0, "la", "lo", "id", least_share=1e-3)


def test_smote_of_fewer_than_two_rows(spark):
    for rows in (0, 1):
        assert N.smote(spark.range(rows).select("id", F.lit(1.0).alias("x")), "id", ["x"], 5).collect() == []


def test_smote_stays_between_neighbours(spark):
    rows = spark.range(0, 120).select("id", F.rand(1).alias("x"), F.rand(2).alias("y")).cache()
    got = N.smote(rows, "id", ["x", "y"], 90, k=3).collect()
    at = {r["id"]: (r["x"], r["y"]) for r in rows.collect()}
    assert len(got) == 90
    for r in got:
        (ax, ay), (bx, by) = at[r["base_id"]], at[r["other_id"]]
        assert r["x"] == pytest.approx(ax + (bx - ax) * r["u"]) and r["y"] == pytest.approx(ay + (by - ay) * r["u"])


def test_undersample_and_weight(spark):
    df = spark.range(0, 1000).select("id", (F.col("id") % 20 == 0).cast("int").alias("y"))
    got = N.undersample(df, "y", 5, F.xxhash64("id"), "id")
    assert {r["y"]: r["count"] for r in got.groupBy("y").count().collect()} == {1: 50, 0: 250}
    assert N.class_weight(df, "y").first()["weight"] == 19.0
    assert N.class_weight(df.where("y = 0"), "y").first()["weight"] == 1.0


def test_folds_are_chronological(spark):
    df = spark.range(0, 400).select(F.date_add(F.lit(DAY), (F.col("id") % 40).cast("int")).alias("d"))
    runs = N.expanding_folds(df, "d", 3).groupBy("run").agg(F.min("d").alias("a"), F.max("d").alias("b")).orderBy("run").collect()
    assert len(runs) == 4 and all(x["b"] < y["a"] for x, y in zip(runs, runs[1:]))
