import os
import tempfile

import pytest
from pyspark.sql import functions as F

from cellcast.operators import catalog as K
from cellcast.operators import clean as CL
from cellcast.operators import dataset as D
from cellcast.operators import joins as J
from cellcast.plans import table_queries as TQ
from cellcast.sources import readers as RD
from cellcast.sources import sinks as SK


def test_yearly_files(spark):
    base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    with open(f"{base}/2014_FPA_FOD_cons.csv", "w") as f:
        f.write("fod_id,State,FIRE_SIZE\n1,TX,2.5\n2,CA,bad\n")
    with open(f"{base}/2016_FPA_FOD_cons.csv", "w") as f:
        f.write("FIRE_YEAR,FIRE_SIZE,FOD_ID,NEW\n2016,7,3,x\n")
    with open(f"{base}/notes_FPA_FOD_cons.csv", "w") as f:
        f.write("FOD_ID\n9\n")
    df, absent = RD.read_events(spark, base, years=[2014, 2015, 2016])
    rows = {r["FOD_ID"]: r for r in df.collect()}
    assert absent == [2015] and set(rows) == {"1", "2", "3"}
    assert rows["1"]["FIRE_YEAR"] == "2014" and rows["1"]["STATE"] == "TX" and rows["1"]["NEW"] is None
    assert rows["3"]["source_year"] == 2016 and rows["3"]["STATE"] is None


def test_table_sinks(spark):
    base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    df = spark.range(0, 20).select(F.col("id"), (F.col("id") % 2).alias("part"))
    SK.write_table(df, f"{base}/t.parquet", ["part"], ["id"], csv_copy=True)
    assert RD.read_table(spark, f"{base}/t.parquet").count() == 20
    df.write.csv(f"{base}/only.csv", header=True)
    assert RD.read_table(spark, f"{base}/only.parquet").count() == 20
    SK.write_preview(df, f"{base}/p", 5)
    assert spark.read.csv(f"{base}/p", header=True).count() == 5
    SK.write_report({"a": df}, f"{base}/r")
    assert os.path.isdir(f"{base}/r/a")


def test_points_and_scalars(spark):
    base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    with open(f"{base}/p.csv", "w") as f:
        f.write("latitude,longitude,acq_date\n30,-97,2024-02-03\n95,-97,2024-02-03\n30,x,2024-02-03\n31,-98,2023-02-03\n31,-98,?\n")
    assert RD.read_points(spark, f"{base}/p.csv", 2024).count() == 1
    with pytest.raises(ValueError):
        RD.clean_points(spark.range(1), "latitude", "longitude", "acq_date")
    with open(f"{base}/d.csv", "w") as f:
        f.write("date,value\n2020-01-01,1.5\nbad,2\n")
    assert [tuple(r)[1] for r in RD.read_daily_scalar(spark, f"{base}/d.csv").collect()] == [1.5]


def test_filters_raise_on_unknown(spark):
    df = spark.createDataFrame([(" tx ",), ("CA",)], "STATE string")
    assert CL.filter_partition(df, "STATE", "TX").count() == 1
    with pytest.raises(ValueError):
        CL.filter_partition(df, "STATE", "ZZ", {"TX", "CA"})
    with pytest.raises(ValueError):
        CL.filter_partition(df, "COUNTY", "TX")


def test_validation_flags_and_keeps_rows(spark):
    df = spark.createDataFrame([(1, "30", "2014-01-01"), (2, "abc", "x"), (3, None, None)], "id int, lat string, d string")
    rules = {"lat": CL.number_rule("lat", 25, 37), "date": CL.date_rule("d", df), "soft": CL.number_rule("lat", 25, 37, allow_null=True)}
    got = {r["rule"]: (r["invalid"], r["pct"]) for r in CL.validation_summary(df, rules).collect()}
    assert got == {"lat": (2, 66.6667), "date": (2, 66.6667), "soft": (0, 0.0)}
    assert CL.validation_summary(df.limit(0), rules).first()["pct"] is None


def test_keyword_modes_and_table_agree(spark):
    df = spark.createDataFrame([("Lightning strike",), ("strike",), ("none of it",), (None,), ("",)], "t string")
    rules = [("strike", "B"), ("lightning", "A"), ("str", "C")]
    table = spark.createDataFrame([(i, w, c) for i, (w, c) in enumerate(rules)], "rule_no int, keyword string, category string")
    for mode, want in (("first", ["B", "B", "UNKNOWN"]), ("longest", ["A", "B", "UNKNOWN"])):
        a = {r["t"]: r["category"] for r in K.keyword_classify(df, "t", rules, mode).collect()}
        b = {r["t"]: r["category"] for r in K.keyword_classify_table(df, "t", table, mode).collect()}
        assert a == b and [a["Lightning strike"], a["strike"], a["none of it"]] == want


def test_keyword_table_meets_each_piece_once_and_spread(spark):
    texts = spark.createDataFrame([(i, "ab" * 9000) for i in range(40)], "k int, low string").coalesce(1)
    parts = K._pieces(texts, "low", [2, 3], "w").withColumn("p", F.spark_partition_id()).cache()
    # three parts a text, each with ab, ba, aba and bab
    assert parts.count() == 40 * 3 * 4 and parts.select("p").distinct().count() > 1
    assert {r["w"] for r in parts.select("w").distinct().collect()} == {"ab", "ba", "aba", "bab"}


def test_keyword_table_over_borders(spark):
    # keywords over the borders of fragments and parts, equal keywords, an absent category
    rules = [(5, "Xyz", "late"), (1, "xyz", "early"), (2, "é" * 70, "long"), (0, "q", None), (3, "zz", "last")]
    table = spark.createDataFrame(rules, "rule_no int, keyword string, category string")
    texts = ["." * n + w for n in (0, 61, 62, 63, 64, 8189, 8190, 8191, 8192, 16383) for w in ("xYz", "É" * 70 + "!", "zz.")]
    texts += ["xy" + "." * 64 + "z", "é" * 69, "q and xyz", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")

    def first(t, order):
        hits = [r for r in rules if t is not None and r[1].lower() in t.lower()]
        return min(hits, key=order)[2] or "none" if hits else "none"

    for mode, order in (("first", lambda r: r[0]), ("longest", lambda r: (-len(r[1]), r[0]))):
        got = {r["i"]: r["category"] for r in K.keyword_classify_table(df, "t", table, mode, default="none").collect()}
        assert got == {i: first(t, order) for i, t in enumerate(texts)}


def test_weather_groups_a_bounded_number_in_a_task(spark):
    class Given:
        lineitem = spark.range(0, 1 << 20, 1, 2).select(
            (F.col("id") % 1000).alias("l_suppkey"),
            F.timestamp_seconds((F.col("id") / 1000).cast("long") * 86400).alias("l_shipdate"),
            *[(F.col("id") % m).cast("double").alias(c) for m, c in ((17, "l_quantity"), (7, "l_tax"), (999, "l_extendedprice"))],
        )

    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        merged = J.merge_weather_vars(TQ._decoded(Given), ["erc", "tmmx"], ("date", "px"))
        tasks = merged.groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    assert sum(r["count"] for r in tasks) == 1 << 20 and max(r["count"] for r in tasks) < 300_000


def test_gates(spark):
    cat = spark.createDataFrame([("a", "POST_FIRE_ONLY", True), ("b", "PRE", True), ("c", "PRE", False), ("d", "SAME_DAY_RISK", False)], "column string, availability string, is_constant boolean")
    got = {r["column"]: r["gate1_reason"] for r in K.gate_feasibility(cat).collect()}
    assert got == {"a": "POST_FIRE", "b": "CONSTANT", "c": None, "d": "SAME_DAY"}
    pairs = spark.createDataFrame([("erc", "erc_long", 0.995), ("erc_long", "bi", 0.999), ("x", "y", 0.5)], "a string, b string, r double")
    names = spark.createDataFrame([(c,) for c in ["erc", "erc_long", "bi", "x", "y", "z"]], "column string")
    listed = spark.createDataFrame([("z", "unused")], "column string, reason string")
    gone = {r["column"]: r["reason"] for r in K.gate_redundancy(names, pairs, listed=listed).collect()}
    assert gone == {"erc": None, "erc_long": "correlated with bi", "bi": None, "x": None, "y": None, "z": "unused"}


def test_redundancy_rounds_equal_one_walk(spark):
    import random

    rng = random.Random(5)
    names = [f"c{'x' * rng.randrange(4)}{i}" for i in range(25)]
    rows = [(a, b, rng.choice([0.5, 0.99, 0.995, -0.999, 1.0])) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.2]
    want = {}
    for a, b, r in sorted(rows, key=lambda p: (-abs(p[2]), p[0], p[1])):
        if abs(r) >= 0.99 and a not in want and b not in want:
            keep, drop = (a, b) if len(a) <= len(b) else (b, a)
            want[drop] = f"correlated with {keep}"
    frame = spark.createDataFrame([(c,) for c in names], "column string")
    got = K.gate_redundancy(frame, spark.createDataFrame(rows, "a string, b string, r double")).collect()
    assert {r["column"]: r["reason"] for r in got if r["reason"]} == want and len(got) == len(names)


def test_out_of_grid_events_are_flagged(spark):
    labels = spark.createDataFrame([(1, 1), (99, 1)], "cell long, label int")
    grid = spark.createDataFrame([(1, 0.5)], "cell long, whp double")
    flagged = {r["cell"]: r["in_grid"] for r in J.in_grid(labels, grid).collect()}
    assert flagged == {1: 1, 99: 0}
    assert {r["cell"]: r["whp"] for r in J.join_static(labels, grid).collect()} == {1: 0.5, 99: None}


def test_asof_history_sees_only_earlier_days(spark):
    ev = spark.createDataFrame([(1, "2020-01-01"), (1, "2020-01-01"), (1, "2020-02-01")], "cell int, d string").select("cell", F.to_date("d").alias("date_utc"))
    got = {str(r["date_utc"]): r["events_before"] for r in D.asof_event_count(ev, ev).collect()}
    assert got == {"2020-01-01": 0, "2020-02-01": 2}


def test_cover_is_complete(spark):
    from cellcast.functions.cells import cell_id

    box = (29.0, 30.0, -98.0, -97.0)
    cover = D.cover_cells(spark, None, box, 6)
    assert cover.count() == cover.select("cell").distinct().count()
    # every cell hit by points well inside the box is in the cover
    pts = spark.range(0, 5000).select((F.rand(1) * 0.8 + 29.1).alias("lat"), (F.rand(2) * 0.8 - 97.9).alias("lon"))
    assert pts.select(cell_id("lat", "lon", 6).alias("cell")).join(cover, "cell", "left_anti").count() == 0


def test_fill_policy_and_features(spark):
    df = spark.createDataFrame([(None, None, "x"), (2.0, "41", "3.5")], "burn double, lc string, n string")
    got = [tuple(r) for r in CL.fill_policy(df, ["burn"], ["lc"], ["n"]).collect()]
    assert got == [(0.0, -1, 0.0), (2.0, 41, 3.5)]
    kept, absent = CL.select_features(df, ["n", "zzz"])
    assert kept.columns == ["n"] and absent == ["zzz"]


def test_a_stored_mapping_joins_without_moving(spark):
    mapping = spark.range(0, 500).select(F.col("id").alias("cell"), F.when(F.col("id") % 11 > 0, F.col("id") % 37).alias("site_id"))
    values = spark.range(0, 30).select(F.col("id").alias("site_id"), (F.col("id") * 2).alias("value"))
    stored, kept = SK.store_bucketed(mapping, "site_id", "mapping"), SK.store_bucketed(values, "site_id", "window-1")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = [J.map_values(stored, v) for v in (kept, values)]
        texts = [p._jdf.queryExecution().executedPlan().toString() for p in plans]
        assert texts[0].count("Exchange") == 0 and texts[1].count("Exchange") == 1
        want = {(i, i % 37 if i % 11 else None, 2 * (i % 37) if i % 11 and i % 37 < 30 else None) for i in range(500)}
        for p in plans:
            assert {(r["cell"], r["site_id"], r["value"]) for r in p.collect()} == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert J.map_values(SK.store_bucketed(mapping.limit(0), "site_id", "none"), kept).count() == 0
