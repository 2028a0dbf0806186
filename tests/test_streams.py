import datetime as dt
import tempfile

from cellcast.streaming import live
from pyspark.sql import functions as F


def _write(spark, folder, rows):
    df = spark.createDataFrame(rows, "cell int, ts timestamp").coalesce(1)
    df.write.mode("append").parquet(folder)


def _at(day, hour):
    return dt.datetime(2024, 5, day, hour)


def test_append_writes_closed_windows_once_and_drops_late_rows(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/in"
    state = tempfile.mkdtemp(prefix="run-", dir="/tmp")

    def run():
        stream = live.open_stream(spark, folder, "cell int, ts timestamp")
        counts = live.live_counts(stream, "ts", F.col("cell"))
        query = (
            counts.writeStream.outputMode("append").format("parquet").option("path", f"{state}/t")
            .option("checkpointLocation", f"{state}/c").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return {(r["cell"], r["window_start"]): r["events"] for r in spark.read.parquet(f"{state}/t").collect()}

    _write(spark, folder, [(1, _at(1, 1)), (1, _at(1, 2)), (2, _at(3, 13))])
    first = run()
    assert first == {(1, _at(1, 0)): 2}
    # one row older than the watermark, one inside the delay, one that closes the rest
    _write(spark, folder, [(1, _at(1, 3)), (2, _at(3, 1)), (3, _at(9, 0))])
    assert run() == {(1, _at(1, 0)): 2, (2, _at(3, 0)): 1, (2, _at(3, 12)): 1}


def test_closed_windows_equal_the_batch_count(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/in"
    _write(spark, folder, [(i % 3, _at(1 + i % 5, i % 24)) for i in range(200)])
    stream = live.open_stream(spark, folder, "cell int, ts timestamp")
    got = live.append_closed(live.live_counts(stream, "ts", F.col("cell")), "closed")
    batch = spark.read.parquet(folder).groupBy("cell", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("events"))
    last = spark.read.parquet(folder).agg(F.max("ts")).first()[0] - dt.timedelta(days=1)
    want = batch.where(F.col("w.end") <= F.lit(last)).select("cell", F.col("w.start").alias("window_start"), "events")
    assert got.count() > 0 and got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def _whole(df):
    return sorted((r["cell"] is None, r["cell"] or 0, r["window_start"], r["events"]) for r in df.collect())


def test_upserts_over_many_triggers_equal_the_batch_count(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/in"
    for part in range(4):
        # windows are opened by one file and go on in the next
        _write(spark, folder, [(None if i % 5 == 4 else i % 5, _at(1 + part + i % 2, i % 24)) for i in range(60)])
    stream = spark.readStream.schema("cell int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(folder)
    counts = live.live_counts(stream, "ts", F.col("cell"), late="9 days")
    got = live.upsert_live(counts, "upserts", ["cell", "window_start"])
    batch = spark.read.parquet(folder).groupBy("cell", F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("events"))
    assert _whole(got) == _whole(batch.select("cell", F.col("w.start").alias("window_start"), "events"))


def test_replayed_batches_change_nothing_and_other_days_stay(spark):
    table = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/t"
    first = spark.createDataFrame([(1, _at(1, 0), 3), (None, _at(1, 6), 1), (2, _at(2, 0), 5)], "cell int, window_start timestamp, events int")
    second = spark.createDataFrame([(None, _at(1, 6), 4), (3, _at(1, 6), 9)], first.schema)
    first.limit(0).write.parquet(f"{table}/_start")
    keys = ["cell", "window_start"]
    want = [(False, 1, _at(1, 0), 3), (False, 2, _at(2, 0), 5), (False, 3, _at(1, 6), 9), (True, 0, _at(1, 6), 4)]
    live.upsert(first, 0, table, keys)
    for again in range(2):
        live.upsert(second, 1, table, keys)
        assert _whole(live.read_windows(spark, table, first.schema)) == want
    # an empty trigger makes no version, and a day without rows in a batch has none either
    live.upsert(first.limit(0), 2, table, keys)
    assert _whole(live.read_windows(spark, table, first.schema)) == want
    versions = live._versions(spark, table, first.schema)
    assert {(r["day"].day, r["batch"]) for r in versions.select("day", "batch").distinct().collect()} == {(1, 0), (2, 0), (1, 1)}
