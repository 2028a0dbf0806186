"""Live event counts and rule counts over six-hour windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, work_path

WINDOW = "6 hours"


def open_stream(spark: SparkSession, path: str, schema, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def live_counts(stream: DataFrame, ts: str, cell: Column, late: str = "1 day") -> DataFrame:
    """Events per (cell, six-hour window).

    In update or append mode state older than the watermark is dropped.
    """
    marked = stream.withWatermark(ts, late)
    counts = marked.groupBy(F.window(ts, WINDOW).alias("w"), cell.alias("cell")).agg(F.count(F.lit(1)).alias("events"))
    return counts.select("cell", F.col("w.start").alias("window_start"), "events")


def live_violations(stream: DataFrame, ts: str, rules: dict[str, Column], late: str = "1 day") -> DataFrame:
    """Rows and broken rules per six-hour window."""
    marked = stream.withWatermark(ts, late)
    sums = [F.sum(F.when(cond, 1).otherwise(0)).alias(name) for name, cond in rules.items()]
    out = marked.groupBy(F.window(ts, WINDOW).alias("w")).agg(F.count(F.lit(1)).alias("rows"), *sums)
    return out.select(F.col("w.start").alias("window_start"), "rows", *rules)


def drain(result: DataFrame, name: str) -> DataFrame:
    """Runs a stream over everything available now and reads the final table back.

    Complete mode keeps late windows, so the result equals the batch count.  Each trigger
    rewrites one folder in the shared directory; nothing passes the driver.
    """
    spark = result.sparkSession
    base = work_path(spark, name)
    target = f"{base}/table"

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    query = (
        result.writeStream.outputMode("complete")
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .foreachBatch(replace)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(target)


def append_closed(result: DataFrame, name: str) -> DataFrame:
    """Runs a stream over everything available now and reads the closed windows back.

    Append mode: a window is written once, when the watermark has passed its end, and its
    state is dropped then; rows later than that are left out.  Windows still open at the
    end stay in the state of the checkpoint.
    """
    spark = result.sparkSession
    base = work_path(spark, name)
    query = (
        result.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{base}/table")
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{base}/table")


def _versions(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    whole = T.StructType(schema.fields).add("batch", "long").add("day", "date")
    return spark.read.schema(whole).parquet(table)


def _newest(versions: DataFrame) -> DataFrame:
    """Rows of the newest version of each day."""
    days = versions.groupBy("day").agg(F.max("batch").alias("batch"))
    return versions.join(days, ["day", "batch"], "left_semi")


def read_windows(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """The table that ``upsert`` keeps, one row per key."""
    return _newest(_versions(spark, table, schema)).select(*schema.names)


def upsert(batch: DataFrame, batch_id: int, table: str, keys: list[str], start: str = "window_start") -> None:
    """Puts a trigger's rows into the table: a key's new row takes the place of its old one.

    The table lies in ``batch=<id>/day=<day of start>``.  A batch writes a new version of the
    days that it has rows of, made from their newest version of an earlier batch, and touches no
    other day.  A batch that runs again writes the same version again, so nothing changes, and
    a batch that was stopped half way is written anew.  Rows without a key value equal each other.
    """
    spark = batch.sparkSession
    # the batch is used twice but its state must move on once
    fresh = cut_lineage(batch.withColumn("day", F.to_date(start)), "batch")
    touched = fresh.select("day").distinct()
    earlier = _versions(spark, table, batch.schema).where(F.col("batch") < batch_id)
    old = _newest(earlier).drop("batch").join(touched, "day", "left_semi")
    same = reduce(lambda a, b: a & b, [old[k].eqNullSafe(fresh[k]) for k in keys])
    kept = old.join(fresh, (old["day"] == fresh["day"]) & same, "left_anti")
    whole = kept.unionByName(fresh).hint("rebalance", "day")
    whole.write.mode("overwrite").partitionBy("day").parquet(f"{table}/batch={batch_id}")


def upsert_live(result: DataFrame, name: str, keys: list[str], start: str = "window_start") -> DataFrame:
    """Runs a stream over everything available now in update mode and reads its table back.

    A trigger moves only the windows it changed and rewrites only their days.  State older than
    the watermark is dropped, and rows later than it are left out; a first trigger has none.
    """
    spark = result.sparkSession
    base = work_path(spark, name)
    table, schema = f"{base}/table", result.schema
    # the folder must be there before the first version
    result.sparkSession.createDataFrame([], schema).write.parquet(f"{table}/_start")

    def put(batch: DataFrame, batch_id: int) -> None:
        upsert(batch, batch_id, table, keys, start)

    query = (
        result.writeStream.outputMode("update")
        .option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True)
        .foreachBatch(put)
        .start()
    )
    query.awaitTermination()
    return read_windows(spark, table, schema)
