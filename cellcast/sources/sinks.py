"""Table, report, preview and score writers."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.clean import enforce_schema
from ..session import shuffle_width, work_path


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, order: list[str] | None = None, columns: list[str] | None = None, csv_copy: bool = False) -> None:
    """Snappy parquet, ordered inside files when asked, with an optional CSV copy."""
    if columns:
        df = enforce_schema(df, columns)
    if order:
        df = df.sortWithinPartitions(*order)
    writer = df.write.mode("overwrite").option("compression", "snappy")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    if csv_copy:
        df.sparkSession.read.parquet(path).write.mode("overwrite").csv(f"{path}_csv", header=True)


def write_report(tables: dict[str, DataFrame], folder: str, form: str = "csv") -> None:
    """One folder per report table, CSV with header or JSON lines."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if form == "json":
            writer.json(f"{folder}/{name}")
        else:
            writer.csv(f"{folder}/{name}", header=True)


def preview(df: DataFrame, n: int = 10000) -> DataFrame:
    return df.limit(n)


def write_preview(df: DataFrame, path: str, n: int = 10000) -> None:
    preview(df, n).write.mode("overwrite").csv(path, header=True)


def write_scores(exported: DataFrame, path: str) -> None:
    exported.write.mode("overwrite").csv(path, header=True)


def store_bucketed(df: DataFrame, key: str, name: str) -> DataFrame:
    """Writes a table once in buckets of ``key``, so that joins on it need no shuffle of it again.

    The files lie in the shared folder and go when the session ends, as does the table's entry
    in a session catalog.  Tables stored by one session have equally many buckets.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    table = path.rsplit("/", 1)[1].replace("-", "_")
    # rows of a bucket meet in one task, so a bucket is one file
    spread = df.repartition(shuffle_width(spark), key)
    spread.write.bucketBy(shuffle_width(spark), key).sortBy(key).option("path", path).saveAsTable(table)
    return spark.table(table)
