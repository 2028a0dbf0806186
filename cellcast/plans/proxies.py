"""Event, grid, weather and score tables derived from the given tables.

Only plain arithmetic is used, so SQL can state the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_width
from .registry import Tables

#: Rows that are grouped in one task; a group takes some 100 bytes in each of its tables.
PART_ROWS = 1 << 18

SOUTH, WEST = 25.84, -106.65
TEXAS_BOX = (25.84, 36.5, -106.65, -93.51)

GRID_SQL = """grid as (select c_custkey as cell, c_custkey as idx, c_nationkey as region, c_acctbal,
 25.84 + ((c_custkey*7919)%10660)/1000.0 as lat, -106.65 + ((c_custkey*104729)%13140)/1000.0 as lon from customer)"""
POS_SQL = """pos as (select o_orderkey, o_custkey as cell, cast(o_orderdate as date) as date_utc,
 cast((o_orderkey%4)*6 as integer) as window_hour, 1 as label, o_totalprice from orders where o_orderpriority='1-URGENT')"""
WEATHER_SQL = """weather as (select l_suppkey as px, cast(l_shipdate as date) as d, avg(l_quantity) as erc, avg(l_tax) as vs,
 avg(l_extendedprice) as tmmx from lineitem group by 1, 2)"""
SCORED_SQL = """scored as (select d.doc_id, d.lang, (d.n_chars%1000)/1000.0::double as score, l.quality as label
 from documents d join labels l using (doc_id))"""
SITES_SQL = """sites as (select s_suppkey as sid, 25.84 + ((s_suppkey*6151)%10660)/1000.0 as slat,
 -106.65 + ((s_suppkey*50021)%13140)/1000.0 as slon, s_nationkey from supplier)"""
PIXELS_SQL = """pixels as (select cast(p_partkey//100 as integer) as "row", cast(p_partkey%100 as integer) as col,
 cast(p_size as double) as value from part)"""


def grid(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    return t.customer.select(
        k.alias("cell"),
        k.alias("idx"),
        F.col("c_nationkey").alias("region"),
        "c_acctbal",
        (F.pmod(k * 7919, F.lit(10660)) / 1000.0 + SOUTH).alias("lat"),
        (F.pmod(k * 104729, F.lit(13140)) / 1000.0 + WEST).alias("lon"),
    )


def pos(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(
        "o_orderkey",
        F.col("o_custkey").alias("cell"),
        F.col("o_orderdate").cast("date").alias("date_utc"),
        (F.pmod("o_orderkey", F.lit(4)) * 6).cast("int").alias("window_hour"),
        F.lit(1).alias("label"),
        "o_totalprice",
    )


def _dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows by their keys in partitions of about ``PART_ROWS``, so that few groups meet in one task."""
    n = rows.count()
    if n <= PART_ROWS:
        return rows
    return rows.repartition(max(-(-n // PART_ROWS), shuffle_width(rows.sparkSession)), *keys)


def weather(t: Tables) -> DataFrame:
    rows = t.lineitem.select(
        F.col("l_suppkey").alias("px"), F.col("l_shipdate").cast("date").alias("d"), "l_quantity", "l_tax", "l_extendedprice"
    )
    # nearly every row is a (pixel, day) of its own, so adding up before the shuffle only fills memory
    return _dealt(rows, "px", "d").groupBy("px", "d").agg(
        F.avg("l_quantity").alias("erc"), F.avg("l_tax").alias("vs"), F.avg("l_extendedprice").alias("tmmx")
    )


def scored(t: Tables) -> DataFrame:
    score = F.pmod("n_chars", F.lit(1000)) / 1000.0
    joined = t.documents.select("doc_id", "lang", score.alias("score")).join(t.labels.select("doc_id", "quality"), "doc_id")
    return joined.withColumnRenamed("quality", "label")


def sites(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    return t.supplier.select(
        k.alias("sid"),
        (F.pmod(k * 6151, F.lit(10660)) / 1000.0 + SOUTH).alias("slat"),
        (F.pmod(k * 50021, F.lit(13140)) / 1000.0 + WEST).alias("slon"),
        "s_nationkey",
    )


def pixels(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    return t.part.select(
        F.floor(k / 100).cast("int").alias("row"), F.pmod(k, F.lit(100)).cast("int").alias("col"), F.col("p_size").cast("double").alias("value")
    )


def cell_px(t: Tables, cell: str = "cell"):
    """Weather pixel of a cell: its id modulo the number of weather pixels."""
    return F.pmod(F.col(cell), t.supplier.agg(F.count(F.lit(1))).scalar())
