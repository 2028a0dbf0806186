"""Ranking, roll-up and export of scored cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import DEFAULT_LAT0, cell_center, cell_parent
from ..functions.scalars import clean_num, risk_band
from .ordered import global_index


def risk_rank(scored: DataFrame, slot: list[str], score: str = "risk_score", key: str = "cell") -> DataFrame:
    """1-based rank inside each slot by falling score, key on ties; hot slots are split."""
    neg = scored.withColumn("_neg", -F.col(score))
    ranked = global_index(neg, ["_neg", key], "_n", by=slot)
    return ranked.withColumn("rank", F.col("_n") + 1).drop("_n", "_neg")


def top_k(scored: DataFrame, k: int, score: str = "risk_score", key: str = "cell") -> DataFrame:
    return scored.orderBy(F.desc(score), key).limit(k)


def normalise_top(scored: DataFrame, k: int, size: str, low: float, high: float, key: str) -> DataFrame:
    """The k largest rows with ``size`` mapped to [low, high] (marker radius)."""
    top = top_k(scored, k, size, key)
    # k rows
    w = Window.partitionBy(F.lit(0))
    lo, hi = F.min(size).over(w), F.max(size).over(w)
    unit = F.when(hi > lo, (F.col(size) - lo) / (hi - lo)).otherwise(F.lit(0.0))
    return top.withColumn("scaled", unit * (high - low) + low)


def busy_slots(positives: DataFrame, slot: list[str], min_events: int = 3, n: int = 10) -> DataFrame:
    counts = positives.groupBy(*slot).agg(F.count(F.lit(1)).alias("events"))
    return counts.where(F.col("events") >= min_events).orderBy(F.desc("events"), *slot).limit(n)


def rollup_cells(scored: DataFrame, resolutions=(4, 5, 6, 7), cell: str = "cell", score: str = "risk_score", label: str = "label", base_res: int = 8, lat0: float = DEFAULT_LAT0) -> DataFrame:
    """Mean score, label sum and count per parent cell; the base level passes through.

    Rows are first combined per base cell, so a cell with many rows expands once.
    """
    per_cell = scored.groupBy(cell).agg(F.sum(score).alias("_s"), F.sum(label).alias("_l"), F.count(F.lit(1)).alias("_n"))
    # one branch a level over the same shuffle: all levels in one would outgrow generated code
    levels = [per_cell.select("_s", "_l", "_n", F.lit(r).alias("resolution"), cell_parent(cell, r, lat0, base_res).alias("cell")) for r in resolutions]
    levels.append(per_cell.select("_s", "_l", "_n", F.lit(base_res).alias("resolution"), F.col(cell).alias("cell")))
    up = reduce(DataFrame.unionByName, levels)
    out = up.groupBy("resolution", "cell").agg(
        F.sum("_s").alias("_s"), F.sum("_l").alias("events"), F.sum("_n").alias("rows")
    )
    return out.select("resolution", "cell", (F.col("_s") / F.col("rows")).alias("mean_score"), "events", "rows")


def export_scores(scored: DataFrame, cell: str = "cell", score: str = "risk_score", label: str = "label") -> DataFrame:
    """cell, lat, lon, cleaned score, band and label, highest score first."""
    lat, lon = cell_center(cell)
    rows = scored.select(
        F.col(cell).alias("cell"), lat.alias("lat"), lon.alias("lon"), clean_num(score).alias("risk_score"), F.col(label).alias("label")
    )
    return rows.withColumn("band", risk_band("risk_score")).orderBy(F.desc("risk_score"), "cell")


def export_json(rolled: DataFrame) -> DataFrame:
    """One compact JSON record per cell, written per resolution partition."""
    record = F.to_json(F.struct(F.col("cell").alias("c"), clean_num("mean_score").alias("s"), F.col("events").alias("e"), F.col("rows").alias("n")))
    return rolled.select("resolution", "cell", record.alias("record"))


def slot_rows(splits: DataFrame, date: str, window_hour: int) -> DataFrame:
    """Rows of every split for one (date, window); on a written table the filter reaches the scan."""
    return splits.where((F.col("date_utc") == F.lit(date).cast("date")) & (F.col("window_hour") == window_hour))
