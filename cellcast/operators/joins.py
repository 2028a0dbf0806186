"""Lookup joins onto cells, pixels, dates and regular grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import grid_snap, pixel_index
from ..functions.scalars import nullify_nan


def join_static(labels: DataFrame, static: DataFrame, key: str = "cell") -> DataFrame:
    """Left lookup of per-cell features; columns the labels already have are dropped."""
    extra = [c for c in static.columns if c not in labels.columns]
    return labels.join(static.select(key, *extra), key, "left")


def join_weather(labels: DataFrame, weather: DataFrame, keys=("cell", "date_utc")) -> DataFrame:
    extra = [c for c in weather.columns if c not in labels.columns]
    return labels.join(weather.select(*keys, *extra), list(keys), "left")


def map_lookup(df: DataFrame, lookup: DataFrame, key: str, value: str, default=0) -> DataFrame:
    return df.join(lookup.select(key, value), key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def grid_snap_join(points, grid, lat: str, lon: str, lat0: float, lon0: float, step: float, how: str = "left") -> DataFrame:
    """Nearest pixel of a regular grid by arithmetic, then a plain equi-join."""
    row, col = grid_snap(lat, lon, lat0, lon0, step)
    return points.withColumn("row", row).withColumn("col", col).join(grid, ["row", "col"], how)


def sample_pixels(points, pixels, layer: str, x: str, y: str, affine: dict, fill: float | None = None, clamp: bool = False) -> DataFrame:
    """Value of the pixel under each point.

    ``affine`` has a, c, e, f, width, height and optionally nodata.  Outside points get
    ``fill``; with ``clamp`` an index one past the edge is pulled back inside.
    """
    row, col = pixel_index(x, y, affine["a"], affine["c"], affine["e"], affine["f"])
    if clamp:
        row = F.when(row == affine["height"], affine["height"] - 1).otherwise(row)
        col = F.when(col == affine["width"], affine["width"] - 1).otherwise(col)
    band = pixels.where(F.col("layer") == layer).select("row", "col", nullify_nan(F.col("value")).alias("value"))
    if affine.get("nodata") is not None:
        band = band.where(F.col("value") != affine["nodata"])
    spots = points.withColumn("row", row).withColumn("col", col)
    out = spots.join(band, ["row", "col"], "left")
    value = F.col("value") if fill is None else F.coalesce("value", F.lit(fill))
    return out.withColumn(layer, value).drop("value", "row", "col")


def anti_join(candidates: DataFrame, events: DataFrame, keys) -> DataFrame:
    return candidates.join(events.select(*keys), list(keys), "left_anti")


def date_join(cells: DataFrame, daily: DataFrame, date: str = "date") -> DataFrame:
    """One scalar row per date; Spark broadcasts it when its measured size allows."""
    return cells.join(daily, date, "left")


def merge_weather_vars(long: DataFrame, variables: list[str], keys=("date", "row", "col")) -> DataFrame:
    """All variables of a (date, pixel) in one row with a single shuffle."""
    picks = [F.max(F.when(F.col("var") == v, F.col("value"))).alias(v) for v in variables]
    return long.groupBy(*keys).agg(*picks)


def coverage_join(points: DataFrame, bounds: list[dict], x: str, y: str, label: str) -> DataFrame:
    """Points outside each layer's extent by class, in one pass over the points.

    ``bounds`` is layer metadata: one dict per layer with left, right, bottom and top.
    """
    def outside(b: dict) -> Column:
        return ~(F.col(x).between(b["left"], b["right"]) & F.col(y).between(b["bottom"], b["top"]))

    aggs = []
    for i, b in enumerate(bounds):
        for y_class, tag in ((1, "pos"), (0, "neg")):
            aggs.append(F.count(F.when(outside(b) & (F.col(label) == y_class), 1)).alias(f"{tag}{i}"))
    flat = points.agg(F.count(F.lit(1)).alias("rows"), *aggs)
    rows = [
        F.struct(F.lit(b["layer"]).alias("layer"), F.col(f"pos{i}").alias("outside_pos"), F.col(f"neg{i}").alias("outside_neg"))
        for i, b in enumerate(bounds)
    ]
    return flat.select("rows", F.explode(F.array(*rows)).alias("m")).select("rows", "m.*")


def coverage_gaps(points, bounds, x, y, label, limit_pct: float = 2.0) -> DataFrame:
    out = coverage_join(points, bounds, x, y, label)
    pct = F.try_divide((F.col("outside_pos") + F.col("outside_neg")) * 100.0, F.col("rows"))
    return out.withColumn("outside_pct", F.round(pct, 4)).withColumn("flagged", pct > limit_pct)


def label_join(features: DataFrame, labels: DataFrame, keys=("date", "row", "col")) -> DataFrame:
    return features.join(labels, list(keys), "left")


def with_slot(grid: DataFrame, date: str, window_hour: int) -> DataFrame:
    """Every cell for one (date, window): a projection, no join at all."""
    return grid.withColumn("date_utc", F.lit(date).cast("date")).withColumn("window_hour", F.lit(window_hour))


def in_grid(labels: DataFrame, grid: DataFrame, key: str = "cell") -> DataFrame:
    """Flags labelled rows whose cell belongs to the grid."""
    mark = grid.select(key, F.lit(1).alias("in_grid"))
    return labels.join(mark, key, "left").withColumn("in_grid", F.coalesce("in_grid", F.lit(0)))


def map_values(mapping: DataFrame, values: DataFrame, key: str = "site_id") -> DataFrame:
    """Values of every output cell by a mapping made once; cells without values stay, with nulls.

    With both sides stored in buckets of ``key`` neither moves, whatever the window; with the
    mapping alone stored, only the values of the window do.
    """
    return mapping.join(values, key, "left")
