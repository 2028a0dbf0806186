"""Cell grid, labels and the assembled training table."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cells import DEFAULT_LAT0, EDGE_KM, KM_PER_DEG, _scale, cell_center, cell_id, hex_center, pack
from ..functions.geo import in_bbox, in_polygon
from ..functions.scalars import missing_flag
from ..functions.timefn import cyclic, local_to_utc, peak_flag, season_code, tz_of, utc_window
from ..session import shuffle_width
from .clean import drop_redundant, forbid_columns
from .joins import in_grid, join_static, join_weather
from .sampling import chronological_split
from .spatial import nearest_join
from .windows import trailing_stats


def cover_cells(spark, ring: list[tuple[float, float]] | None, bbox: tuple[float, float, float, float], res: int, lat0: float = DEFAULT_LAT0) -> DataFrame:
    """Cells whose centre lies in the ring (or the box when there is none)."""
    south, north, west, east = bbox
    edge = EDGE_KM[res]
    r_lo = math.floor(south * KM_PER_DEG / (1.5 * edge)) - 1
    r_hi = math.ceil(north * KM_PER_DEG / (1.5 * edge)) + 1
    width = edge * math.sqrt(3.0)
    x_lo, x_hi = west * _scale(lat0), east * _scale(lat0)
    per_row = math.ceil((x_hi - x_lo) / width) + 3
    ids = spark.range(0, (r_hi - r_lo + 1) * per_row, numPartitions=shuffle_width(spark))
    r = F.floor(F.col("id") / per_row) + r_lo
    q = F.floor(F.lit(x_lo / width) - r / 2.0) - 1 + F.pmod("id", F.lit(per_row))
    axes = ids.select(q.alias("q"), r.alias("r"))
    x, y = hex_center(F.col("q"), F.col("r"), edge)
    cells = axes.select(pack(res, F.col("q"), F.col("r")).alias("cell"), (y / KM_PER_DEG).alias("_lat"), (x / _scale(lat0)).alias("_lon"))
    inside = in_bbox("_lat", "_lon", *bbox)
    if ring:
        inside = inside & in_polygon("_lat", "_lon", ring)
    return cells.where(inside).select(
        "cell", F.round("_lat", 6).alias("centroid_lat"), F.round("_lon", 6).alias("centroid_lon")
    )


def cell_event_count(events: DataFrame, lat: str, lon: str, res: int, lat0: float = DEFAULT_LAT0) -> DataFrame:
    return events.groupBy(cell_id(lat, lon, res, lat0).alias("cell")).agg(F.count(F.lit(1)).alias("event_count"))


def asof_event_count(rows: DataFrame, events: DataFrame, cell: str = "cell", date: str = "date_utc") -> DataFrame:
    """Events of the cell strictly before the row's date, per distinct (cell, date).

    Events are counted per (cell, day) first, so the running sum is over calendar days.
    """
    from pyspark.sql import Window

    daily = events.groupBy(cell, date).agg(F.count(F.lit(1)).alias("_n"))
    asked = rows.select(cell, date).distinct().withColumn("_n", F.lit(0).cast("long")).withColumn("_asked", F.lit(1))
    line = daily.withColumn("_asked", F.lit(0)).unionByName(asked).withColumn("_day", F.unix_date(date))
    w = Window.partitionBy(cell).orderBy("_day").rangeBetween(Window.unboundedPreceding, -1)
    total = line.withColumn("events_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    return total.where(F.col("_asked") == 1).select(cell, date, "events_before")


def build_grid(spark, events: DataFrame, lat: str, lon: str, event_id: str, region: str, res: int, bbox, ring=None, state: str = "", lat0: float = DEFAULT_LAT0) -> DataFrame:
    """Cells with region code of the nearest event, event count, history flag, burnable."""
    cells = cover_cells(spark, ring, bbox, res, lat0)
    coded = events.where(F.col(region).isNotNull())
    near = nearest_join(cells, coded, "centroid_lat", "centroid_lon", lat, lon, event_id, "degree")
    codes = coded.select(F.col(event_id).alias("site_id"), F.col(region).cast("string").alias("region"))
    counts = cell_event_count(events, lat, lon, res, lat0)
    out = near.join(codes, "site_id", "left").join(counts, "cell", "left")
    return out.select(
        "cell",
        F.lit(state).alias("state"),
        F.lit(res).alias("resolution"),
        "centroid_lat",
        "centroid_lon",
        "region",
        F.coalesce("event_count", F.lit(0)).alias("event_count"),
        F.col("event_count").isNotNull().alias("has_history"),
        F.lit(True).alias("burnable"),
    )


def grid_summary(grid: DataFrame) -> DataFrame:
    return grid.agg(
        F.count(F.lit(1)).alias("cells"),
        F.count(F.when(F.col("event_count") > 0, 1)).alias("cells_with_history"),
        F.min("centroid_lat").alias("min_lat"),
        F.max("centroid_lat").alias("max_lat"),
        F.min("centroid_lon").alias("min_lon"),
        F.max("centroid_lon").alias("max_lon"),
    )


def region_breakdown(grid: DataFrame, region: str) -> DataFrame:
    hits = F.count(F.when(F.col("event_count") > 0, 1))
    return grid.groupBy(region).agg(
        F.count(F.lit(1)).alias("cells"), hits.alias("event_cells"), F.round(hits * 100.0 / F.count(F.lit(1)), 2).alias("event_pct")
    )


def event_labels(events: DataFrame, lat: str, lon: str, date: str, hhmm: str, state: str, fips: str, res: int, lat0: float = DEFAULT_LAT0) -> DataFrame:
    """One positive row per event: cell, UTC date and window, cell centre and UTC year.

    Rows without a readable date are left out; ``labelling_losses`` counts them.
    """
    timed = events.withColumn("_utc", local_to_utc(date, hhmm, tz_of(state, fips)))
    timed = timed.where(F.col("_utc").isNotNull()).withColumn("cell", cell_id(lat, lon, res, lat0))
    c_lat, c_lon = cell_center("cell", lat0, res=res)
    parts = [c.alias(n) for n, c in utc_window("_utc").items()]
    return timed.select(
        "cell", *parts, F.lit(1).alias("label"), c_lat.alias("centroid_lat"), c_lon.alias("centroid_lon"),
        F.year("_utc").alias("year"), F.col(state).alias("state"),
    )


def labelling_losses(events: DataFrame, lat: str, lon: str, date: str) -> DataFrame:
    from ..functions.scalars import to_date

    return events.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(F.when(to_date(date).isNull(), 1)).alias("bad_date"),
        F.count(F.when(F.col(lat).isNull() | F.col(lon).isNull(), 1)).alias("bad_place"),
    )


def label_summary(labels: DataFrame, cell: str = "cell", date: str = "date_utc") -> DataFrame:
    return labels.agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("positives"),
        F.count(F.when(F.col("label") == 0, 1)).alias("negatives"),
        F.countDistinct(F.when(F.col("label") == 1, F.col(cell))).alias("unique_cells"),
        F.countDistinct(F.when(F.col("label") == 1, F.col(date))).alias("unique_dates"),
    )


def label_distribution(labels: DataFrame, keys: list[str]) -> DataFrame:
    n = F.count(F.lit(1))
    return labels.groupBy(*keys).agg(
        F.count(F.when(F.col("label") == 1, 1)).alias("positives"), F.count(F.when(F.col("label") == 0, 1)).alias("negatives"), n.alias("rows")
    )


def observations_per_cell(labels: DataFrame, cell: str = "cell", date: str = "date_utc") -> DataFrame:
    """Cells seen on 1, 2 to 5 and more dates, with the largest and mean number."""
    per = labels.groupBy(cell).agg(F.countDistinct(date).alias("d"))
    return per.agg(
        F.count(F.when(F.col("d") == 1, 1)).alias("one"),
        F.count(F.when(F.col("d").between(2, 5), 1)).alias("two_to_five"),
        F.count(F.when(F.col("d") > 5, 1)).alias("over_five"),
        F.max("d").alias("most"),
        F.avg("d").alias("mean"),
    )


def add_time_features(df: DataFrame, date: str, hour: str | None = None, doy: bool = False) -> DataFrame:
    s, c = cyclic(F.month(date), 12)
    out = df.withColumn("sin_month", s).withColumn("cos_month", c)
    if hour:
        s, c = cyclic(hour, 24)
        out = out.withColumn("sin_hour", s).withColumn("cos_hour", c)
    if doy:
        s, c = cyclic(F.dayofyear(date), 365)
        out = out.withColumn("sin_doy", s).withColumn("cos_doy", c)
        out = out.withColumn("season_code", season_code(F.month(date))).withColumn("is_peak", peak_flag(F.month(date)))
    return out


def drop_outside(positives: DataFrame, grid: DataFrame, key: str = "cell") -> DataFrame:
    """Positives whose cell is in the grid: the rest would have no features and give themselves away."""
    return positives.join(grid.select(key), key, "left_semi")


def outside_counts(positives: DataFrame, grid: DataFrame, by: list[str], key: str = "cell") -> DataFrame:
    """Positives kept and dropped by ``drop_outside``, per group."""
    flagged = in_grid(positives, grid.select(key).distinct(), key)
    kept = F.sum("in_grid")
    return flagged.groupBy(*by).agg(kept.alias("kept"), (F.count(F.lit(1)) - kept).alias("dropped"))


def assemble_dataset(
    labels: DataFrame,
    static: DataFrame,
    weather: DataFrame,
    probe: str,
    train_to: int,
    val_to: int,
    split_part: Column | None = None,
    keys: tuple[str, str] = ("cell", "date_utc"),
    trailing: dict[str, tuple[str, ...]] | None = None,
    days: int = 5,
) -> DataFrame:
    """Labels with static, weather and trailing features, flags, encodings and a split column.

    ``keys`` name the weather place and the date in both ``labels`` and ``weather``;
    ``trailing`` asks for statistics of weather columns over the ``days`` before.  The year
    of the UTC date decides the split for both classes.
    """
    out = join_weather(join_static(labels, static), weather, keys)
    if trailing:
        stats = trailing_stats(weather, labels.select(*keys), *keys, trailing, days)
        out = join_weather(out, stats, keys)
    # the joins put their keys first
    out = out.select(*labels.columns, *[c for c in out.columns if c not in labels.columns])
    out = out.withColumn("weather_missing", missing_flag(probe))
    out = add_time_features(out, "date_utc", "window_hour")
    out, _ = forbid_columns(out)
    out = drop_redundant(out)
    return chronological_split(out, F.year("date_utc") if split_part is None else split_part, train_to, val_to)
