"""Trailing, rolling and neighbourhood statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import nullify_nan
from .ordered import percentiles

# Trailing statistics kept per weather variable.
TRAILING = {
    "erc": ("mean", "max"),
    "fm100": ("mean", "min"),
    "bi": ("mean", "max"),
    "vpd": ("mean", "max"),
    "vs": ("mean", "max"),
    "rmax": ("mean", "min"),
    "tmmx": ("mean", "max"),
}

CHUNK_DAYS = 64


def trailing_stats(
    weather: DataFrame,
    wanted: DataFrame,
    pixel: str,
    date: str,
    specs: dict[str, tuple[str, ...]],
    days: int = 5,
) -> DataFrame:
    """Statistics over the calendar days d-days .. d-1 for every wanted (pixel, date).

    Missing values and missing days are skipped; a wanted day needs no weather row of its
    own.  ``weather`` has one row per (pixel, day).  Series are cut into chunks of
    ``CHUNK_DAYS`` days plus a lead-in, so a window never sorts more than one chunk.
    """
    cols = list(specs)
    need = wanted.select(pixel, F.col(date).cast("date").alias(date)).distinct()
    day = F.unix_date(F.col(date))
    # only days and pixels that are asked for take part; the bounds reach the scan
    asked_day = F.col(date).cast("date")
    first, last = wanted.agg(F.min(asked_day)).scalar(), wanted.agg(F.max(asked_day)).scalar()
    weather = weather.where((F.col(date) >= F.date_sub(first, days)) & (F.col(date) < last))
    series = weather.join(need.select(pixel).distinct(), pixel, "left_semi")
    floats = {f.name for f in weather.schema if f.dataType.typeName() in ("double", "float")}
    series = series.select(
        pixel, day.alias("_day"), F.lit(0).alias("_asked"), *[nullify_nan(c).alias(c) if c in floats else F.col(c) for c in cols]
    )
    own = F.floor(F.col("_day") / CHUNK_DAYS)
    last = F.floor((F.col("_day") + days) / CHUNK_DAYS)
    series = series.withColumn("_chunk", F.explode(F.sequence(own, last)))
    types = {f.name: f.dataType for f in weather.schema}
    asked = need.select(
        pixel, day.alias("_day"), F.lit(1).alias("_asked"), *[F.lit(None).cast(types[c]).alias(c) for c in cols]
    ).withColumn("_chunk", F.floor(F.col("_day") / CHUNK_DAYS))
    rows = series.unionByName(asked)
    w = Window.partitionBy(pixel, "_chunk").orderBy("_day").rangeBetween(-days, -1)
    stat = {"mean": F.avg, "max": F.max, "min": F.min}
    outs = [stat[s](c).over(w).alias(f"{c}_{days}D_{s}") for c, kinds in specs.items() for s in kinds]
    done = rows.select(pixel, "_day", "_asked", *outs).where(F.col("_asked") == 1)
    return done.select(pixel, F.date_from_unix_date("_day").alias(date), *[c for c in done.columns if f"_{days}D_" in c])


def _rows(key, order, first: int, last: int):
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(first, last)


def rolling_mean(df: DataFrame, key, order: str, cols: list[str], n: int = 5) -> DataFrame:
    """Mean of the current and the n-1 previous rows of a pixel series, partial at the start."""
    w = _rows(key, order, -(n - 1), 0)
    return df.select("*", *[F.avg(c).over(w).alias(f"{c}_roll{n}") for c in cols])


def rolling_3d(df: DataFrame, key, order: str, temp: str, rh: str, wind: str) -> DataFrame:
    w = _rows(key, order, -2, 0)
    return df.select(
        "*",
        F.max(temp).over(w).alias("temp_max_3d"),
        F.min(rh).over(w).alias("rh_min_3d"),
        F.avg(wind).over(w).alias("wind_mean_3d"),
    )


def impute_series(df: DataFrame, key, order: str, cols: list[str], how: str = "zero") -> DataFrame:
    """Forward fill, then backward fill, then 0 per series."""
    keys = [key] if isinstance(key, str) else list(key)
    back = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys).orderBy(order).rowsBetween(0, Window.unboundedFollowing)
    filled = df
    for c in cols:
        v = F.coalesce(F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(ahead))
        filled = filled.withColumn(f"_f_{c}", F.coalesce(v, F.lit(0.0)) if how == "zero" else v)
    others = [c for c in df.columns if c not in cols]
    return filled.select(*others, *[F.col(f"_f_{c}").alias(c) for c in cols])


def impute_bands(df: DataFrame, cols: list[str]) -> DataFrame:
    """Median of each band for values still missing after the series fill."""
    out = df
    for c in cols:
        med = percentiles(df.select(c), c, [0.5], names=["m"])
        out = out.withColumn(c, F.coalesce(F.col(c), med.scalar()))
    return out


def ignition_label(df: DataFrame, key, order: str, burned: str) -> DataFrame:
    """1 where a new burn starts on the next day or the one after.

    ``exclude`` marks days already burning; the last two days of a series have no label.
    Before the series the first value counts as history.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(order)
    first = F.first(burned).over(w.rowsBetween(Window.unboundedPreceding, 0))
    today = F.col(burned)
    prev1 = F.coalesce(F.lag(burned, 1).over(w), first)
    prev2 = F.coalesce(F.lag(burned, 2).over(w), first)
    next1, next2 = F.lead(burned, 1).over(w), F.lead(burned, 2).over(w)
    starts1 = (next1 == 1) & (today == 0) & (prev1 == 0) & (prev2 == 0)
    starts2 = (next2 == 1) & (next1 == 0) & (today == 0) & (prev1 == 0)
    label = F.when(next2.isNotNull(), (starts1 | starts2).cast("int"))
    exclude = F.when(next2.isNull(), 1).otherwise((today == 1).cast("int"))
    return df.select("*", label.alias("ignition"), exclude.alias("exclude"))


def lag_flag(df: DataFrame, key, order: str, flag: str, name: str = "burned_yesterday") -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    return df.withColumn(name, F.lag(flag, 1).over(Window.partitionBy(*keys).orderBy(order)))


def focal_3x3(pixels: DataFrame, value: str, res: float, by=()) -> DataFrame:
    """Slope (degrees), aspect sine and cosine, and ruggedness from the 3x3 surroundings.

    One row per (by, row, col).  Two sorts: along rows for left and right, then along
    columns for the three-wide strips above and below.
    """
    by = list(by)
    along = Window.partitionBy(*by, "row").orderBy("col")

    def beside(step: int) -> Column:
        fn = F.lag if step < 0 else F.lead
        at = fn("col", 1).over(along) == F.col("col") + step
        return F.when(at, fn(value, 1).over(along))

    strip = pixels.select(*by, "row", "col", F.struct(beside(-1).alias("w"), F.col(value).alias("o"), beside(1).alias("e")).alias("s"))
    down = Window.partitionBy(*by, "col").orderBy("row")

    def beyond(step: int) -> Column:
        fn = F.lag if step < 0 else F.lead
        at = fn("row", 1).over(down) == F.col("row") + step
        return F.when(at, fn("s", 1).over(down))

    three = strip.select(*by, "row", "col", "s", beyond(-1).alias("n"), beyond(1).alias("b"))
    o = F.col("s.o")
    around = [F.col(f"{r}.{c}") for r in ("n", "b") for c in ("w", "o", "e")] + [F.col("s.w"), F.col("s.e")]
    squares = sum((F.coalesce((v - o) * (v - o), F.lit(0.0)) for v in around), F.lit(0.0))
    known = sum((v.isNotNull().cast("int") for v in around), F.lit(0))

    def gradient(before: Column, after: Column) -> Column:
        return F.when(before.isNotNull() & after.isNotNull(), (after - before) / (2 * res)).otherwise(
            F.coalesce((after - o) / res, (o - before) / res, F.lit(0.0))
        )

    dy = gradient(F.col("n.o"), F.col("b.o"))
    dx = gradient(F.col("s.w"), F.col("s.e"))
    # flat ground has the direction of (0, -0.0), which is a half turn
    flat = (F.col("dx") == 0) & (F.col("dy") == 0)
    aspect = F.when(flat, F.lit(math.pi)).otherwise(F.atan2(F.col("dy"), -F.col("dx")))
    terms = three.select(
        *by, "row", "col", o.alias(value), dy.alias("dy"), dx.alias("dx"),
        F.sqrt(squares / F.greatest(known, F.lit(1))).alias("tri"),
    )
    return terms.select(
        *by,
        "row",
        "col",
        value,
        F.degrees(F.atan(F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))).alias("slope"),
        F.sin(aspect).alias("aspect_sin"),
        F.cos(aspect).alias("aspect_cos"),
        "tri",
    )


def kelvin_to_c(df: DataFrame, var: str = "var", date: str = "date", value: str = "value", temps=("tmmx", "tmmn"), limit: float = 200.0) -> DataFrame:
    """Subtracts 273.15 from a temperature batch (var, date) whose mean exceeds ``limit``."""
    hot = (
        df.where(F.col(var).isin(*temps))
        .groupBy(var, date)
        .agg(F.avg(value).alias("_mean"))
        .where(F.col("_mean") > limit)
        .select(var, date, F.lit(273.15).alias("_shift"))
    )
    out = df.join(hot, [var, date], "left")
    return out.withColumn(value, F.col(value) - F.coalesce("_shift", F.lit(0.0))).drop("_shift")
