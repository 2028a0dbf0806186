"""Local time to UTC windows, calendar parts and cyclic encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import as_col, nullify_nan, to_date

# County codes of Texas that keep Mountain Time, and the state zones.
MOUNTAIN_FIPS = (48141, 48229, 48243, 48269, 48383)
ZONES = {"TX": "America/Chicago", "TX_WEST": "America/Denver", "CA": "America/Los_Angeles"}

# Months of the peak season and season codes by month.
PEAK_MONTHS = (2, 3, 4, 10, 11)
SEASONS = ("Winter", "Spring", "Summer", "Fall")

WINDOW_HOURS = 6


def parse_hhmm(c: Column | str) -> tuple[Column, Column]:
    """(hour, minute) of an HHMM number; missing or unreadable means noon."""
    t = nullify_nan(as_col(c).try_cast("double"))
    t = F.when(t >= 0, F.floor(t)).otherwise(F.ceil(t)).cast("long")
    unknown = t.isNull()
    hour = F.floor(t / 100).cast("int")
    minute = F.pmod(t, F.lit(100)).cast("int")
    # least/greatest skip nulls, so the null test has to come first
    hour = F.when(unknown, 12).otherwise(F.least(F.greatest(hour, F.lit(0)), F.lit(23)))
    minute = F.when(unknown, 0).otherwise(F.least(F.greatest(minute, F.lit(0)), F.lit(59)))
    return hour, minute


def tz_of(state: Column | str, fips: Column | str) -> Column:
    state = as_col(state)
    code = as_col(fips).try_cast("double").cast("int")
    texas = F.when(code.isin(*MOUNTAIN_FIPS), ZONES["TX_WEST"]).otherwise(ZONES["TX"])
    return F.when(state == "TX", texas).otherwise(ZONES["CA"])


def local_to_utc(date: Column | str, hhmm: Column | str, tz: Column | str) -> Column:
    """UTC instant of a local wall-clock time.

    An ambiguous hour takes the standard offset, a skipped hour moves one hour on.
    The session time zone must be UTC.
    """
    day = to_date(date)
    hour, minute = parse_hhmm(hhmm)
    zone = as_col(tz)
    wall = F.make_timestamp_ntz(
        F.year(day), F.month(day), F.dayofmonth(day), hour, minute, F.lit(0)
    ).cast("timestamp")
    utc = F.to_utc_timestamp(wall, zone)
    later = utc + F.expr("INTERVAL 1 HOUR")
    return F.when(F.from_utc_timestamp(later, zone) == wall, later).otherwise(utc)


def floor_6h(hour: Column | str) -> Column:
    return (F.floor(as_col(hour) / WINDOW_HOURS) * WINDOW_HOURS).cast("int")


def utc_window(instant: Column | str) -> dict[str, Column]:
    """date_utc, window_hour and window_start of a UTC instant."""
    instant = as_col(instant)
    hour = floor_6h(F.hour(instant))
    day = instant.cast("date")
    return {
        "date_utc": day,
        "window_hour": hour,
        "window_start": F.timestamp_seconds(F.unix_timestamp(day.cast("timestamp")) + hour * 3600),
    }


def cyclic(x: Column | str, period: float) -> tuple[Column, Column]:
    angle = as_col(x) * (2.0 * math.pi) / float(period)
    return F.sin(angle), F.cos(angle)


def season_code(month: Column | str) -> Column:
    """0 winter, 1 spring, 2 summer, 3 fall, by meteorological season."""
    return F.floor(F.pmod(as_col(month), F.lit(12)) / 3).cast("int")


def season_name(month: Column | str) -> Column:
    names = F.array(*[F.lit(s) for s in SEASONS])
    return F.element_at(names, season_code(month) + 1)


def month_name(date: Column | str) -> Column:
    return F.date_format(as_col(date), "MMM")


def day_name(date: Column | str) -> Column:
    return F.date_format(as_col(date), "EEEE")


def peak_flag(month: Column | str) -> Column:
    return as_col(month).isin(*PEAK_MONTHS).cast("int")


def coalesce_year(date: Column | str, fallback: Column | str) -> Column:
    return F.coalesce(F.year(as_col(date)), as_col(fallback).cast("int"))


def day_number(date: Column | str) -> Column:
    return F.unix_date(as_col(date))
