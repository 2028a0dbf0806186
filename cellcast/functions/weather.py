"""Fire-weather formulas and decoding of packed weather or raster values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import as_col

# Land-cover classes used as flags.
LAND_COVER = {"lc_urban": 21, "lc_forest": 41, "lc_shrubland": 52, "lc_grassland": 71, "lc_agriculture": 82}

KELVIN = 273.15
UPPER_VALID = 9000.0


def decode_grid(raw, fill, scale, offset, upper: float = UPPER_VALID) -> Column:
    """The fill value is masked before scaling, values past ``upper`` after it."""
    raw = as_col(raw)
    value = F.when(raw != as_col(fill), raw.cast("double") * as_col(scale) + as_col(offset))
    return F.when(value <= upper, value)


def physical_scale(layer, value) -> Column:
    layer, v = as_col(layer), as_col(value)
    v = F.when(~F.isnan(v), v)
    index = F.when(F.abs(v) > 2.0, v * 1e-4).otherwise(v)
    surface = F.when(v > 1000, v * 0.02 - KELVIN).when(v > 150, v - KELVIN).otherwise(v)
    air = F.when(v > 150, v - KELVIN).otherwise(v)
    return (
        F.when(layer.isin("NDVI", "EVI"), index)
        .when(layer == "LST", surface)
        .when(layer == "Temperature", air)
        .otherwise(v)
    )


def _saturation(temp: Column, base: float) -> Column:
    return F.exp(temp * 17.27 / (temp + 237.3)) * base


def vpd(temp_c, rh) -> Column:
    svp = _saturation(as_col(temp_c), 0.61078)
    deficit = svp - svp * (as_col(rh) / 100.0)
    return F.when(deficit < 0, F.lit(0.0)).otherwise(deficit)


def vpd_tetens(temp_k, rh) -> Column:
    return _saturation(as_col(temp_k) - KELVIN, 0.6108) * (F.lit(1.0) - as_col(rh) / 100.0)


def hdw(temp_c, rh, wind) -> Column:
    return as_col(wind) * vpd(temp_c, rh)


# Fixed values: (constant, rh, rh squared, rh * temperature) of moisture above 50 % humidity.
EMC_HUMID = (21.0606, -0.100276, 0.005531, -0.001436)


def ffwi(temp_c, rh, wind_ms, humid=EMC_HUMID) -> Column:
    """Fosberg index, clipped to 0..100."""
    rh = as_col(rh)
    t = as_col(temp_c) * 1.8 + 32.0
    mph = as_col(wind_ms) * 2.23694

    dry = 0.03229 + 0.281073 * rh - 0.000578 * rh * t
    middle = 2.22749 + 0.160107 * rh - 0.014784 * t
    damp = humid[0] + humid[1] * rh + humid[2] * rh * rh + humid[3] * rh * t
    m = F.when(rh < 10.0, dry).when(rh <= 50.0, middle).otherwise(damp)
    x = m / 30.0
    damping = F.when(m > 30.0, F.lit(0.0)).otherwise(F.lit(1.0) - x * 2.0 + x * x * 1.5 - x * x * x * 0.5)
    index = damping * F.sqrt(mph * mph + 1.0) / 0.3002
    return F.when(index < 0, F.lit(0.0)).when(index > 100, F.lit(100.0)).otherwise(index)


def wind_speed(u, v) -> Column:
    return F.hypot(as_col(u), as_col(v))
