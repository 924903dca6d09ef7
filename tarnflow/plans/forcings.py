"""Queries over daily forcings: PET by each formula, units, validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import units
from ..functions.pet import day_length_hours, extraterrestrial_radiation, pet
from .registry import query
from .views import FORCING, forcing, table

_RE = """(37.5 * (1 + 0.033 * cos(2 * pi() * (dayofyear(t) - 1) / 365.0)) * (w * sin(radians(lat)) * sin(d) + cos(radians(lat)) * cos(d) * sin(w)))"""
_SUN = f"""{FORCING}, sun0 AS (SELECT *, radians(-23.44) * cos(radians(360.0 / 365.0 * (dayofyear(t) - 1 + 10))) d, CAST(0.409 AS DOUBLE) * sin(2 * pi() * (dayofyear(t) - 81) / 365.0) d2 FROM forcing),
  sun1 AS (SELECT *, acos(least(greatest(-tan(radians(lat)) * tan(d), -1), 1)) w, 24 / pi() * acos(least(greatest(-tan(radians(lat)) * tan(d2), -1), 1)) dl FROM sun0),
  sun AS (SELECT *, {_RE} re, 1000 * {_RE} / (CAST(2.26 AS DOUBLE) * 977) AS water FROM sun1)"""
_FORMULAS = {
    "oudin": "CASE WHEN tavg < -5 THEN 0 ELSE water * (tavg + 5) / 100 END",
    "hargreaves_samani": "CAST(0.0023 AS DOUBLE) * water * sqrt(greatest(tmax - tmin, 0)) * (tavg + CAST(17.8 AS DOUBLE))",
    "mcguinness_bordne": "water * (tavg + 5) / 68",
    "hamon": "CAST(0.165 AS DOUBLE) * CAST(216.7 AS DOUBLE) * (dl / 12) * (CAST(0.6108 AS DOUBLE) * exp(CAST(17.27 AS DOUBLE) * tavg / (tavg + CAST(237.3 AS DOUBLE))) / (tavg + CAST(273.3 AS DOUBLE)))",
    "blaney_criddle": "CAST(0.825 AS DOUBLE) * (CAST(0.46 AS DOUBLE) * tavg + CAST(8.13 AS DOUBLE)) * (100 * dl / (365 * 12))",
    "jensen_haise": "water * tavg / 40",
}


def _pet_query(number: int, method: str) -> None:
    @query(f"m{number:02d}_pet_{method}", f"WITH {_SUN} SELECT cell, t, greatest({_FORMULAS[method]}, 0) pet FROM sun", "pet")
    def run(spark, sf):
        return forcing(spark, sf).select("cell", "t", pet(method, F.col("lat"), F.dayofyear("t"), F.col("tavg"), F.col("tmin"), F.col("tmax")).alias("pet"))


for _number, _method in enumerate(_FORMULAS, 4):
    _pet_query(_number, _method)


@query("m01_radiation_daylength", f"WITH {_SUN} SELECT DISTINCT lat, CAST(dayofyear(t) AS INT) doy, re, dl FROM sun", "re dl")
def radiation(spark, sf):
    """M1, M2: extraterrestrial radiation and day length."""
    days = forcing(spark, sf).select("lat", F.dayofyear("t").alias("doy")).distinct()
    return days.select("lat", "doy", extraterrestrial_radiation(F.col("lat"), F.col("doy")).alias("re"), day_length_hours(F.col("lat"), F.col("doy")).alias("dl"))


@query("m10_pet_hourly", f"WITH {_SUN} SELECT cell, t, greatest({_FORMULAS['oudin']}, 0) / 24 pet FROM sun", "pet")
def pet_hourly(spark, sf):
    """Hourly rate."""
    return forcing(spark, sf).select("cell", "t", pet("oudin", F.col("lat"), F.dayofyear("t"), F.col("tavg"), daily=False).alias("pet"))


@query("f23_temperature_order", f"WITH {FORCING} SELECT count(*) FILTER (tmin > tmax) violations, count(*) n FROM forcing")
def temperature_order(spark, sf):
    """pairs with Tmin over Tmax."""
    return forcing(spark, sf).agg(F.count_if(F.col("tmin") > F.col("tmax")).alias("violations"), F.count("*").alias("n"))


@query("p05_unit_conversion", f"WITH {FORCING} SELECT cell, t, tavg + CAST(273.15 AS DOUBLE) - CAST(273.15 AS DOUBLE) celsius, (tavg - 32) * 5 / CAST(9 AS DOUBLE) AS from_f, tmax * 1000 AS mm, tmax * 86400 AS per_day FROM forcing", "celsius from_f mm per_day")
def unit_conversion(spark, sf):
    """P5: K and F to degC, m and kg m-2 s-1 to mm."""
    f = forcing(spark, sf)
    return f.select("cell", "t", units.convert(F.col("tavg") + 273.15, "K").alias("celsius"), units.convert(F.col("tavg"), "degF").alias("from_f"), units.convert(F.col("tmax"), "m").alias("mm"), units.convert(F.col("tmax"), "kg m**-2 s**-1", 24).alias("per_day"))


@query(
    "p07_rate_rebase",
    """WITH u AS (SELECT o_orderkey, o_totalprice v, CASE o_orderkey % 5 WHEN 0 THEN 'mm/s' WHEN 1 THEN 'mm d-1' WHEN 2 THEN 'mm month^-1' WHEN 3 THEN 'kg / year' ELSE 'mm' END unit FROM orders)
    SELECT o_orderkey, v * CASE o_orderkey % 5 WHEN 0 THEN 86400 WHEN 1 THEN 1 WHEN 2 THEN 1 / CAST(30.4 AS DOUBLE) WHEN 3 THEN 1 / CAST(364.8 AS DOUBLE) ELSE 1 END AS value,
      CASE o_orderkey % 5 WHEN 0 THEN 'mm/d' WHEN 1 THEN 'mm d-1' WHEN 2 THEN 'mm d^-1' WHEN 3 THEN 'kg /d' ELSE 'mm' END unit FROM u""",
    "value",
)
def rate_rebase(spark, sf):
    """Rates per second, day, month, year to one a day."""
    spelled = F.element_at(F.array(*map(F.lit, ["mm/s", "mm d-1", "mm month^-1", "kg / year", "mm"])), (F.col("o_orderkey") % 5 + 1).cast("int"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", spelled.alias("u"))
    value, unit = units.rebase_rate(F.col("o_totalprice"), F.col("u"), "d")
    return o.select("o_orderkey", value.alias("value"), unit.alias("unit"))


@query("m25_unit_text", "SELECT DISTINCT regexp_replace(trim(replace(lower(' ' || o_orderpriority || '**2  x '), '**', '')), '\\s+', ' ', 'g') unit FROM orders")
def unit_text(spark, sf):
    """Normalised unit text."""
    spelled = F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit("**2  x "))
    return table(spark, sf, "orders").select(units.normalize_unit_column(spelled).alias("unit")).distinct()
