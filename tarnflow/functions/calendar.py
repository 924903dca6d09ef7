"""Calendar buckets and step names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ALIASES = ("h", "D", "W", "M", "Y")


def bucket(time: Column, alias: str) -> Column:
    """Start of a time's bucket; weeks end on Mondays and are named by that Monday; hours like ``6h`` count from midnight."""
    alias = normalize_alias(alias)
    if alias == "W":
        day = F.date_trunc("day", time)
        return (day + F.make_dt_interval(F.pmod(F.lit(2) - F.dayofweek(time), F.lit(7)))).cast("timestamp_ntz")
    unit = {"D": "day", "M": "month", "Y": "year", "h": "hour"}.get(alias[-1])
    if unit == "hour" and alias != "h":
        n = int(alias[:-1])
        day = F.date_trunc("day", time)
        return (day + F.make_dt_interval(F.lit(0), (F.floor(F.hour(time) / n) * n).cast("int"))).cast("timestamp_ntz")
    return F.date_trunc(unit, time).cast("timestamp_ntz")


def normalize_alias(alias: str) -> str:
    """``daily``, ``1D``, ``MS``, ``ME``, ``monthly``, ``H``, ``6H`` ... to one of D, W, M, Y, h, 6h."""
    a = alias.strip()
    named = {"daily": "D", "day": "D", "hourly": "h", "hour": "h", "weekly": "W", "week": "W", "monthly": "M", "month": "M", "yearly": "Y", "year": "Y", "annual": "Y"}
    if a.lower() in named:
        return named[a.lower()]
    digits = a[: len(a) - len(a.lstrip("0123456789"))]
    code = a[len(digits) :].upper().split("-")[0]
    code = {"MS": "M", "ME": "M", "YS": "Y", "YE": "Y", "A": "Y", "AS": "Y"}.get(code, code)
    if code == "H":
        return "h" if digits in ("", "1") else f"{int(digits)}h"
    if code in ("D", "W", "M", "Y") and digits in ("", "1"):
        return code
    raise ValueError(f"unsupported frequency {alias!r}")


def step_alias(hours: Column) -> Column:
    """Name of a median step: D within half a day of one, W within a day of seven, ME for 27 to 32 days, else Nh."""
    return (
        F.when(F.abs(hours - 24) <= 12, "D").when(F.abs(hours - 168) <= 24, "W").when((hours >= 27 * 24) & (hours <= 32 * 24), "ME")
        .otherwise(F.concat(F.round(hours).cast("int").cast("string"), F.lit("h")))
    )


def month_day(time: Column) -> Column:
    return F.date_format(time, "MM-dd")
