"""Units: conversion to degC and mm, re-basing of rates, whether a variable is intensive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit spellings after normalisation.
KELVIN = ("k", "kelvin")
FAHRENHEIT = ("f", "°f", "degf", "fahrenheit")
CELSIUS = ("c", "°c", "degc", "celsius", "degree_celsius", "degrees_celsius")
MILLIMETRES = ("mm", "kg m-2", "m")
RATES = ("kg m-2 s-1", "mm d-1", "mm s-1", "mm h-1")
#: Seconds of a rate's time unit, and its spellings.
SECONDS = {"s": 1.0, "d": 86400.0, "month": 30.4 * 86400.0, "y": 12.0 * 30.4 * 86400.0}
SPELLINGS = {"s": ("seconds", "second", "secs", "sec", "s"), "d": ("days", "day", "d"), "month": ("months", "month", "mons", "mon"), "y": ("years", "year", "yrs", "yr", "y")}


def normalize_unit(unit: str) -> str:
    return " ".join(unit.strip().lower().replace("**", "").split())


def normalize_unit_column(unit: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(unit), r"\*\*", "")), r"\s+", " ")


def conversion(unit: str, step_hours: float | None = None, compat: bool = False) -> tuple[float, float, str]:
    """(factor, offset, new unit): value * factor + offset.

    Rates become totals per step and need ``step_hours`` (1 or 24).  ``compat``: kg m-2 times 1000 and daily mm s-1
    times 90000, as the studied code has it; otherwise 1 and 86400.
    """
    u = normalize_unit(unit)
    if u in KELVIN:
        return 1.0, -273.15, "degC"
    if u in FAHRENHEIT:
        return 5 / 9, -32 * 5 / 9, "degC"
    if u in CELSIUS:
        return 1.0, 0.0, "degC"
    if u == "m":
        return 1000.0, 0.0, "mm"
    if u in MILLIMETRES:
        return (1000.0 if compat and u == "kg m-2" else 1.0), 0.0, "mm"
    if u in RATES:
        if step_hours not in (1, 24):
            raise ValueError(f"a rate needs an hourly or daily step, not {step_hours}")
        daily = step_hours == 24
        if u.endswith("s-1"):
            seconds = 86400.0 if daily else 3600.0
            return (90000.0 if compat and daily and u == "mm s-1" else seconds), 0.0, "mm"
        if u == "mm d-1":
            return (1.0 if daily else 1 / 24), 0.0, "mm"
        return (24.0 if daily else 1.0), 0.0, "mm"
    raise ValueError(f"unexpected unit {unit!r}")


def convert(value: Column, unit: str, step_hours: float | None = None, compat: bool = False) -> Column:
    factor, offset, _ = conversion(unit, step_hours, compat)
    return value * factor + offset


def _rate_tokens(unit: Column) -> Column:
    """The words of a unit after the last ``/``, or all of them where there is none."""
    return F.split(F.trim(F.element_at(F.split(unit, "/"), -1)), r"[\s*]+")


def rate_code(unit: Column) -> Column:
    """Code of a rate's time unit (s, d, month, y), or null: ``x/d``, ``x d-1``, ``x d^-1``, in the unit's last time word."""
    known = F.create_map(*[F.lit(x) for code, words in SPELLINGS.items() for w in words for x in (w, code)])
    over = unit.contains("/")
    # a word after a slash counts as it is, any other one only with the power -1
    word = lambda t: F.when(over, F.lower(t)).when(F.rtrim(t).endswith("-1"), F.rtrim(F.lower(F.substring_index(t, "-1", 1)), F.lit("^ ")))
    # blanks may stand within the power
    tight = F.regexp_replace(F.regexp_replace(unit, r"\s*\^\s*", "^"), r"\s*-\s*1\b", "-1")
    codes = F.transform(_rate_tokens(tight), lambda t: F.try_element_at(known, word(t)))
    return F.try_element_at(F.filter(codes, lambda c: c.isNotNull()), F.lit(1))


def rebase_rate(value: Column, unit: Column, target: str) -> tuple[Column, Column]:
    """(value, unit) of a rate in the time unit ``target``; anything that is no rate stays."""
    code = rate_code(unit)
    seconds = F.try_element_at(F.create_map(*[F.lit(x) for pair in SECONDS.items() for x in pair]), code)
    over = F.concat(F.regexp_replace(unit, r"/[^/]*$", "/"), F.lit(target))
    # the time word is the run of letters ahead of the power
    power = F.regexp_replace(unit, r"[A-Za-z]+(\s*\^?)\s*-\s*1\b", f"{target}$1-1")
    return F.when(code.isNull(), value).otherwise(value * (SECONDS[target] / seconds)), F.when(code.isNull(), unit).when(unit.contains("/"), over).otherwise(power)


#: What tells, in this order, whether a variable is averaged over time (intensive): where to look, words, verdict.
INTENSIVE_RULES = [
    ("cell_methods", ("time: sum",), False), ("cell_methods", ("time: mean",), True), ("standard_name", ("amount", "accumulation", "thickness_of"), False),
    ("units", ("/s", " s-1", "/h", " h-1", "/min", " min-1"), True), ("standard_name", ("flux",), True), ("units", ("/d", " d-1"), True),
    # every other unit that spells an m counts as a total
    ("units", ("m",), False),
]


def is_intensive(units: str | None, standard_name: str | None = None, cell_methods: str | None = None) -> bool:
    """Whether a variable is averaged (intensive) or summed (extensive) over time; on the driver, from metadata: the first rule that fits, else intensive."""
    told = {"units": units, "standard_name": standard_name, "cell_methods": cell_methods}
    fits = (verdict for where, words, verdict in INTENSIVE_RULES if any(w in (told[where] or "").lower().strip() for w in words))
    return next(fits, True)
