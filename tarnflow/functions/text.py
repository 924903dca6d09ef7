"""Identifiers and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First digit of a gauge id to region.
REGIONS = {"1": "Africa", "2": "Asia", "3": "South America", "4": "North/Central America", "5": "SW Pacific", "6": "Europe"}


def match_id(value: Column) -> Column:
    """Canonical text of an id: 7.0 and '7.0' are '7', null is ''."""
    return F.coalesce(F.regexp_replace(F.trim(value.cast("string")), r"^([+-]?\d+)\.0+$", "$1"), F.lit(""))


def numeric_id(value: Column) -> Column:
    """The first run of digits without leading zeros, as a long."""
    return F.when(F.regexp_extract(value, r"(\d+)", 1) != "", F.regexp_extract(value, r"(\d+)", 1)).cast("long")


def region(gauge_id: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in REGIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.substring(match_id(gauge_id), 1, 1)), F.lit("Unknown"))


def label_fields(label: Column, names: list[str], separator: str = "_") -> dict[str, Column]:
    """The parts of a label, null where their number is not that of the names."""
    parts = F.split(label, F.lit("\\Q" + separator + "\\E"), -1)
    return {n: F.when(F.size(parts) == len(names), parts[i]) for i, n in enumerate(names)}


def safe_name(value: Column) -> Column:
    """A name for a file: runs of other characters than letters, digits, dot, dash become one underscore."""
    return F.regexp_replace(F.regexp_replace(F.trim(value), r"[^A-Za-z0-9.\-]+", "_"), "^_+|_+$", "")
