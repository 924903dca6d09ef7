"""Arithmetic that treats missing values and zero denominators as missing."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the sentinel for missing cells on disk.
NODATA = -9999.0


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str, nodata: float | None = None) -> Column:
    """NaN, infinities and the sentinel become null."""
    x = col(x).cast("double")
    bad = F.isnan(x) | (F.abs(x) == float("inf"))
    if nodata is not None:
        bad = bad | (x == nodata)
    return F.when(~bad, x)


def safe_div(x: Column | str, y: Column | str) -> Column:
    """x / y in double, null where y is 0 or either is missing."""
    return col(x).cast("double") / F.nullif(col(y).cast("double"), F.lit(0.0))


def safe_corr(x: Column | str, y: Column | str) -> Column:
    """Pearson correlation of the pairs without missing values; null where a side is constant."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return safe_div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def difference(ref: Column | str, model: Column | str) -> Column:
    return col(ref) - col(model)


def ratio(model: Column | str, ref: Column | str) -> Column:
    return safe_div(model, ref)


def relative_difference(ref: Column | str, model: Column | str) -> Column:
    return safe_div(col(ref) - col(model), ref)


def round_half_even(x: Column | str, digits: int = 0) -> Column:
    return F.bround(col(x), digits)


def snap_to_multiple(x: Column | str, step: float) -> Column:
    """A coordinate a few rounding errors from a multiple of ``step`` becomes that multiple."""
    x = col(x)
    near = F.round(x / step) * step
    tolerance = 4096 * 2.220446049250313e-16 * F.greatest(F.abs(x), F.lit(abs(step)), F.lit(1.0))
    return F.when(F.abs(x - near) <= tolerance, near).otherwise(x)


def index_distance_100m(dy: Column | str, dx: Column | str, step: float) -> Column:
    """Distance between cells in 100 m, with one length of a degree for both axes."""
    return F.sqrt(col(dy) ** 2 + col(dx) ** 2) * step * 111132.92 / 100


def position_in(value: Column | str, cuts: list, kind: str) -> Column:
    """How many of the sorted ``cuts`` are below the value: two looks at about the square root of their number, not one at each."""
    value, n = col(value), len(cuts)
    step = max(1, math.isqrt(n))
    below = lambda array: F.size(F.filter(array.cast(f"array<{kind}>"), lambda c: c < value))
    if n <= 2 * step:
        return below(F.lit(list(cuts)))
    stretch = below(F.lit(list(cuts[step - 1 :: step]))) * step
    return stretch + below(F.slice(F.lit(list(cuts)), stretch + 1, F.lit(step)))
