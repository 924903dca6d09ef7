"""Limits and labels of figures, memory strings, stable orders: small rules on numbers and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (above, steps in one, digits): a half range above the first is rounded to the steps, and labelled with so many digits.
LABEL_STEPS = [(1.4, 2, 2), (0.15, 5, 2), (0.015, 50, 3), (0.0015, 500, 4), (0.00015, 5000, 5), (0.0, 50000, 6)]
#: Limits of scores that have usual ones, of colours and of distributions.
COLOUR_LIMITS = {"kge": (-0.5, 1.0), "nse": (-0.1, 1.0)}
CURVE_LIMITS = {"kge": (-0.5, 1.0), "nse": (-0.5, 1.0)}
#: Gigabytes in a unit.
MEMORY = {"kb": 1e-6, "mb": 1e-3, "gb": 1.0}


def label_step(value: Column) -> tuple[Column, Column]:
    """(half range rounded to a step, digits of its labels); none or no number: a millionth."""
    x = F.abs(value)
    empty = value.isNull() | F.isnan(value) | (x == float("inf")) | (x == 0)
    rounded, digits = F.lit(1e-6), F.lit(6)
    for above, steps, places in reversed(LABEL_STEPS):
        rounded = F.when(x > above, F.greatest(F.bround(x * steps, 0) / steps, F.lit(1 / steps))).otherwise(rounded)
        digits = F.when(x > above, places).otherwise(digits)
    return F.when(empty, 1e-6).otherwise(rounded), F.when(empty, 6).otherwise(digits)


def curve_limits(df: DataFrame, name: str, value: str) -> DataFrame:
    """name, lo, hi of the axis of each metric's distribution: its values, without tails beyond -2 and 3, at most 3 to each side of the median where it is wide."""
    q = df.groupBy(name).agg(F.min(value).alias("a"), F.max(value).alias("b"), F.percentile(value, F.array(*map(F.lit, (0.05, 0.5, 0.95)))).alias("q"))
    lo, hi = F.when(F.col("a") > -2, F.col("a")).otherwise(F.col("q")[0]), F.when(F.col("b") < 3, F.col("b")).otherwise(F.col("q")[2])
    wide = hi - lo > 6
    lo, hi = F.when(wide, F.greatest(lo, F.col("q")[1] - 3)).otherwise(lo), F.when(wide, F.least(hi, F.col("q")[1] + 3)).otherwise(hi)
    usual = lambda i: F.coalesce(*[F.when(F.col(name) == k, F.lit(v[i])) for k, v in CURVE_LIMITS.items()])
    return q.select(name, F.coalesce(usual(0), lo).alias("lo"), F.coalesce(usual(1), hi).alias("hi"))


def colour_limits(df: DataFrame, name: str, value: str) -> DataFrame:
    """name, lo, hi, extend (neither, min, max, both: which side values lie beyond) of each metric's colours; one value gets one to each side."""
    q = df.filter(F.col(value).isNotNull()).groupBy(name).agg(F.min(value).alias("a"), F.max(value).alias("b"))
    usual = lambda i: F.coalesce(*[F.when(F.col(name) == k, F.lit(v[i])) for k, v in COLOUR_LIMITS.items()])
    q = q.select(name, "a", "b", F.coalesce(usual(0), F.col("a")).alias("lo"), F.coalesce(usual(1), F.col("b")).alias("hi"))
    one = F.when(F.col("lo") == F.col("hi"), 1.0).otherwise(0.0)
    q = q.select(name, "a", "b", (F.col("lo") - one).alias("lo"), (F.col("hi") + one).alias("hi"))
    below, above = F.col("a") < F.col("lo"), F.col("b") > F.col("hi")
    return q.select(name, "lo", "hi", F.when(below & above, "both").when(below, "min").when(above, "max").otherwise("neither").alias("extend"))


def memory_gb(text: str | None) -> int | None:
    """Whole gigabytes of ``10MB``, ``2gb``; a plain number is taken times 10**9, as the studied tool does."""
    if text is None:
        return None
    low = text.lower().strip()
    return int(int(low[:-2]) * MEMORY[low[-2:]] + 1e-9) if low[-2:] in MEMORY else int(low) * 10**9


def natural_order(value: Column) -> Column:
    """A key that orders ids by number where they are numbers, then the others as text."""
    text = F.trim(value.cast("string"))
    number = text.try_cast("double")
    return F.struct(number.isNull().alias("text"), F.coalesce(number, F.lit(0.0)).alias("number"), text.alias("id"))
