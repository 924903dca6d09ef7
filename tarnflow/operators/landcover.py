"""Land-cover intervals: contiguity, half-open bounds, stacking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interval_problems(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, year_start, problem: ``gap`` or ``overlap`` with the interval before."""
    w = Window.partitionBy(*keys).orderBy("year_start")
    before = F.lag("year_end").over(w)
    kind = F.when(F.col("year_start") > before + 1, "gap").when(F.col("year_start") <= before, "overlap")
    return df.withColumn("problem", kind).filter("problem is not null").select(*keys, "year_start", "problem")


def check_intervals(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, or an error that names the first gap or overlap."""
    bad = interval_problems(df, keys).first()
    if bad is not None:
        raise ValueError(f"{bad.problem} before {bad.year_start}")
    return df


def half_open(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with dates ``lo`` and ``hi``: an interval ends where the next starts, the last after its last year."""
    w = Window.partitionBy(*keys).orderBy("year_start")
    hi = F.coalesce(F.lead("year_start").over(w), F.max("year_end").over(Window.partitionBy(*keys)) + 1)
    return df.withColumn("lo", F.make_date("year_start", F.lit(1), F.lit(1))).withColumn("hi", F.make_date(hi, F.lit(1), F.lit(1)))


def stack(grids: DataFrame, intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of every interval's grid with ``time`` in days since the first interval, and bounds; joined by ``keys`` and interval."""
    bounds = half_open(intervals, keys)
    first = F.min("lo").over(Window.partitionBy(*keys))
    timed = bounds.withColumn("time", F.datediff("lo", first)).withColumn("time_hi", F.datediff("hi", first))
    return grids.join(timed.select(*keys, "year_start", "time", "time_hi"), [*keys, "year_start"])
