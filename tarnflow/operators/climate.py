"""Climatologies, cell statistics, mergeable one-pass states, relative fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arith import safe_div

MONTHS = range(1, 13)


def climatology(df: DataFrame, keys: list[str], value: str, time: str = "t") -> DataFrame:
    """keys, month, clim: twelve rows a key, missing where a month has no value; one aggregation."""
    wide = df.groupBy(*keys).agg(*[F.avg(F.when(F.month(time) == m, F.col(value))).alias(f"m{m}") for m in MONTHS])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("month"), F.col(f"m{m}").alias("clim")) for m in MONTHS])).alias("r")
    return wide.select(*keys, rows).select(*keys, "r.month", "r.clim")


def cyclic(clim: DataFrame) -> DataFrame:
    """Fourteen positions: December before January and January after December."""
    before = clim.filter("month = 12").withColumn("month", F.lit(0))
    after = clim.filter("month = 1").withColumn("month", F.lit(13))
    return clim.unionByName(before).unionByName(after)


def cell_statistics(df: DataFrame, keys: list[str], value: str, ddof: int = 0, factor: float = 1.0, deseason: bool = False, time: str = "t") -> DataFrame:
    """keys, n, mean, std of the values times ``factor``; with ``deseason`` the deviation is that from the climatology."""
    x = F.col(value) * factor
    std = F.stddev_pop if ddof == 0 else F.stddev_samp
    if not deseason:
        return df.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), std(x).alias("std"))
    month = F.month(time)
    clim = df.groupBy(*keys, month.alias("__month")).agg(F.avg(x).alias("__clim"))
    joined = df.withColumn("__month", month).join(clim, [*keys, "__month"])
    return joined.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), std(x - F.col("__clim")).alias("std"))


def partial_state(df: DataFrame, keys: list[str], value: str, time: str = "t") -> DataFrame:
    """keys, n, mean, m2, and month counts and sums: what a later part of the data can be merged with."""
    months = [f(F.when(F.month(time) == m, F.col(value))).alias(f"{p}{m}") for m in MONTHS for f, p in ((F.count, "c"), (F.sum, "s"))]
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), (F.var_pop(value) * F.count(value)).alias("m2"), *months)


def merge_states(states: DataFrame, keys: list[str]) -> DataFrame:
    """Any number of states a key into one: count-weighted means, and the spread between them added to m2."""
    n = F.sum("n")
    mean = safe_div(F.sum(F.col("n") * F.col("mean")), n)
    between = F.sum(F.col("n") * F.col("mean") ** 2) - n * mean**2
    months = [F.sum(f"{p}{m}").alias(f"{p}{m}") for m in MONTHS for p in "cs"]
    return states.groupBy(*keys).agg(n.alias("n"), mean.alias("mean"), (F.sum("m2") + F.greatest(between, F.lit(0.0))).alias("m2"), *months)


def finish_state(state: DataFrame, keys: list[str], ddof: int = 1) -> DataFrame:
    """keys, n, mean, std, clim1 .. clim12."""
    std = F.sqrt(safe_div("m2", F.col("n") - ddof))
    return state.select(*keys, "n", "mean", std.alias("std"), *[safe_div(f"s{m}", f"c{m}").alias(f"clim{m}") for m in MONTHS])


def relative_fields(pair: DataFrame, inp: str, ref: str, name: str) -> DataFrame:
    """``pair`` with input / reference: missing where the reference is 0, either is missing, or the ratio negative."""
    r = safe_div(inp, ref)
    return pair.withColumn(name, F.when(r >= 0, r))


def climate_relative_difference(clim: DataFrame, keys: list[str], inp: str = "inp", ref: str = "ref", least: float = 0.1) -> DataFrame:
    """keys, rel_diff: 100 (mean input - mean reference) / mean reference over the months; missing where no reference month reaches ``least``."""
    out = 100 * safe_div(F.avg(inp) - F.avg(ref), F.avg(ref))
    return clim.groupBy(*keys).agg(F.when(F.max(ref) >= least, out).alias("rel_diff"))


def median_over(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Medians over everything else (bootstrap iterations)."""
    return df.groupBy(*keys).agg(*[F.percentile(v, F.lit(0.5)).alias(v) for v in values])


def area_mean(df: DataFrame, time: str, values: list[str]) -> DataFrame:
    """Unweighted mean over the cells of each step."""
    return df.groupBy(time).agg(*[F.avg(v).alias(v) for v in values])


def daily_climatology(series: DataFrame, time: str, value: str) -> DataFrame:
    """month_day, value: means by calendar day of a series; February 29 is the mean of its neighbours."""
    days = series.groupBy(F.date_format(time, "MM-dd").alias("month_day")).agg(F.avg(value).alias("value"))
    near = days.filter("month_day in ('02-28', '03-01')").agg(F.avg("value").alias("value")).select(F.lit("02-29").alias("month_day"), "value")
    return days.filter("month_day <> '02-29'").unionByName(near.filter("value is not null"))


def available_years(*frames: DataFrame, time: str = "t", common: bool = True, first: int | None = None, last: int | None = None) -> DataFrame:
    """Years of all tables (``common``) or of any, clipped."""
    years = [f.select(F.year(time).alias("year")).distinct() for f in frames]
    out = years[0]
    for y in years[1:]:
        out = out.intersect(y) if common else out.union(y).distinct()
    return out.filter(F.col("year").between(first if first is not None else -9999, last if last is not None else 9999))
