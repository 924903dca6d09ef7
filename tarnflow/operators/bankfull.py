"""Bankfull discharge: the yearly maximum whose recurrence is nearest to the return period."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def bankfull_discharge(df: DataFrame, keys: list[str], value: str, return_period: float = 1.5, time: str = "t") -> DataFrame:
    """keys, q_bkfl, perimeter: of n yearly maxima in descending order the m-th recurs every (n + 1) / m years.

    A key with a year that lacks a value has none; the first of equally near ranks counts.  Perimeter: 4.8 sqrt(q) where q > 0, else q.
    """
    years = df.groupBy(*keys, F.year(time).alias("__year")).agg(F.max(value).alias("__q"))
    w = Window.partitionBy(*keys)
    ranked = years.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__some", F.count("__q").over(w)).withColumn("__m", F.row_number().over(w.orderBy(F.col("__q").desc_nulls_last())))
    off = F.abs((F.col("__n") + 1) / F.col("__m").cast("double") - return_period)
    out = ranked.groupBy(*keys).agg(F.min_by("__q", F.struct(off, F.col("__m"))).alias("q"), F.max(F.col("__n") == F.col("__some")).alias("__whole"))
    q = F.when(F.col("__whole"), F.col("q"))
    return out.select(*keys, q.alias("q_bkfl"), F.when(q > 0, 4.8 * F.sqrt(q)).otherwise(q).alias("perimeter"))


def yearly_peaks(df: DataFrame, keys: list[str], value: str, k: int, time: str = "t") -> DataFrame:
    """The k largest yearly maxima of each key."""
    years = df.groupBy(*keys, F.year(time).alias("year")).agg(F.max(value).alias("peak"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("peak").desc_nulls_last(), "year"))
    return years.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k)
