"""Ranks, Spearman correlation, empirical distributions, z-scores.

All windows are partitioned by the caller's keys, so a series or map is ordered by one task and no more.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arith import position_in, safe_corr, safe_div
from ..session import ship_package, write_through


def average_rank(value: str, keys: list[str]) -> Column:
    """Rank within the keys, ties averaged, as a double; missing values have none."""
    same = Window.partitionBy(*keys, value)
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last()))
    return F.when(F.col(value).isNotNull(), rank + (F.count(F.lit(1)).over(same) - 1) / F.lit(2).cast("double"))


def paired(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, rho, n: correlation of average ranks of the pairs without missing values; null under 2 pairs or for a constant side."""
    ranked = paired(df, x, y).select(*keys, average_rank(x, keys).alias("rx"), average_rank(y, keys).alias("ry"))
    out = ranked.groupBy(*keys).agg(safe_corr("rx", "ry").alias("rho"), F.count("*").alias("n"))
    return out.withColumn("rho", F.when(F.col("n") >= 2, F.col("rho")))


def rank_table(df: DataFrame, value: str) -> DataFrame:
    """value, rank: the average rank of each distinct value in the whole table.

    For tables too large to be ordered in one task: values are counted first, so a frequent one is one row, then cut
    into buckets at approximate quantiles; ranks within a bucket start behind the counts of the buckets before it.
    """
    spark = df.sparkSession
    n = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    cuts = counted.agg(F.percentile_approx("value", [i / n for i in range(1, n)], 10_000)).first()[0] or []
    placed = counted.withColumn("bucket", position_in("value", sorted(set(cuts)), "double"))
    # a row a bucket
    sizes = sorted((r.bucket, r.n) for r in placed.groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    starts, before = [], 0
    for b, k in sizes:
        starts.append((b, before))
        before += k
    offsets = F.broadcast(spark.createDataFrame(starts, "bucket int, before long"))
    upto = F.sum("n").over(Window.partitionBy("bucket").orderBy("value"))
    return placed.join(offsets, "bucket").select("value", (F.col("before") + upto - F.col("n") + (F.col("n") + 1) / F.lit(2).cast("double")).alias("rank"))


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """``df`` with the place of each row in order of ``key``, from 1 on: sorted by ranges, no task orders the whole table."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.repartitionByRange(n, key).sortWithinPartitions(key)
    # written once, so that both uses see the same ranges
    low = 1 << 33
    placed = write_through(parts.withColumn("__id", F.monotonically_increasing_id()), "numbered").withColumn("__part", F.floor(F.col("__id") / low))
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__size"))
    # a row a range
    before = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("__part", "__before")
    return placed.join(F.broadcast(before), "__part").select(*df.columns, (F.col("__before") + F.col("__id") % low + 1).alias(name))


#: Pairs that one task may order.
ONE_TASK = 1_000_000


def spearman_whole(df: DataFrame, x: str, y: str) -> DataFrame:
    """rho, n over all rows: in one ordering up to ``ONE_TASK`` pairs, beyond by rank tables that are joined back on the values."""
    pairs = paired(df, x, y).select(F.col(x).cast("double").alias("__x"), F.col(y).cast("double").alias("__y"))
    if pairs.limit(ONE_TASK + 1).count() <= ONE_TASK:
        one = pairs.withColumn("__all", F.lit(0))
        ranked = one.select(average_rank("__x", ["__all"]).alias("rx"), average_rank("__y", ["__all"]).alias("ry"))
        out = ranked.agg(safe_corr("rx", "ry").alias("rho"), F.count("*").alias("n"))
        return out.withColumn("rho", F.when(F.col("n") >= 2, F.col("rho")))
    rx = rank_table(pairs, "__x").select(F.col("value").alias("__x"), F.col("rank").alias("rx"))
    ry = rank_table(pairs, "__y").select(F.col("value").alias("__y"), F.col("rank").alias("ry"))
    out = pairs.join(rx, "__x").join(ry, "__y").agg(safe_corr("rx", "ry").alias("rho"), F.count("*").alias("n"))
    return out.withColumn("rho", F.when(F.col("n") >= 2, F.col("rho")))


def _half_beta(x: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta I_x(a, 1/2), by the continued fraction (Lentz)."""
    from math import lgamma

    b = 0.5
    lg = np.array([lgamma(v + b) - lgamma(v) - lgamma(b) for v in a])

    def fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        tiny = 1e-300
        c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
        return h

    with np.errstate(divide="ignore"):
        front = np.exp(lg + a * np.log(x) + b * np.log1p(-x))
    swap = x > (a + 1) / (a + b + 2)
    direct = front * fraction(np.where(swap, 0.5, x), a, np.full_like(a, b)) / a
    other = 1 - front * fraction(np.where(swap, 1 - x, 0.5), np.full_like(a, b), a) / b
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, np.where(swap, other, direct)))


def p_values(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of correlations by Student's t with n - 2 degrees of freedom; missing under 3 pairs."""
    out = pd.Series(np.nan, index=rho.index)
    ok = rho.notna() & (n > 2)
    r, dof = rho[ok].to_numpy(float).clip(-1, 1), n[ok].to_numpy(float) - 2
    if len(r):
        # P(|T| > t) = I_{dof / (dof + t^2)}(dof / 2, 1/2), and dof / (dof + t^2) = 1 - r^2
        out[ok] = _half_beta(1 - r**2, dof / 2)
    return out.where(out.notna(), None)


def spearman_with_p(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    ship_package(df.sparkSession)
    return spearman(df, keys, x, y).withColumn("p", F.pandas_udf(p_values, "double")("rho", "n"))


def flow_duration_curve(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, rank, value, exceedance (per cent): rank / (n + 1) * 100 in descending order, missing values dropped."""
    kept = df.filter(F.col(value).isNotNull())
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(value).desc())).cast("long")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return kept.select(*keys, rank.alias("rank"), F.col(value).alias("value"), (rank / (n + 1).cast("double") * 100).alias("exceedance"))


def empirical_cdf(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, step, value, cdf: i / n ascending; equal values have steps of their own."""
    kept = df.filter(F.col(value).isNotNull())
    step = F.row_number().over(Window.partitionBy(*keys).orderBy(value)).cast("long")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return kept.select(*keys, step.alias("step"), F.col(value).alias("value"), (step / n.cast("double")).alias("cdf"))


def zscore(df: DataFrame, keys: list[str], value: str, name: str = "z") -> DataFrame:
    """``df`` with (value - mean) / population deviation within the keys: two aggregates and a join, no ordering."""
    stats = df.groupBy(*keys).agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__std"))
    return df.join(stats, keys).withColumn(name, safe_div(F.col(value) - F.col("__mean"), "__std")).drop("__mean", "__std")


def quantile_transform(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``df`` with ``quantile``: the share of values up to each one within the keys (exact; see ``quantile_sketch``)."""
    return df.filter(F.col(value).isNotNull()).withColumn("quantile", F.cume_dist().over(Window.partitionBy(*keys).orderBy(value)))


def quantile_sketch(df: DataFrame, keys: list[str], value: str, points: int = 100, accuracy: int = 10_000) -> DataFrame:
    """The same to 1 / ``points``, for groups too large to order in one task: approximate percentiles, then a lookup."""
    grid = [i / points for i in range(1, points + 1)]
    cuts = df.groupBy(*keys).agg(F.percentile_approx(value, grid, accuracy).alias("__cuts"))
    below = F.size(F.filter("__cuts", lambda c: c < F.col(value)))
    return df.filter(F.col(value).isNotNull()).join(cuts, keys).withColumn("quantile", F.least((below + 1) / F.lit(float(points)), F.lit(1.0))).drop("__cuts")


def quantile_merged(df: DataFrame, part: str, value: str, points: int = 100) -> DataFrame:
    """``df`` with ``quantile`` in the whole table, to 1 / ``points``: a sketch of each part (a tile), merged into one, whose grid is looked up.

    Sketches are some kilobytes whatever the part's size, so neither a part nor the whole is ordered anywhere.
    """
    sketches = df.groupBy(part).agg(F.kll_sketch_agg_double(F.col(value).cast("double")).alias("s"))
    whole = sketches.agg(F.kll_merge_agg_double("s").alias("s"))
    cuts = whole.select(F.kll_sketch_get_quantile_double("s", F.array(*[F.lit(i / points) for i in range(1, points + 1)]))).first()[0] or []
    at = position_in(F.col(value).cast("double"), list(cuts), "double")
    return df.filter(F.col(value).isNotNull()).withColumn("quantile", F.least((at + 1) / F.lit(float(points)), F.lit(1.0)))
