"""Skill of simulated against observed series: KGE, NSE, volume error; runs, medians, year bootstrap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arith import safe_corr, safe_div
from .rank import spearman


def objectives(sim: str = "sim", obs: str = "obs") -> list[Column]:
    """Aggregates of the pairs without missing values: n, alpha, beta, gamma, kge, nse, diff, rel_diff."""
    both = F.col(sim).isNotNull() & F.col(obs).isNotNull()
    s, o = F.when(both, F.col(sim)), F.when(both, F.col(obs))
    alpha, beta, gamma = safe_div(F.stddev_pop(s), F.stddev_pop(o)), safe_div(F.avg(s), F.avg(o)), safe_corr(s, o)
    kge = 1 - F.sqrt((gamma - 1) ** 2 + (alpha - 1) ** 2 + (beta - 1) ** 2)
    nse = 1 - safe_div(F.sum((o - s) ** 2), F.var_pop(o) * F.count(o))
    diff = F.sum(s) - F.sum(o)
    named = {"n": F.count(s), "alpha": alpha, "beta": beta, "gamma": gamma, "kge": kge, "nse": nse, "diff": diff, "rel_diff": safe_div(diff, F.sum(o))}
    return [v.alias(k) for k, v in named.items()]


def skill(df: DataFrame, keys: list[str], sim: str = "sim", obs: str = "obs") -> DataFrame:
    """One row a key, in one aggregation with partial sums."""
    return df.groupBy(*keys).agg(*objectives(sim, obs))


def median_run(df: DataFrame, keys: list[str], sim: str = "sim", obs: str = "obs") -> DataFrame:
    """The median over the members of each key (and time); the observation is that of any member."""
    return df.groupBy(*keys).agg(F.percentile(sim, F.lit(0.5)).alias(sim), F.max(obs).alias(obs))


def named_runs(runs: DataFrame, obs: DataFrame, keys: list[str], name: str = "name") -> DataFrame:
    """A row of objectives per named run and key against the shared observations; ``keys`` include the time, first."""
    time, *ids = keys
    return skill(runs.join(obs, keys), [name, *ids])


def flagged_overlap(df: DataFrame, keys: list[str], time: str, sim: str = "sim", obs: str = "obs") -> DataFrame:
    """Rows from the later start to the earlier end of the two series' non-missing parts; keys with a single common step have none."""
    bounds = df.groupBy(*keys).agg(
        F.greatest(F.min(F.when(F.col(sim).isNotNull(), F.col(time))), F.min(F.when(F.col(obs).isNotNull(), F.col(time)))).alias("__lo"),
        F.least(F.max(F.when(F.col(sim).isNotNull(), F.col(time))), F.max(F.when(F.col(obs).isNotNull(), F.col(time)))).alias("__hi"),
    )
    return df.join(bounds.filter("__hi > __lo"), keys).filter(F.col(time).between(F.col("__lo"), F.col("__hi"))).drop("__lo", "__hi")


def draws(years: DataFrame, iterations: int, size: int | None = None, seed: int = 0) -> DataFrame:
    """(iter, year, times): years drawn with replacement, reproducibly, ``size`` (default: their number) an iteration.

    ``years`` is a table of distinct years, a few hundred at most, and numbered in order of time.
    """
    listed = years.select(F.col("year").cast("int").alias("year")).distinct().groupBy().agg(F.array_sort(F.collect_set("year")).alias("ys"))
    n = F.size("ys") if size is None else F.lit(size)
    tries = listed.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))).filter(F.size("ys") > 0).withColumn("k", F.explode(F.sequence(F.lit(0), n - 1)))
    text = F.concat_ws("|", F.lit(str(seed)), F.col("iter").cast("string"), F.col("k").cast("string"))
    pick = F.pmod(F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long"), F.size("ys").cast("long")).cast("int")
    return tries.select("iter", F.element_at("ys", pick + 1).alias("year")).groupBy("iter", "year").agg(F.count("*").alias("times"))


def bootstrap_skill(df: DataFrame, years: DataFrame, sim: str = "sim", obs: str = "obs", time: str = "t") -> DataFrame:
    """iter, id, alpha (ratio of means), beta (ratio of deviations), gamma (Spearman of monthly climatologies).

    ``years``: draws, the same for both series.  A year enters as its sums, so a draw repeats a few
    numbers and not its steps.
    """
    moments = [F.count(c).alias(f"n_{c}") for c in (sim, obs)] + [F.sum(c).alias(f"s_{c}") for c in (sim, obs)] + [F.sum(F.col(c) ** 2).alias(f"q_{c}") for c in (sim, obs)]
    per_month = df.groupBy("id", F.year(time).alias("year"), F.month(time).alias("month")).agg(*moments)
    drawn = per_month.join(years, "year")
    total = lambda c: F.sum(F.col(c) * F.col("times"))
    mean = {c: safe_div(total(f"s_{c}"), total(f"n_{c}")) for c in (sim, obs)}
    deviation = {c: F.sqrt(F.greatest(safe_div(total(f"q_{c}"), total(f"n_{c}")) - mean[c] ** 2, F.lit(0.0))) for c in (sim, obs)}
    whole = drawn.groupBy("iter", "id").agg(safe_div(mean[sim], mean[obs]).alias("alpha"), safe_div(deviation[sim], deviation[obs]).alias("beta"))
    clim = drawn.groupBy("iter", "id", "month").agg(mean[sim].alias("cs"), mean[obs].alias("co"))
    gamma = spearman(clim, ["iter", "id"], "cs", "co").select("iter", "id", F.col("rho").alias("gamma"))
    return whole.join(gamma, ["iter", "id"], "left")


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the order given (repeated time stamps, repeated ids)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def best_rows(df: DataFrame, group: list[str], value: str, aim: str) -> DataFrame:
    """The best rows of each group, ties included: ``aim`` is one, zero, max or min.

    A window, no join with the groups' best: rows would be computed twice, and sums that arrive in another order would not equal their own best.
    """
    score = {"one": -F.abs(F.col(value) - 1), "zero": -F.abs(F.col(value)), "max": F.col(value), "min": -F.col(value)}[aim]
    scored = df.filter(F.col(value).isNotNull()).withColumn("__score", score)
    best = F.max("__score").over(Window.partitionBy(*group))
    return scored.withColumn("__best", best).filter(F.col("__score") == F.col("__best")).drop("__score", "__best")


def taylor_statistics(df: DataFrame, series: str, sim: str = "sim", obs: str = "obs", scale: bool = True) -> DataFrame:
    """series, std, correlation, crmse: the numbers of a Taylor diagram; with ``scale`` by the observations' deviation."""
    both = df.filter(F.col(sim).isNotNull() & F.col(obs).isNotNull())
    std, ref = F.stddev_pop(sim), F.stddev_pop(obs)
    centred = F.sqrt(F.greatest(F.var_pop(sim) + F.var_pop(obs) - 2 * F.covar_pop(sim, obs), F.lit(0.0)))
    unit = ref if scale else F.lit(1.0)
    return both.groupBy(series).agg(safe_div(std, unit).alias("std"), safe_corr(sim, obs).alias("correlation"), safe_div(centred, unit).alias("crmse"), F.count("*").alias("n"))
