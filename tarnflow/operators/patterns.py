"""Spatial pattern scores per key (a time step, a month): SPAEF, ESP, MSPAEF, WASPAEF, and TSM.

Input: a row per cell with ``sim`` and ``obs``; pairs with a missing side are left out.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arith import safe_corr, safe_div
from ..session import ship_package
from .rank import average_rank, paired, spearman, spearman_whole, zscore


def _gap(*errors) -> F.Column:
    return F.sqrt(sum(e**2 for e in errors))


def spaef(df: DataFrame, keys: list[str], sim: str = "sim", obs: str = "obs") -> DataFrame:
    """keys, spaef, alpha (Pearson), beta (ratio of CVs), gamma (overlap of histograms of z-scores, each on its own range)."""
    pairs = paired(df, sim, obs)
    cv = {c: safe_div(F.stddev_pop(c), F.avg(c)) for c in (sim, obs)}
    stats = pairs.groupBy(*keys).agg(
        safe_corr(sim, obs).alias("alpha"), safe_div(cv[sim], cv[obs]).alias("beta"), F.bround(F.sqrt(F.count("*").cast("double")), 0).cast("long").alias("bins"),
        *[f(c).alias(f"__{n}_{c}") for c in (sim, obs) for n, f in (("lo", F.min), ("hi", F.max))],
    )
    placed = pairs.join(stats, keys)
    # a z-score's bin on its own range is the value's bin on the value's range
    sides = []
    for c in (sim, obs):
        share = safe_div(F.col(c) - F.col(f"__lo_{c}"), F.col(f"__hi_{c}") - F.col(f"__lo_{c}"))
        sides.append(F.struct(F.least(F.floor(share * F.col("bins")), F.col("bins") - 1).alias("bin"), F.lit(int(c == sim)).alias("side")))
    counted = placed.select(*keys, F.explode(F.array(*sides)).alias("b")).groupBy(*keys, "b.bin").agg(F.sum("b.side").alias("ns"), F.sum(1 - F.col("b.side")).alias("no"))
    overlap = counted.groupBy(*keys).agg(safe_div(F.sum(F.least("ns", "no")), F.sum("no")).alias("gamma"))
    out = stats.select(*keys, "alpha", "beta").join(overlap, keys)
    return out.select(*keys, (1 - _gap(F.col("alpha") - 1, F.col("beta") - 1, F.col("gamma") - 1)).alias("spaef"), "alpha", "beta", "gamma")


def esp(df: DataFrame, keys: list[str], sim: str = "sim", obs: str = "obs") -> DataFrame:
    """keys, esp, rs (Spearman), gamma (ratio of CVs), alpha (1 - RMSE of z-scores)."""
    pairs = paired(df, sim, obs)
    cv = {c: safe_div(F.stddev_pop(c), F.avg(c)) for c in (sim, obs)}
    scored = zscore(zscore(pairs, keys, sim, "__zs"), keys, obs, "__zo")
    parts = scored.groupBy(*keys).agg(safe_div(cv[sim], cv[obs]).alias("gamma"), (1 - F.sqrt(F.avg((F.col("__zs") - F.col("__zo")) ** 2))).alias("alpha"))
    out = parts.join(spearman(pairs, keys, sim, obs).select(*keys, F.col("rho").alias("rs")), keys)
    return out.select(*keys, (1 - _gap(F.col("rs") - 1, F.col("gamma") - 1, F.col("alpha") - 1)).alias("esp"), "rs", "gamma", "alpha")


def mspaef(df: DataFrame, keys: list[str], sim: str = "sim", obs: str = "obs") -> DataFrame:
    """keys, mspaef, nrmse, sigma, sigma_error, bias, rho; errors in units of the observed interquartile range."""
    parts = paired(df, sim, obs).groupBy(*keys).agg(
        F.percentile(obs, F.array(F.lit(0.25), F.lit(0.75))).alias("__q"), F.sqrt(F.avg((F.col(sim) - F.col(obs)) ** 2)).alias("__rmse"),
        safe_div(F.stddev_pop(sim), F.stddev_pop(obs)).alias("sigma"), F.abs(F.avg(sim) - F.avg(obs)).alias("__bias"), safe_corr(sim, obs).alias("rho"),
    )
    iqr = F.col("__q")[1] - F.col("__q")[0]
    sigma2 = F.col("sigma") ** 2
    out = parts.select(*keys, safe_div("__rmse", iqr).alias("nrmse"), "sigma", _gap(sigma2 - 1, safe_div(F.lit(1.0), sigma2) - 1).alias("sigma_error"), safe_div("__bias", iqr).alias("bias"), "rho")
    total = 1 - _gap(F.col("nrmse"), F.col("sigma_error"), F.col("bias"), 1 - F.col("rho")) / 2
    return out.select(*keys, total.alias("mspaef"), "nrmse", "sigma", "sigma_error", "bias", "rho")


def waspaef(df: DataFrame, keys: list[str], sim: str = "sim", obs: str = "obs") -> DataFrame:
    """keys, waspaef (lower is better), rho, sigma, wd (RMS difference of the sorted values)."""
    pairs = paired(df, sim, obs)
    parts = pairs.groupBy(*keys).agg(safe_corr(sim, obs).alias("rho"), safe_div(F.stddev_pop(sim), F.stddev_pop(obs)).alias("sigma"))
    sides = [pairs.select(*keys, F.col(c).alias(f"__{c}"), F.row_number().over(Window.partitionBy(*keys).orderBy(c)).alias("__n")) for c in (sim, obs)]
    wd = sides[0].join(sides[1], [*keys, "__n"]).groupBy(*keys).agg(F.sqrt(F.avg((F.col(f"__{sim}") - F.col(f"__{obs}")) ** 2)).alias("wd"))
    out = parts.join(wd, keys)
    return out.select(*keys, _gap(F.col("rho") - 1, F.col("sigma") - 1, F.col("wd")).alias("waspaef"), "rho", "sigma", "wd")


def norm_deviation(value: str, time: str) -> F.Column:
    """The value minus mean / mean of its step, that is minus 1: the form that the studied tests pin."""
    mean = F.avg(value).over(Window.partitionBy(time))
    return F.col(value) - safe_div(mean, mean)


def tsm(df: DataFrame, time: str, sim: str = "sim", obs: str = "obs") -> DataFrame:
    """One row: general_beta, temporal_gamma, temporal_alpha, spatial_gamma, spatial_alpha, comb.

    General: ratio of means.  Temporal: on area means.  Spatial: on the deviations, ranked over all
    cells and steps (by rank tables, not in one task).
    """
    # a step's mean minus itself over itself is value - 1 wherever the mean is defined and not 0
    pairs = paired(df, sim, obs).select(time, sim, obs)
    moved = pairs.select((F.col(sim) - 1).alias(sim), (F.col(obs) - 1).alias(obs))
    means = df.groupBy(time).agg(F.avg(sim).alias(sim), F.avg(obs).alias(obs)).select(sim, obs)
    spread = safe_div(F.stddev_pop(sim), F.stddev_pop(obs))
    # each of these is one row
    parts = [
        pairs.agg(safe_div(F.avg(sim), F.avg(obs)).alias("general_beta"), spread.alias("spatial_alpha")), paired(means, sim, obs).agg(spread.alias("temporal_alpha")),
        spearman_whole(means, sim, obs).select(F.col("rho").alias("temporal_gamma")), spearman_whole(moved, sim, obs).select(F.col("rho").alias("spatial_gamma")),
    ]
    out = parts[0].withColumn("__one", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("__one", F.lit(1)), "__one")
    names = ["general_beta", "temporal_gamma", "temporal_alpha", "spatial_gamma", "spatial_alpha"]
    comb = 1 - F.sqrt(sum((1 - F.col(n)) ** 2 for n in names) * 3 / 5)
    return out.select(*names, comb.alias("comb"))


SCORES = {"SPAEF": spaef, "ESP": esp, "MSPAEF": mspaef, "WASPAEF": waspaef}


def metric(name: str, df: DataFrame, keys: list[str], **kw) -> DataFrame:
    """Dispatch by name; TSM is the default of the studied tool and takes the first key as its time."""
    name = (name or "TSM").upper()
    if name == "TSM":
        return tsm(df, keys[0], **kw)
    if name not in SCORES:
        raise ValueError(f"unknown metric {name}")
    return SCORES[name](df, keys, **kw)


def all_metrics(df: DataFrame, time: str, **kw) -> DataFrame:
    """metric, component, value: every score, those per step averaged over the steps."""
    out = None
    for name in ["TSM", *SCORES]:
        one = metric(name, df, [time], **kw) if name == "TSM" else average_over_steps(metric(name, df, [time], **kw), time)
        cols = one.columns
        rows = one.select(F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.lit(c).alias("component"), F.col(c).alias("value")) for c in cols])).alias("r")).select("r.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def user_metric(df: DataFrame, keys: list[str], func: Callable[..., float], *args, sim: str = "sim", obs: str = "obs", name: str = "value", **kwargs) -> DataFrame:
    """keys, value: a caller's ``func(sim, obs, *args, **kwargs)`` over the arrays of each key (a step's map, a pixel's series), both sides in order of the remaining columns.

    Pairs with a missing side reach it as NaN.  Arrow hands whole keys over, so a key's rows must fit a task; the scores above have no such bound.
    """
    rest = [c for c in df.columns if c not in (*keys, sim, obs)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(rest, kind="stable") if rest else pdf
        got = func(pdf[sim].to_numpy(float), pdf[obs].to_numpy(float), *args, **kwargs)
        return pdf[keys].head(1).assign(**{name: None if got is None else float(got)})

    ship_package(df.sparkSession)
    return df.groupBy(*keys).applyInPandas(run, df.select(*keys).schema.add(name, "double"))


def average_over_steps(scores: DataFrame, time: str) -> DataFrame:
    """The mean of each component over the steps, missing ones left out."""
    return scores.agg(*[F.avg(c).alias(c) for c in scores.columns if c != time])


def ranked_cells(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.withColumn("rank", average_rank(value, keys))
