"""Queries over pairs of maps: spatial pattern scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import patterns, rank
from .registry import query
from .views import MAP_PAIR, map_pair

STATS = "CASE WHEN stddev_pop(sim) * stddev_pop(obs) > 0 THEN covar_pop(sim, obs) / (stddev_pop(sim) * stddev_pop(obs)) END"
CV = "(stddev_pop(sim) / nullif(avg(sim), 0)) / nullif(stddev_pop(obs) / nullif(avg(obs), 0), 0)"

SPAEF = f"""st AS (SELECT t, {STATS} alpha, {CV} beta, CAST(round_even(sqrt(count(*)), 0) AS BIGINT) b, min(sim) slo, max(sim) shi, min(obs) olo, max(obs) ohi FROM map_pair GROUP BY t),
  hb AS (SELECT t, least(CAST(floor((sim - slo) / (shi - slo) * b) AS BIGINT), b - 1) k, 1 s, 0 o FROM map_pair JOIN st USING (t)
         UNION ALL SELECT t, least(CAST(floor((obs - olo) / (ohi - olo) * b) AS BIGINT), b - 1), 0, 1 FROM map_pair JOIN st USING (t)),
  hs AS (SELECT t, k, sum(s) ns, sum(o) no FROM hb GROUP BY t, k),
  ov AS (SELECT t, sum(least(ns, no)) / CAST(sum(no) AS DOUBLE) gamma FROM hs GROUP BY t),
  spaef AS (SELECT t, 1 - sqrt((alpha - 1) ** 2 + (beta - 1) ** 2 + (gamma - 1) ** 2) spaef, alpha, beta, gamma FROM st JOIN ov USING (t))"""

RANKS = """rk AS (SELECT t, rank() OVER (PARTITION BY t ORDER BY sim) + (count(*) OVER (PARTITION BY t, sim) - 1) / 2.0 rs,
  rank() OVER (PARTITION BY t ORDER BY obs) + (count(*) OVER (PARTITION BY t, obs) - 1) / 2.0 ro FROM map_pair),
  sp AS (SELECT t, covar_pop(rs, ro) / nullif(stddev_pop(rs) * stddev_pop(ro), 0) rs FROM rk GROUP BY t)"""

ESP = f"""{RANKS}, zs AS (SELECT t, sim, obs, (sim - avg(sim) OVER w) / stddev_pop(sim) OVER w zs, (obs - avg(obs) OVER w) / stddev_pop(obs) OVER w zo FROM map_pair WINDOW w AS (PARTITION BY t)),
  ep AS (SELECT t, {CV} gamma, 1 - sqrt(avg((zs - zo) ** 2)) alpha FROM zs GROUP BY t),
  esp AS (SELECT t, 1 - sqrt((rs - 1) ** 2 + (gamma - 1) ** 2 + (alpha - 1) ** 2) esp, rs, gamma, alpha FROM ep JOIN sp USING (t))"""

MSPAEF = f"""mp AS (SELECT t, quantile_cont(obs, 0.75) - quantile_cont(obs, 0.25) iqr, sqrt(avg((sim - obs) ** 2)) rmse, stddev_pop(sim) / nullif(stddev_pop(obs), 0) sigma, abs(avg(sim) - avg(obs)) b, {STATS} rho FROM map_pair GROUP BY t),
  mq AS (SELECT t, rmse / iqr nrmse, sigma, sqrt((sigma ** 2 - 1) ** 2 + (1 / sigma ** 2 - 1) ** 2) sigma_error, b / iqr bias, rho FROM mp),
  mspaef AS (SELECT t, 1 - sqrt(nrmse ** 2 + sigma_error ** 2 + bias ** 2 + (1 - rho) ** 2) / 2 mspaef, nrmse, sigma, sigma_error, bias, rho FROM mq)"""

WASPAEF = f"""wn AS (SELECT t, sim, obs, row_number() OVER (PARTITION BY t ORDER BY sim) i, row_number() OVER (PARTITION BY t ORDER BY obs) j FROM map_pair),
  wd AS (SELECT a.t, sqrt(avg((a.sim - b.obs) ** 2)) wd FROM wn a JOIN wn b ON a.t = b.t AND a.i = b.j GROUP BY a.t),
  wp AS (SELECT t, {STATS} rho, stddev_pop(sim) / nullif(stddev_pop(obs), 0) sigma FROM map_pair GROUP BY t),
  waspaef AS (SELECT t, sqrt((rho - 1) ** 2 + (sigma - 1) ** 2 + wd ** 2) waspaef, rho, sigma, wd FROM wp JOIN wd USING (t))"""

TSM = """ga AS (SELECT avg(sim) / avg(obs) general_beta, stddev_pop(sim) / stddev_pop(obs) spatial_alpha FROM map_pair),
  am AS (SELECT t, avg(sim) sim, avg(obs) obs FROM map_pair GROUP BY t),
  ta AS (SELECT stddev_pop(sim) / stddev_pop(obs) temporal_alpha FROM am),
  tr AS (SELECT rank() OVER (ORDER BY sim) + (count(*) OVER (PARTITION BY sim) - 1) / 2.0 a, rank() OVER (ORDER BY obs) + (count(*) OVER (PARTITION BY obs) - 1) / 2.0 b FROM am),
  tg AS (SELECT covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) temporal_gamma FROM tr),
  sr AS (SELECT rank() OVER (ORDER BY sim - 1) + (count(*) OVER (PARTITION BY sim - 1) - 1) / 2.0 a, rank() OVER (ORDER BY obs - 1) + (count(*) OVER (PARTITION BY obs - 1) - 1) / 2.0 b FROM map_pair),
  sg AS (SELECT covar_pop(a, b) / (stddev_pop(a) * stddev_pop(b)) spatial_gamma FROM sr),
  tsm AS (SELECT general_beta, temporal_gamma, temporal_alpha, spatial_gamma, spatial_alpha,
    1 - sqrt(((1 - general_beta) ** 2 + (1 - temporal_gamma) ** 2 + (1 - temporal_alpha) ** 2 + (1 - spatial_gamma) ** 2 + (1 - spatial_alpha) ** 2) * 3 / 5) comb FROM ga, ta, tg, sg)"""


@query("a15_spaef", f"WITH {MAP_PAIR}, {SPAEF} SELECT * FROM spaef", "spaef alpha beta gamma")
def spaef(spark, sf):
    """SPAEF of each step."""
    return patterns.spaef(map_pair(spark, sf), ["t"])


@query("a16_esp", f"WITH {MAP_PAIR}, {ESP} SELECT * FROM esp", "esp rs gamma alpha")
def esp(spark, sf):
    """ESP of each step."""
    return patterns.esp(map_pair(spark, sf), ["t"])


@query("a17_mspaef", f"WITH {MAP_PAIR}, {MSPAEF} SELECT * FROM mspaef", "mspaef nrmse sigma sigma_error bias rho")
def mspaef(spark, sf):
    """MSPAEF of each step."""
    return patterns.mspaef(map_pair(spark, sf), ["t"])


@query("a18_waspaef", f"WITH {MAP_PAIR}, {WASPAEF} SELECT * FROM waspaef", "waspaef rho sigma wd")
def waspaef(spark, sf):
    """WASPAEF of each step."""
    return patterns.waspaef(map_pair(spark, sf), ["t"])


@query("a19_mean_score", f"WITH {MAP_PAIR}, {SPAEF} SELECT avg(spaef) spaef, avg(alpha) alpha, avg(beta) beta, avg(gamma) gamma FROM spaef", "spaef alpha beta gamma")
def mean_score(spark, sf):
    """Mean of each component over the steps."""
    return patterns.average_over_steps(patterns.spaef(map_pair(spark, sf), ["t"]), "t")


@query("a20_tsm", f"WITH {MAP_PAIR}, {TSM} SELECT * FROM tsm", "general_beta temporal_gamma temporal_alpha spatial_gamma spatial_alpha comb")
def tsm(spark, sf):
    """TSM of the whole pair."""
    return patterns.tsm(map_pair(spark, sf), "t")


AVERAGES = " UNION ALL ".join(
    f"SELECT '{m}' metric, unnest([{', '.join(repr(c) for c in cols)}]) component, unnest([{', '.join(f'avg({c})' for c in cols)}]) AS value FROM {m.lower()}"
    for m, cols in {
        "TSM": ["general_beta", "temporal_gamma", "temporal_alpha", "spatial_gamma", "spatial_alpha", "comb"], "SPAEF": ["spaef", "alpha", "beta", "gamma"], "ESP": ["esp", "rs", "gamma", "alpha"],
        "MSPAEF": ["mspaef", "nrmse", "sigma", "sigma_error", "bias", "rho"], "WASPAEF": ["waspaef", "rho", "sigma", "wd"],
    }.items()
)


@query("a25_all_metrics", f"WITH {MAP_PAIR}, {SPAEF}, {ESP}, {MSPAEF}, {WASPAEF}, {TSM} {AVERAGES}", "value")
def all_metrics(spark, sf):
    """Every score, one table."""
    return patterns.all_metrics(map_pair(spark, sf), "t")


@query("a23_norm_deviation", f"WITH {MAP_PAIR} SELECT t, yi, xi, sim - 1 AS dev FROM map_pair", "dev")
def norm_deviation(spark, sf):
    """The value less mean over mean of its step."""
    return map_pair(spark, sf).select("t", "yi", "xi", patterns.norm_deviation("sim", "t").alias("dev"))


@query("w04_zscore", f"WITH {MAP_PAIR} SELECT t, yi, xi, (sim - avg(sim) OVER (PARTITION BY t)) / nullif(stddev_pop(sim) OVER (PARTITION BY t), 0) z FROM map_pair", "z")
def zscore(spark, sf):
    """Z-scores of each step."""
    return rank.zscore(map_pair(spark, sf), ["t"], "sim").select("t", "yi", "xi", "z")


@query("a40_quantile_transform", f"WITH {MAP_PAIR} SELECT t, yi, xi, cume_dist() OVER (PARTITION BY t ORDER BY sim) quantile FROM map_pair", "quantile")
def quantile_transform(spark, sf):
    """Empirical distribution applied to its own values."""
    return rank.quantile_transform(map_pair(spark, sf), ["t"], "sim").select("t", "yi", "xi", "quantile")


@query("a40_quantile_sketch", None, "quantile")
def quantile_sketch(spark, sf):
    """The same from approximate percentiles."""
    return rank.quantile_sketch(map_pair(spark, sf).withColumn("one", F.lit(1)), ["one"], "sim").select("t", "yi", "xi", "quantile")
