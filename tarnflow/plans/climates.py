"""Queries over gridded series: climatologies, statistics, relative fields."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arith import difference, ratio, relative_difference
from ..operators import climate, rank
from .registry import query
from .views import GRID_TS, grid_ts


@query("a05_climatology", f"WITH {GRID_TS}, c AS (SELECT yi, xi, CAST(month(t) AS INT) AS month, avg(ref) clim FROM grid_ts GROUP BY ALL) SELECT k.yi, k.xi, CAST(m.month AS INT) AS month, c.clim FROM (SELECT DISTINCT yi, xi FROM grid_ts) k CROSS JOIN (SELECT unnest(range(1, 13)) AS month) m LEFT JOIN c ON c.yi = k.yi AND c.xi = k.xi AND c.month = m.month", "clim")
def climatology(spark, sf):
    """A5: monthly climatology of each cell, twelve rows."""
    return climate.climatology(grid_ts(spark, sf), ["yi", "xi"], "ref")


@query("a06_cyclic_climatology", f"WITH {GRID_TS}, c AS (SELECT yi, CAST(month(t) AS INT) AS month, avg(ref) clim FROM grid_ts GROUP BY ALL) SELECT yi, month, clim FROM c UNION ALL SELECT yi, 0, clim FROM c WHERE month = 12 UNION ALL SELECT yi, 13, clim FROM c WHERE month = 1", "clim")
def cyclic_climatology(spark, sf):
    """With December before and January after."""
    return climate.cyclic(climate.climatology(grid_ts(spark, sf), ["yi"], "ref"))


@query("a08_cell_statistics", f"WITH {GRID_TS} SELECT yi, xi, count(ref) n, avg(ref * CAST(0.5 AS DOUBLE)) mean, stddev_pop(ref * CAST(0.5 AS DOUBLE)) std FROM grid_ts GROUP BY yi, xi", "mean std")
def cell_statistics(spark, sf):
    """Scaled mean and population deviation of each cell."""
    return climate.cell_statistics(grid_ts(spark, sf), ["yi", "xi"], "ref", factor=0.5)


@query("a07_deseasonalised_std", f"WITH {GRID_TS}, d AS (SELECT yi, xi, ref, ref - avg(ref) OVER (PARTITION BY yi, xi, month(t)) r FROM grid_ts) SELECT yi, xi, count(ref) n, avg(ref) mean, stddev_pop(r) std FROM d GROUP BY yi, xi", "mean std")
def deseasonalised_std(spark, sf):
    """Deviation from the climatology."""
    return climate.cell_statistics(grid_ts(spark, sf), ["yi", "xi"], "ref", deseason=True)


@query("a11_one_pass_statistics", f"WITH {GRID_TS} SELECT yi, xi, count(inp) n, avg(inp) mean, stddev_samp(inp) std, " + ", ".join(f"avg(inp) FILTER (month(t) = {m}) clim{m}" for m in range(1, 13)) + " FROM grid_ts GROUP BY yi, xi", "mean std " + " ".join(f"clim{m}" for m in range(1, 13)))
def one_pass_statistics(spark, sf):
    """States per year, merged, finished."""
    ts = grid_ts(spark, sf).withColumn("part", F.year("t"))
    return climate.finish_state(climate.merge_states(climate.partial_state(ts, ["yi", "xi", "part"], "inp"), ["yi", "xi"]), ["yi", "xi"])


@query("a12_relative_fields", f"WITH {GRID_TS}, s AS (SELECT yi, xi, avg(inp) im, avg(ref) rm, stddev_pop(inp) AS isd, stddev_pop(ref) rsd FROM grid_ts GROUP BY yi, xi) SELECT yi, xi, CASE WHEN im / nullif(rm, 0) >= 0 THEN im / nullif(rm, 0) END rel_mean, CASE WHEN isd / nullif(rsd, 0) >= 0 THEN isd / nullif(rsd, 0) END rel_std FROM s", "rel_mean rel_std")
def relative_fields(spark, sf):
    """Ratios of means and deviations."""
    stats = grid_ts(spark, sf).groupBy("yi", "xi").agg(F.avg("inp").alias("im"), F.avg("ref").alias("rm"), F.stddev_pop("inp").alias("isd"), F.stddev_pop("ref").alias("rsd"))
    return climate.relative_fields(climate.relative_fields(stats, "im", "rm", "rel_mean"), "isd", "rsd", "rel_std").select("yi", "xi", "rel_mean", "rel_std")


@query("a13_climate_difference", f"WITH {GRID_TS}, c AS (SELECT yi, xi, month(t) m, avg(inp) inp, avg(ref) AS ref FROM grid_ts GROUP BY ALL) SELECT yi, xi, CASE WHEN max(ref) >= 0.1 THEN 100 * (avg(inp) - avg(ref)) / nullif(avg(ref), 0) END rel_diff FROM c GROUP BY yi, xi", "rel_diff")
def climate_difference(spark, sf):
    """Relative difference of the climatologies."""
    clim = grid_ts(spark, sf).groupBy("yi", "xi", F.month("t").alias("m")).agg(F.avg("inp").alias("inp"), F.avg("ref").alias("ref"))
    return climate.climate_relative_difference(clim, ["yi", "xi"])


SPEARMAN = """r AS (SELECT yi, xi, rank() OVER (PARTITION BY yi, xi ORDER BY inp) + (count(*) OVER (PARTITION BY yi, xi, inp) - 1) / 2.0 rx,
      rank() OVER (PARTITION BY yi, xi ORDER BY ref) + (count(*) OVER (PARTITION BY yi, xi, ref) - 1) / 2.0 ry FROM grid_ts WHERE inp IS NOT NULL AND ref IS NOT NULL)
    SELECT yi, xi, CASE WHEN count(*) >= 2 AND stddev_pop(rx) * stddev_pop(ry) > 0 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END rho, count(*) n FROM r GROUP BY yi, xi"""


@query("a14_spearman_map", f"WITH {GRID_TS}, {SPEARMAN}", "rho")
def spearman_map(spark, sf):
    """Rank correlation of each cell, ties averaged."""
    return rank.spearman(grid_ts(spark, sf), ["yi", "xi"], "inp", "ref")


@query("a14_spearman_p_map", None, "rho p")
def spearman_p_map(spark, sf):
    """With the two-sided p (incomplete beta, which SQL lacks)."""
    return rank.spearman_with_p(grid_ts(spark, sf), ["yi", "xi"], "inp", "ref")


@query("a27_bootstrap_median", f"WITH {GRID_TS} SELECT yi, xi, quantile_cont(inp, 0.5) inp, quantile_cont(ref, 0.5) AS ref FROM grid_ts GROUP BY yi, xi", "inp ref")
def bootstrap_median(spark, sf):
    """Medians of each cell over iterations (here: steps)."""
    return climate.median_over(grid_ts(spark, sf), ["yi", "xi"], ["inp", "ref"])


@query("a22_area_mean", f"WITH {GRID_TS} SELECT t, avg(inp) inp, avg(ref) AS ref FROM grid_ts GROUP BY t", "inp ref")
def area_mean(spark, sf):
    """Mean over the cells of each step."""
    return climate.area_mean(grid_ts(spark, sf), "t", ["inp", "ref"])


@query("m12_fields", f"WITH {GRID_TS} SELECT yi, xi, t, ref - inp AS diff, inp / nullif(ref, 0) AS ratio, (ref - inp) / nullif(ref, 0) AS rel_diff FROM grid_ts", "diff ratio rel_diff")
def fields(spark, sf):
    """Difference, ratio, relative difference."""
    return grid_ts(spark, sf).select("yi", "xi", "t", difference("ref", "inp").alias("diff"), ratio("inp", "ref").alias("ratio"), relative_difference("ref", "inp").alias("rel_diff"))


@query("f08_available_years", f"WITH {GRID_TS} SELECT DISTINCT CAST(year(t) AS INT) AS year FROM grid_ts WHERE yi % 2 = 0 AND year(t) BETWEEN 1993 AND 1997 INTERSECT SELECT DISTINCT CAST(year(t) AS INT) FROM grid_ts WHERE xi % 2 = 1")
def available_years(spark, sf):
    """Years that both datasets have, clipped."""
    ts = grid_ts(spark, sf)
    return climate.available_years(ts.filter("yi % 2 = 0"), ts.filter("xi % 2 = 1"), first=1993, last=1997)


@query("u04_any_year", f"WITH {GRID_TS} SELECT DISTINCT CAST(year(t) AS INT) AS year FROM grid_ts WHERE yi % 2 = 0 OR xi % 2 = 1")
def any_year(spark, sf):
    """U4: years of either dataset."""
    ts = grid_ts(spark, sf)
    return climate.available_years(ts.filter("yi % 2 = 0"), ts.filter("xi % 2 = 1"), common=False)
