"""Queries over metric tables, overviews, land-cover intervals."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import landcover, skill, tables
from .gauges import scored
from .registry import query
from .views import GAUGE_TS, GRID_TS, gauge_ts, grid_ts, table

_SKILL = f"WITH {GAUGE_TS}, sk AS ({scored('id', 'gauge_ts')})"
_LONG = _SKILL + ", lg AS (SELECT id, variable, value FROM (UNPIVOT (SELECT id, kge, nse, alpha, beta, gamma FROM sk) ON kge, nse, alpha, beta, gamma INTO NAME variable VALUE value))"
METRICS = ["kge", "nse", "alpha", "beta", "gamma"]


def _skill(spark, sf):
    return skill.skill(gauge_ts(spark, sf), ["id"]).filter("n > 0")


@query("a48_metric_values", _LONG + " SELECT id, variable, value FROM lg", "value")
def metric_values(spark, sf):
    """Five metrics of each gauge, finite ones, long."""
    return tables.metric_long(_skill(spark, sf), ["id"], METRICS)


@query("a35_metric_summary", _LONG + " SELECT variable, count(*) n, min(value) AS min, max(value) AS max, avg(value) mean, quantile_cont(value, 0.5) AS median FROM lg GROUP BY variable", "min max mean median")
def metric_summary(spark, sf):
    """Numbers of each metric."""
    return tables.summary(tables.metric_long(_skill(spark, sf), ["id"], METRICS), ["variable"], "value")


@query("a34_metric_medians", _SKILL + " SELECT CAST(id % 10 AS VARCHAR) match_id, quantile_cont(kge, 0.5) kge, quantile_cont(nse, 0.5) nse FROM sk GROUP BY 1", "kge nse")
def metric_medians(spark, sf):
    """Medians by canonical id."""
    rows = _skill(spark, sf).select((F.col("id") % 10).cast("double").alias("station"), "kge", F.col("nse").cast("string").alias("nse"))
    return tables.medians_by_id(rows, "station", ["kge", "nse"])


@query("u09_comparison_groups", "SELECT c_custkey, coalesce(b, 'x') AS part FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 'p' ELSE 'q' END AS part FROM customer) c JOIN (VALUES ('p'), ('q')) v(b) ON c.part IS NULL OR c.part = v.b")
def comparison_groups(spark, sf):
    """Rows without a group join every group."""
    part = F.when(F.col("c_custkey") % 3 == 1, "p").when(F.col("c_custkey") % 3 == 2, "q")
    return tables.comparison_groups(table(spark, sf, "customer").select("c_custkey", part.alias("part")), "part")


@query("a32_variable_statistics", f"WITH {GRID_TS}, u AS (SELECT yi, xi, t, variable, value FROM (UNPIVOT grid_ts ON ref, inp INTO NAME variable VALUE value)), m AS (SELECT variable, yi, xi, avg(value) AS value FROM u GROUP BY ALL) SELECT variable, min(value) min_value, avg(value) mean_value, max(value) max_value FROM m GROUP BY variable", "min_value mean_value max_value")
def variable_statistics(spark, sf):
    """Least, mean, largest of the time means of each variable."""
    long = grid_ts(spark, sf).unpivot(["yi", "xi", "t"], ["ref", "inp"], "variable", "value")
    return tables.variable_statistics(long, ["variable"], "value", ["yi", "xi"])


@query(
    "a33_overview",
    f"""WITH {GRID_TS}, s AS (SELECT min(ref) AS lo, avg(ref) AS mid, max(ref) AS hi FROM grid_ts)
    SELECT f file_name, v variable, k vartype, lo * r AS min_value, mid * r AS mean_value, hi * r AS max_value, u unit FROM s, (VALUES ('pre.nc', 'pre', 'input', 86400, 'mm d-1'), ('out.nc', 'Q', 'output', 1, 'm3'), ('out.nc', 'aET', 'output', 1, 'mm/d'), ('out.nc', 'x', 'output', 1, 'm'), ('out.nc', 'time_of_peak', 'output', 1, 'h')) x(f, v, k, r, u)""",
    "min_value mean_value max_value",
)
def overview(spark, sf):
    """The overview of a run's files."""
    s = grid_ts(spark, sf).agg(F.min("ref").alias("min_value"), F.avg("ref").alias("mean_value"), F.max("ref").alias("max_value"))
    rows = [("pre.nc", "pre", "input", "mm s-1"), ("out.nc", "Q", "output", "m3"), ("out.nc", "lat_bnds", "output", "deg"), ("out.nc", "lon2d", "output", "deg"), ("out.nc", "plateau", "output", "m"), ("out.nc", "x", "output", "m"), ("out.nc", "time_of_peak", "output", "h"), ("out.nc", "aET", "output", "mm/d"), ("out.nc", "Q", "output", "m3")]
    files = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("file_name", "variable", "vartype", "unit"), r, strict=True)]) for r in rows])).alias("f")
    stats = s.select(files, "min_value", "mean_value", "max_value").select("f.*", "min_value", "mean_value", "max_value")
    return tables.overview(stats, "d").select("file_name", "variable", "vartype", "min_value", "mean_value", "max_value", "unit")


_INTERVALS = "iv AS (SELECT CAST(n_regionkey AS INT) part, CAST(1950 + 10 * (n_nationkey % 5) AS INT) year_start, CAST(1950 + 10 * (n_nationkey % 5) + 8 + CAST(n_nationkey % 3 AS INT) AS INT) year_end FROM nation)"


def _intervals(spark, sf):
    k = F.col("n_nationkey").cast("int")
    start = (1950 + 10 * (k % 5)).cast("int")
    return table(spark, sf, "nation").select(F.col("n_regionkey").cast("int").alias("part"), start.alias("year_start"), (start + 8 + k % 3).cast("int").alias("year_end")).distinct()


@query("w11_interval_problems", f"WITH {_INTERVALS}, d AS (SELECT DISTINCT * FROM iv), l AS (SELECT *, lag(year_end) OVER (PARTITION BY part ORDER BY year_start, year_end) b FROM d), p AS (SELECT part, year_start, CASE WHEN year_start > b + 1 THEN 'gap' WHEN year_start <= b THEN 'overlap' END problem FROM l) SELECT * FROM p WHERE problem IS NOT NULL")
def interval_problems(spark, sf):
    """Gaps and overlaps of intervals."""
    return landcover.interval_problems(_intervals(spark, sf), ["part"])


@query("w10_half_open", f"WITH {_INTERVALS}, d AS (SELECT part, year_start, max(year_end) year_end FROM iv GROUP BY ALL) SELECT part, year_start, year_end, make_date(year_start, 1, 1) lo, make_date(CAST(coalesce(lead(year_start) OVER (PARTITION BY part ORDER BY year_start), max(year_end) OVER (PARTITION BY part) + 1) AS INT), 1, 1) hi FROM d")
def half_open(spark, sf):
    """Ends are the next starts."""
    one = _intervals(spark, sf).groupBy("part", "year_start").agg(F.max("year_end").alias("year_end"))
    return landcover.half_open(one, ["part"])


@query("u10_landcover_stack", f"WITH {_INTERVALS}, d AS (SELECT part, year_start, max(year_end) year_end FROM iv GROUP BY ALL), h AS (SELECT *, make_date(year_start, 1, 1) lo, make_date(CAST(coalesce(lead(year_start) OVER (PARTITION BY part ORDER BY year_start), max(year_end) OVER (PARTITION BY part) + 1) AS INT), 1, 1) hi FROM d), f AS (SELECT *, min(lo) OVER (PARTITION BY part) f0 FROM h) SELECT part, year_start, CAST(c AS INT) xi, CAST(c * year_start AS INT) AS value, CAST(lo - f0 AS INT) AS time, CAST(hi - f0 AS INT) time_hi FROM f, (SELECT unnest(range(4)) c)")
def landcover_stack(spark, sf):
    """Grids of all intervals on one time axis in days."""
    one = _intervals(spark, sf).groupBy("part", "year_start").agg(F.max("year_end").alias("year_end"))
    grids = one.select("part", "year_start", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("xi")).withColumn("value", F.col("xi") * F.col("year_start"))
    return landcover.stack(grids, one, ["part"])
