"""Queries over time steps: inference, resampling, overlap, filling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import climate, resample
from .registry import query
from .views import DAILY_TS, EVENT_HOURLY, GAUGE_TS, GRID_TS, daily_ts, event_hourly, gauge_ts, grid_ts


@query(
    "a42_step_hours",
    f"""WITH {EVENT_HOURLY}, d AS (SELECT event_type, date_diff('second', lag(t) OVER (PARTITION BY event_type ORDER BY t), t) / CAST(3600 AS DOUBLE) g FROM event_hourly),
    m AS (SELECT event_type, quantile_cont(g, 0.5) AS hours FROM d WHERE g IS NOT NULL GROUP BY event_type)
    SELECT event_type, hours, CASE WHEN abs(hours - 24) <= 12 THEN 'D' WHEN abs(hours - 168) <= 24 THEN 'W' WHEN hours BETWEEN 648 AND 768 THEN 'ME' ELSE CAST(CAST(round(hours) AS INT) AS VARCHAR) || 'h' END AS alias FROM m""",
    "hours",
)
def step_hours(spark, sf):
    """Median step of each series."""
    return resample.step_hours(event_hourly(spark, sf), ["event_type"])


@query("r01_daily_mean_sum", f"WITH {EVENT_HOURLY} SELECT event_type, CAST(date_trunc('day', t) AS TIMESTAMP) t, avg(v_mean) v_mean, sum(v_sum) v_sum FROM event_hourly GROUP BY 1, 2", "v_mean v_sum")
def daily(spark, sf):
    """Hourly to daily, means of intensive and sums of extensive values."""
    ev = event_hourly(spark, sf)
    return resample.to_coarser(ev, ["event_type"], "D", {"v_mean": "mean", "v_sum": "sum"})


@query("r05_weekly", f"WITH {EVENT_HOURLY} SELECT event_type, CAST(date_trunc('day', t) AS TIMESTAMP) + to_days(CAST((8 - isodow(t)) % 7 AS INT)) t, avg(v_mean) v_mean FROM event_hourly GROUP BY 1, 2", "v_mean")
def weekly(spark, sf):
    """Weeks that end on Mondays."""
    return resample.to_coarser(event_hourly(spark, sf), ["event_type"], "W", {"v_mean": "mean"})


@query("r08_month_year", f"WITH {DAILY_TS}, m AS (SELECT id, CAST(date_trunc('month', t) AS TIMESTAMP) t, avg(value) AS value FROM daily_ts GROUP BY 1, 2) SELECT id, CAST(date_trunc('year', t) AS TIMESTAMP) t, max(value) AS value FROM m GROUP BY 1, 2", "value")
def month_year(spark, sf):
    """Monthly means, then yearly maxima."""
    monthly = resample.to_coarser(daily_ts(spark, sf), ["id"], "M", {"value": "mean"})
    return resample.to_coarser(monthly, ["id"], "Y", {"value": "max"})


@query("r06_yearly_mean", f"WITH {GAUGE_TS} SELECT id, CAST(date_trunc('year', t) AS TIMESTAMP) t, avg(obs) obs, avg(sim) sim FROM gauge_ts GROUP BY 1, 2", "obs sim")
def yearly_mean(spark, sf):
    """Calendar-year means."""
    return resample.to_coarser(gauge_ts(spark, sf), ["id"], "Y", {"obs": "mean", "sim": "mean"})


_SPINE = f"""WITH {DAILY_TS}, s AS (SELECT id, CAST(date_trunc('day', t) AS TIMESTAMP) t, avg(value) AS value FROM daily_ts GROUP BY 1, 2),
    e AS (SELECT id, unnest(generate_series(min(t), max(t), INTERVAL 1 DAY)) t FROM s GROUP BY id),
    j AS (SELECT e.id, e.t, s.value FROM e LEFT JOIN s USING (id, t)),
    w AS (SELECT id, t, last_value(value IGNORE NULLS) OVER b bv, last_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER b bt, first_value(value IGNORE NULLS) OVER a av, first_value(CASE WHEN value IS NOT NULL THEN t END IGNORE NULLS) OVER a nt
      FROM j WINDOW b AS (PARTITION BY id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY id ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("w05_forward_fill", _SPINE + " SELECT id, t, bv AS value FROM w", "value")
def forward_fill(spark, sf):
    """Every day, last value carried on."""
    return resample.to_finer(daily_ts(spark, sf), ["id"], "D", "value", "ffill")


@query("w06_linear_fill", _SPINE + " SELECT id, t, CASE WHEN bt = nt THEN bv ELSE bv + (av - bv) * date_diff('second', bt, t) / nullif(CAST(date_diff('second', bt, nt) AS DOUBLE), 0) END AS value FROM w", "value")
def linear_fill(spark, sf):
    """Every day, between neighbours."""
    return resample.to_finer(daily_ts(spark, sf), ["id"], "D", "value", "linear")


@query("r01_nearest_fill", _SPINE + " SELECT id, t, CASE WHEN nt IS NULL OR date_diff('second', bt, t) <= date_diff('second', t, nt) THEN bv ELSE av END AS value FROM w", "value")
def nearest_fill(spark, sf):
    """Every day, nearest value."""
    return resample.to_finer(daily_ts(spark, sf), ["id"], "D", "value", "nearest")


@query(
    "r03_spread_totals",
    f"""WITH {GAUGE_TS}, s AS (SELECT id, t, obs FROM gauge_ts WHERE obs IS NOT NULL),
    p AS (SELECT id, t, obs / greatest(round(coalesce(date_diff('second', t, lead(t) OVER (PARTITION BY id ORDER BY t)), 2592000) / CAST(86400 AS DOUBLE)), 1) v FROM s),
    e AS (SELECT id, unnest(generate_series(min(t), max(t), INTERVAL 1 DAY)) t FROM p GROUP BY id)
    SELECT e.id, e.t, last_value(v IGNORE NULLS) OVER (PARTITION BY e.id ORDER BY e.t) obs FROM e LEFT JOIN p USING (id, t)""",
    "obs",
)
def spread_totals(spark, sf):
    """Monthly totals over the days of their interval."""
    return resample.spread_totals(gauge_ts(spark, sf).filter("obs is not null").select("id", "t", "obs"), ["id"], "D", "obs", 720.0, 24.0)


@query(
    "f05_time_overlap",
    f"""WITH {GAUGE_TS}, a AS (SELECT date_trunc('month', t) m, obs FROM gauge_ts WHERE t < TIMESTAMP '1997-01-01' AND obs IS NOT NULL), b AS (SELECT date_trunc('month', t) m, sim FROM gauge_ts WHERE t >= TIMESTAMP '1994-01-01' AND sim IS NOT NULL)
    SELECT CAST(greatest((SELECT min(m) FROM a), (SELECT min(m) FROM b)) AS TIMESTAMP) start, CAST(least((SELECT max(m) FROM a), (SELECT max(m) FROM b)) AS TIMESTAMP) stop, (SELECT count(*) FROM a) n_a, (SELECT count(*) FROM b) n_b""",
)
def time_overlap(spark, sf):
    """span of steps that have values on both sides."""
    ts = gauge_ts(spark, sf)
    lit = lambda x: F.lit(x).cast("timestamp_ntz")
    return resample.overlap(ts.filter(F.col("t") < lit("1997-01-01")), ts.filter(F.col("t") >= lit("1994-01-01")), "M", "obs", "sim")


@query("r04_common_step", f"WITH {GRID_TS}, {DAILY_TS}, a AS (SELECT yi * 10 + xi AS id, CAST(date_trunc('month', t) AS TIMESTAMP) t, avg(ref) AS ref FROM grid_ts GROUP BY 1, 2), b AS (SELECT id, CAST(date_trunc('month', t) AS TIMESTAMP) t, avg(value) AS value FROM daily_ts GROUP BY 1, 2) SELECT id, t, ref, value FROM a JOIN b USING (id, t)", "ref value")
def common_step(spark, sf):
    """A monthly and a daily dataset on the coarser of their steps."""
    a = grid_ts(spark, sf).select((F.col("yi") * 10 + F.col("xi")).alias("id"), "t", "ref")
    return resample.to_target(a, daily_ts(spark, sf), ["id"], resample.coarser_of("MS", "D"), "ref", "value")


@query("a31_long_term_mean", f"WITH {DAILY_TS}, m AS (SELECT id, date_trunc('month', t) m, sum(CASE WHEN value > 10 THEN value END) AS value FROM daily_ts GROUP BY 1, 2) SELECT id, avg(value) AS value FROM m GROUP BY id", "value")
def long_term_mean(spark, sf):
    """Monthly sums of the values over a threshold, then their mean."""
    return resample.long_term_mean(daily_ts(spark, sf), ["id"], "value", "M", intensive=False, threshold=10.0)


@query("u01_merge_files", f"WITH {DAILY_TS} SELECT id, t, CASE WHEN id % 2 = 0 THEN value ELSE value + 1 END AS value FROM daily_ts", "value")
def merge_files(spark, sf):
    """Parts united, of repeated stamps the first part's."""
    ts = daily_ts(spark, sf)
    return resample.merge_files([ts.filter("id % 2 = 0"), ts.withColumn("value", F.col("value") + 1)], ["id"])


@query("a24_daily_climatology", f"WITH {DAILY_TS}, s AS (SELECT t, avg(value) AS value FROM daily_ts GROUP BY t), c AS (SELECT strftime(t, '%m-%d') month_day, avg(value) AS value FROM s GROUP BY 1) SELECT * FROM c WHERE month_day <> '02-29' UNION ALL SELECT '02-29', avg(value) FROM c WHERE month_day IN ('02-28', '03-01')", "value")
def daily_climatology(spark, sf):
    """366-day climatology of the area mean."""
    return climate.daily_climatology(climate.area_mean(daily_ts(spark, sf), "t", ["value"]), "t", "value")


@query("m20_calendar", f"WITH {DAILY_TS} SELECT DISTINCT t, CAST(year(t) AS INT) AS year, CAST(month(t) AS INT) AS month, CAST(dayofyear(t) AS INT) doy, strftime(t, '%m-%d') month_day FROM daily_ts")
def calendar(spark, sf):
    """Parts of the calendar."""
    return daily_ts(spark, sf).select("t").distinct().select("t", F.year("t").alias("year"), F.month("t").alias("month"), F.dayofyear("t").alias("doy"), F.date_format("t", "MM-dd").alias("month_day"))
