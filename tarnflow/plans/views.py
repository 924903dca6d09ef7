"""Series, grids and graphs over the driver tables: each as a DataFrame and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _month(c: str):
    return F.date_trunc("month", c).cast("timestamp_ntz")


def gauge_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, t, obs, sim: monthly series of a thousand gauges at most."""
    line = table(spark, sf_dir, "lineitem")
    even = F.col("l_linenumber") % 2 == 0
    price = F.col("l_extendedprice").cast("double")
    return line.groupBy(F.col("l_suppkey").cast("long").alias("id"), _month("l_shipdate").alias("t")).agg(
        F.avg(F.when(even, price)).alias("obs"), F.avg(F.when(~even, price * (1 - F.col("l_discount").cast("double")))).alias("sim")
    )


GAUGE_TS = """gauge_ts AS (
  SELECT CAST(l_suppkey AS BIGINT) id, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) t,
         avg(CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_extendedprice AS DOUBLE) END) obs,
         avg(CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_extendedprice AS DOUBLE) * (1 - CAST(l_discount AS DOUBLE)) END) sim
  FROM lineitem GROUP BY 1, 2)"""


def daily_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, t, value: yearly-peak series, a value a day."""
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_suppkey").cast("long").alias("id"), F.col("l_shipdate").cast("timestamp_ntz").alias("t")).agg(F.avg(F.col("l_quantity").cast("double")).alias("value"))


DAILY_TS = """daily_ts AS (
  SELECT CAST(l_suppkey AS BIGINT) id, CAST(l_shipdate AS TIMESTAMP) t, avg(CAST(l_quantity AS DOUBLE)) AS value FROM lineitem GROUP BY 1, 2)"""


def grid_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """yi, xi, t, ref, inp: a monthly grid with holes."""
    line = table(spark, sf_dir, "lineitem")
    even = F.col("l_linenumber") % 2 == 0
    q = F.col("l_quantity").cast("double")
    return line.groupBy(F.floor(F.col("l_suppkey") / 10).cast("long").alias("yi"), (F.col("l_suppkey") % 10).cast("long").alias("xi"), _month("l_shipdate").alias("t")).agg(
        F.avg(F.when(even, q)).alias("ref"), F.avg(F.when(~even, q)).alias("inp")
    )


GRID_TS = """grid_ts AS (
  SELECT CAST(floor(l_suppkey / 10) AS BIGINT) yi, CAST(l_suppkey % 10 AS BIGINT) xi, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) t,
         avg(CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS DOUBLE) END) AS ref,
         avg(CASE WHEN l_linenumber % 2 = 1 THEN CAST(l_quantity AS DOUBLE) END) AS inp
  FROM lineitem GROUP BY 1, 2, 3)"""


def map_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t, yi, xi, sim, obs: an 8 x 8 map a step, two sides."""
    vec = table(spark, sf_dir, "embeddings")
    cells = vec.select((F.floor(F.col("vec_id") / 2)).cast("long").alias("t"), (F.col("vec_id") % 2).alias("side"), F.posexplode("embedding").alias("p", "v"))
    val = F.col("v").cast("double") + 5
    return cells.groupBy("t", F.floor(F.col("p") / 8).cast("long").alias("yi"), (F.col("p") % 8).cast("long").alias("xi")).agg(
        F.max(F.when(F.col("side") == 1, val)).alias("sim"), F.max(F.when(F.col("side") == 0, val)).alias("obs")
    )


MAP_PAIR = """map_pair AS (
  SELECT CAST(floor(vec_id / 2) AS BIGINT) t, CAST(floor(p / 8) AS BIGINT) yi, CAST(p % 8 AS BIGINT) xi,
         max(CASE WHEN vec_id % 2 = 1 THEN CAST(v AS DOUBLE) + 5 END) sim, max(CASE WHEN vec_id % 2 = 0 THEN CAST(v AS DOUBLE) + 5 END) obs
  FROM (SELECT vec_id, generate_subscripts(embedding, 1) - 1 p, unnest(embedding) v FROM embeddings) GROUP BY 1, 2, 3)"""


def event_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_type, t, v_mean, v_sum: sub-daily series."""
    ev = table(spark, sf_dir, "events")
    v = F.col("value").cast("double")
    return ev.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("t")).agg(F.avg(v).alias("v_mean"), F.sum(v).alias("v_sum"))


EVENT_HOURLY = """event_hourly AS (
  SELECT event_type, CAST(date_trunc('hour', ts) AS TIMESTAMP) t, avg(CAST(value AS DOUBLE)) v_mean, sum(CAST(value AS DOUBLE)) v_sum FROM events GROUP BY 1, 2)"""


def forcing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, lat, t, tavg, tmin, tmax: daily temperatures."""
    line = table(spark, sf_dir, "lineitem")
    mean = F.avg(F.col("l_quantity").cast("double")) - 15
    return line.groupBy(F.col("l_suppkey").cast("long").alias("cell"), F.col("l_shipdate").cast("timestamp_ntz").alias("t")).agg(
        mean.alias("tavg"), (mean - F.max(F.col("l_discount").cast("double")) * 50).alias("tmin"), (mean + F.max(F.col("l_tax").cast("double")) * 50).alias("tmax")
    ).withColumn("lat", (40 + F.col("cell") % 10 * 2).cast("double"))


FORCING = """forcing AS (
  SELECT CAST(l_suppkey AS BIGINT) cell, CAST(l_shipdate AS TIMESTAMP) t, CAST(40 + l_suppkey % 10 * 2 AS DOUBLE) lat, avg(CAST(l_quantity AS DOUBLE)) - 15 tavg,
         avg(CAST(l_quantity AS DOUBLE)) - 15 - max(CAST(l_discount AS DOUBLE)) * 50 tmin, avg(CAST(l_quantity AS DOUBLE)) - 15 + max(CAST(l_tax AS DOUBLE)) * 50 tmax
  FROM lineitem GROUP BY l_suppkey, l_shipdate)"""


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, down: a drainage tree with one root."""
    sup = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("cell"))
    return sup.select("cell", F.when(F.col("cell") != 0, F.floor((F.col("cell") - 1) / 2).cast("long")).alias("down"))


FLOW = """flow AS (
  SELECT CAST(s_suppkey AS BIGINT) cell, CASE WHEN s_suppkey = 0 THEN NULL ELSE CAST(floor((s_suppkey - 1) / 2) AS BIGINT) END down FROM supplier)"""


def static_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """yi, xi, lat, lon, value: one map, with holes, on a grid ten cells wide."""
    g = grid_ts(spark, sf_dir).groupBy("yi", "xi").agg(F.avg("ref").alias("value"), F.count("*").alias("__n"))
    hole = F.pmod(F.col("yi") * 7 + F.col("xi") * 3, F.lit(5)) == 0
    return g.select("yi", "xi", (50 - F.col("yi") * 0.5).alias("lat"), (10 + F.col("xi") * 0.5).alias("lon"), F.when(~hole, F.col("value")).alias("value"))


STATIC_GRID = (
    GRID_TS
    + """, static_grid AS (
  SELECT yi, xi, 50 - yi * CAST(0.5 AS DOUBLE) lat, 10 + xi * CAST(0.5 AS DOUBLE) lon, CASE WHEN (yi * 7 + xi * 3) % 5 <> 0 THEN avg(ref) END AS value
  FROM grid_ts GROUP BY yi, xi)"""
)
