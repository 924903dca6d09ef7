"""Queries that run whole pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arith import snap_to_multiple
from ..operators import flow as graph
from ..operators import workflows
from ..session import write_through
from .gauges import scored
from .maps import AVERAGES, ESP, MSPAEF, SPAEF, TSM, WASPAEF
from .registry import query
from .views import FLOW, GAUGE_TS, GRID_TS, STATIC_GRID, flow, gauge_ts, grid_ts, static_grid, table


@query(
    "x31_discharge_evaluation",
    f"""WITH {GAUGE_TS}, s AS (SELECT id, CAST(date_trunc('year', t) AS TIMESTAMP) t, avg(obs) obs, avg(sim) sim FROM gauge_ts WHERE id % 2 = 0 GROUP BY 1, 2),
    y AS (SELECT id FROM s WHERE obs IS NOT NULL GROUP BY id HAVING count(DISTINCT year(t)) >= 5), z AS (SELECT id FROM s WHERE obs IS NOT NULL AND sim IS NOT NULL GROUP BY id HAVING count(DISTINCT year(t)) >= 5),
    k AS (SELECT * FROM s WHERE id IN (SELECT id FROM y) AND id IN (SELECT id FROM z)) {scored('id', 'k')}""",
    "alpha beta gamma kge nse diff rel_diff",
)
def discharge_evaluation(spark, sf):
    """The gauge pipeline: id list (F14), step, years, overlap, objectives."""
    ts = write_through(gauge_ts(spark, sf), "gauges")  # series and list of ids are of one table
    return workflows.evaluate_discharge(ts, "Y", 5, 5, ts.filter("id % 2 = 0").select("id").distinct())


_CLIM_PAIRS = f"""{GRID_TS}, map_all AS (SELECT CAST(month(t) AS BIGINT) t, yi, xi, avg(floor(inp)) sim, avg(floor(ref)) obs FROM grid_ts GROUP BY ALL), map_pair AS (SELECT * FROM map_all WHERE sim IS NOT NULL AND obs IS NOT NULL)"""
#: Area means are over all cells of a side, paired or not.
_CLIM_TSM = TSM.replace("avg(sim) sim, avg(obs) obs FROM map_pair GROUP BY t", "avg(sim) sim, avg(obs) obs FROM map_all GROUP BY t")


def _sides(spark, sf):
    ts = write_through(grid_ts(spark, sf), "sides")  # both sides' extents, spans and values are read from one table
    return ts.select("yi", "xi", "t", F.col("inp").alias("value")), ts.select("yi", "xi", "t", F.col("ref").alias("value"))


@query(
    "a46_gridded_scores",
    f"WITH {_CLIM_PAIRS}, {SPAEF}, {ESP}, {MSPAEF}, {WASPAEF}, {_CLIM_TSM} {AVERAGES}",
    "value",
)
def gridded_scores(spark, sf):
    """Scores of the climatologies of two gridded datasets, of whole numbers: their means are the same however they are added up, and so are ties."""
    return workflows.evaluate_grids(*(x.withColumn("value", F.floor("value").cast("double")) for x in _sides(spark, sf)))["scores"]


@query(
    "a46_gridded_spearman",
    f"""WITH {GRID_TS}, p AS (SELECT yi, xi, t, inp, ref FROM grid_ts WHERE inp IS NOT NULL AND ref IS NOT NULL AND t BETWEEN (SELECT greatest(min(t) FILTER (inp IS NOT NULL), min(t) FILTER (ref IS NOT NULL)) FROM grid_ts) AND (SELECT least(max(t) FILTER (inp IS NOT NULL), max(t) FILTER (ref IS NOT NULL)) FROM grid_ts)),
    r AS (SELECT yi, xi, rank() OVER (PARTITION BY yi, xi ORDER BY inp) + (count(*) OVER (PARTITION BY yi, xi, inp) - 1) / 2.0 rx, rank() OVER (PARTITION BY yi, xi ORDER BY ref) + (count(*) OVER (PARTITION BY yi, xi, ref) - 1) / 2.0 ry FROM p)
    SELECT yi, xi, CASE WHEN count(*) >= 2 AND stddev_pop(rx) * stddev_pop(ry) > 0 THEN covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) END rho, count(*) n FROM r GROUP BY yi, xi""",
    "rho",
)
def gridded_spearman(spark, sf):
    """Rank correlation map of two gridded datasets over their common steps."""
    return workflows.evaluate_grids(*_sides(spark, sf), direct=True)["spearman"]


@query("a46_gridded_relative", f"WITH {GRID_TS}, s AS (SELECT yi, xi, avg(inp) a, avg(ref) b, stddev_pop(inp) c, stddev_pop(ref) d FROM grid_ts GROUP BY yi, xi) SELECT yi, xi, CASE WHEN a / nullif(b, 0) >= 0 THEN a / nullif(b, 0) END rel_mean, CASE WHEN c / nullif(d, 0) >= 0 THEN c / nullif(d, 0) END rel_std FROM s", "rel_mean rel_std")
def gridded_relative(spark, sf):
    """Relative fields of two gridded datasets."""
    return workflows.evaluate_grids(*_sides(spark, sf))["relative"]


@query("f27_prepared_forcing", "SELECT event_type, CAST(date_trunc('day', ts) AS TIMESTAMP) t, 20.0::DOUBLE lat, 30.0::DOUBLE lon, avg(CAST(value AS DOUBLE)) - CAST(273.15 AS DOUBLE) AS value FROM events GROUP BY 1, 2", "lat lon value")
def prepared_forcing(spark, sf):
    """sub-daily to daily, K to degC, cropped."""
    ev = table(spark, sf, "events").select("event_type", F.col("ts").cast("timestamp_ntz").alias("t"), F.lit(20.0).alias("lat"), F.lit(30.0).alias("lon"), F.col("value").cast("double").alias("value"))
    return workflows.prepare_forcing(ev, ["event_type", "lat", "lon"], "value", "K", 0.1, "D", (10, 30), (20, 40)).select("event_type", "t", "lat", "lon", "value")


@query(
    "g16_subdomain_masks",
    f"""WITH {STATIC_GRID}, o AS (SELECT yi, xi, CASE WHEN (yi * 3 + xi * 5) % 4 <> 1 THEN CAST(floor(xi / 3) AS BIGINT) END cls FROM static_grid),
    v AS (SELECT * FROM o WHERE cls IS NOT NULL), f AS (SELECT g.yi, g.xi, arg_min(v.cls, row((g.yi - v.yi) ** 2 + (g.xi - v.xi) ** 2, v.yi, v.xi)) cls FROM o g, v WHERE g.cls IS NULL GROUP BY ALL),
    w AS (SELECT * FROM v UNION ALL SELECT * FROM f), n AS (SELECT yi, xi, CAST(floor((xi + yi) / 4) AS BIGINT) basin FROM static_grid WHERE xi <> 9),
    c AS (SELECT basin, cls, count(*) k FROM n JOIN w USING (yi, xi) GROUP BY ALL), m AS (SELECT basin, arg_min(cls, row(-k, cls)) cls FROM c GROUP BY basin)
    SELECT yi, xi, basin, cls FROM n JOIN m USING (basin)""",
)
def subdomain_masks(spark, sf):
    """A class for each new basin."""
    g = static_grid(spark, sf)
    old = g.select("yi", "xi", F.when((F.col("yi") * 3 + F.col("xi") * 5) % 4 != 1, F.floor(F.col("xi") / 3).cast("long")).alias("cls"))
    new = g.select("yi", "xi", F.floor((F.col("xi") + F.col("yi")) / 4).cast("long").alias("basin"))
    return workflows.subdomain_masks(new, old, g.select("yi", "xi", (F.col("xi") != 9).cast("int").alias("mask")))


@query(
    "j19_dateline_merge",
    f"WITH {FLOW}, e AS (SELECT cell, cell % 7 AS basin, CAST(cell % 360 - 180 AS DOUBLE) lon FROM flow), w AS (SELECT cell, cell % 5 AS basin, CAST((cell * 13) % 360 - 180 AS DOUBLE) lon FROM flow) SELECT cell, basin, lon FROM e WHERE basin NOT IN (SELECT basin FROM e WHERE abs(lon) > 178) UNION ALL SELECT cell, basin + (SELECT max(basin) FROM e) + 1, lon FROM w WHERE basin IN (SELECT basin FROM w WHERE abs(lon) > 178)",
    "lon",
)
def dateline_merge(spark, sf):
    """Basins at the date line from the shifted run."""
    f = flow(spark, sf).select("cell")
    east = f.select("cell", (F.col("cell") % 7).alias("basin"), (F.col("cell") % 360 - 180).cast("double").alias("lon"))
    west = f.select("cell", (F.col("cell") % 5).alias("basin"), (F.col("cell") * 13 % 360 - 180).cast("double").alias("lon"))
    return graph.merge_dateline(east, west, cut=178.0).select("cell", "basin", "lon")


@query(
    "p12_surrogate_ids",
    """WITH k AS (SELECT DISTINCT CASE WHEN s_suppkey % 3 = 0 THEN 'G' || s_suppkey WHEN s_suppkey % 3 = 1 THEN CAST(s_suppkey AS VARCHAR) ELSE '0' || (s_suppkey - 1) END raw FROM supplier),
    n AS (SELECT raw, try_cast(raw AS BIGINT) v, row_number() OVER (PARTITION BY try_cast(raw AS BIGINT) ORDER BY raw) r FROM k), m AS (SELECT raw, CASE WHEN r = 1 THEN v END v FROM n),
    o AS (SELECT raw, v, row_number() OVER (PARTITION BY v IS NULL ORDER BY raw) k FROM m)
    SELECT raw, coalesce(v, (SELECT max(v) FROM o) + k) numeric_id FROM o""",
)
def surrogate_ids(spark, sf):
    """Numbers for ids that spell none, or one that is taken."""
    k = F.col("s_suppkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit("G"), k.cast("string"))).when(k % 3 == 1, k.cast("string")).otherwise(F.concat(F.lit("0"), (k - 1).cast("string")))
    return workflows.surrogate_ids(table(spark, sf, "supplier").select(raw.alias("raw")).distinct(), "raw")


@query("p14_snapped_coordinates", "SELECT DISTINCT o_orderkey % 1000 AS k, CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 1000) * CAST(0.25 AS DOUBLE) ELSE (o_orderkey % 1000) * CAST(0.25 AS DOUBLE) + CAST(0.001 AS DOUBLE) END c FROM orders", "c")
def snapped_coordinates(spark, sf):
    """Coordinates within rounding errors of a multiple become it."""
    o = table(spark, sf, "orders").select((F.col("o_orderkey") % 1000).alias("k"), (F.col("o_orderkey") % 2 == 0).alias("near")).distinct()
    noisy = F.when(F.col("near"), F.col("k") * 0.25 * (1 + 1e-15)).otherwise(F.col("k") * 0.25 + 0.001)
    return o.select("k", snap_to_multiple(noisy, 0.25).alias("c"))


@query(
    "g14_delineated_gauges",
    f"""WITH RECURSIVE {FLOW}, up AS (SELECT cell AS top, cell FROM flow UNION ALL SELECT up.top, f.cell FROM up JOIN flow f ON f.down = up.cell),
    a AS (SELECT top AS cell, CAST(sum(cell % 3 + 1) AS DOUBLE) total FROM up GROUP BY top), c AS (SELECT CAST(floor(cell / 10) AS BIGINT) yi, cell % 10 AS xi, total AS facc FROM a),
    g AS (SELECT cell AS id, CAST(floor(cell / 10) AS BIGINT) gy, (cell % 10 + 1) % 10 AS gx, total * CASE WHEN cell % 7 = 0 THEN CAST(1000 AS DOUBLE) ELSE CAST(1.05 AS DOUBLE) END AS area FROM a),
    p AS (SELECT id, yi, xi, facc, area, abs(facc - area) / area AS error, (yi - gy) ** 2 + (xi - gx) ** 2 AS d, greatest(abs(yi - gy), abs(xi - gx)) AS far FROM g JOIN c ON abs(yi - gy) <= 4 AND abs(xi - gx) <= 4 WHERE abs(facc - area) / area <= 0.1),
    n AS (SELECT * FROM p WHERE far <= 2 UNION ALL SELECT * FROM p WHERE id NOT IN (SELECT id FROM p WHERE far <= 2)),
    m AS (SELECT *, min(error) OVER (PARTITION BY id) least FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, abs(facc - area), yi, xi) k FROM m WHERE abs(error - least) <= 1e-8 + 1e-5 * least)
    SELECT id, yi, xi, facc AS area_cell, abs(facc - area) <= 0.2 * area AS acceptable FROM r WHERE k = 1""",
    "area_cell",
)
def delineated_gauges(spark, sf):
    """Gauges a cell off their place are located on a drainage graph and checked; those whose area nothing near them has are not found."""
    place = [F.floor(F.col("cell") / 10).cast("long").alias("yi"), (F.col("cell") % 10).alias("xi")]
    f = flow(spark, sf)
    edges = f.select(*place, F.floor(F.col("down") / 10).cast("long").alias("down_yi"), (F.col("down") % 10).alias("down_xi"))
    areas = f.select(*place, (F.col("cell") % 3 + 1).cast("double").alias("area"))
    total = graph.accumulate(f.withColumn("area", (F.col("cell") % 3 + 1).cast("double")), "area")
    told = F.col("total") * F.when(F.col("cell") % 7 == 0, 1000.0).otherwise(1.05)
    gauges = total.select(F.col("cell").alias("id"), place[0], ((F.col("cell") % 10 + 1) % 10).alias("xi"), told.alias("area"))
    found, _ = workflows.delineate_gauges(gauges, edges, areas, 10, k=2, max_error=0.1)
    return found.select("id", "yi", "xi", "area_cell", "acceptable")
