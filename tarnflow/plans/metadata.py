"""Queries over what describes data: axes, units, resolutions, limits, orders; and over shapes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import limits
from ..functions.calendar import normalize_alias
from ..operators import flow as graph
from ..operators import grid, patterns, rank, workflows
from ..sources import ascii_grid
from ..sources import tables as store
from .gauges import scored
from .maps import MAP_PAIR
from .registry import query
from .views import FLOW, GAUGE_TS, GRID_TS, STATIC_GRID, flow, gauge_ts, grid_ts, map_pair, static_grid, table


#: Spellings of axes, and the variable beside them.
_SPELLED = {"a": ("latitude", "lon", "pre"), "b": ("y", "x", "tavg"), "c": ("northing", "easting", "Q")}


@query("p01_axes", f"WITH {STATIC_GRID} SELECT k, lat, lon, payload, n, total FROM (VALUES ('a', 'latitude', 'lon', 'pre'), ('b', 'y', 'x', 'tavg'), ('c', 'northing', 'easting', 'Q'), ('d', 'rows', 'lon', 'rows_of')) v(k, lat, lon, payload), (SELECT count(value) AS n, sum(value + lat) AS total FROM static_grid)", "total")
def axes(spark, sf):
    """Axes of tables in several spellings, by flag, then by name; the one variable left."""
    out = None
    for k, (lat, lon, var) in {**_SPELLED, "d": ("rows", "lon", "rows_of")}.items():
        named = static_grid(spark, sf).select(F.col("lat").alias(lat), F.col("lon").alias(lon), F.col("value").alias(var))
        attrs = {"rows": {"axis": "Y"}}
        at = [store.resolve_axis(named.columns, a, attrs) for a in ("lat", "lon")]
        left = store.payload([c for c in named.columns if c not in at])
        one = named.agg(F.count(left).alias("n"), F.sum(F.col(left) + F.col(at[0])).alias("total")).select(F.lit(k).alias("k"), F.lit(at[0]).alias("lat"), F.lit(at[1]).alias("lon"), F.lit(left).alias("payload"), "n", "total")
        out = one if out is None else out.unionByName(one)
    return out


@query("p16_resolution", f"WITH {STATIC_GRID} SELECT 'lon' AS axis, (max(lon) - min(lon)) / nullif(count(DISTINCT lon) - 1, 0) AS step FROM static_grid UNION ALL SELECT 'key', (max(p_partkey) - min(p_partkey)) * CAST(0.25 AS DOUBLE) / (count(DISTINCT p_partkey) - 1) FROM part", "step")
def resolution(spark, sf):
    """The step of an axis."""
    lon = grid.axis(static_grid(spark, sf), "xi", "lon")
    key = table(spark, sf, "part").select(F.col("p_partkey").alias("i"), (F.col("p_partkey") * 0.25).alias("c")).distinct()
    return spark.createDataFrame([("lon", grid.resolution(lon)), ("key", grid.resolution(key))], "axis string, step double")


@query("p20_levels", f"WITH {STATIC_GRID}, h AS (SELECT count(DISTINCT xi) nx, count(DISTINCT yi) ny FROM static_grid), l(level, factor) AS (VALUES ('l0', 1), ('l1', 2), ('l11', 4), ('l2', 2)) SELECT level, CAST(ceil(nx / factor) AS INT) AS ncols, CAST(ceil(ny / factor) AS INT) AS nrows, factor / 2 AS cellsize, factor FROM l, (SELECT CAST(nx AS DOUBLE) AS nx, CAST(ny AS DOUBLE) AS ny FROM h)", "cellsize")
def levels(spark, sf):
    """A grid's header on coarser levels, rounded up, and their factors."""
    fine = ascii_grid.header_of(static_grid(spark, sf))
    rows = [(n, h.ncols, h.nrows, s, grid.integer_ratio(s, 0.5)) for n, s in grid.resolution_ladder(0.5, 1.0, 2.0).items() for h in [fine.rescaled(s)]]
    return spark.createDataFrame(rows, "level string, ncols int, nrows int, cellsize double, factor int")


@query("p22_mask_limits", f"WITH {STATIC_GRID} SELECT min(lat) - CAST(0.25 AS DOUBLE) south, max(lat) + CAST(0.25 AS DOUBLE) north, min(lon) - CAST(0.25 AS DOUBLE) west, max(lon) + CAST(0.25 AS DOUBLE) east FROM static_grid WHERE value > 24", "south north west east")
def mask_limits(spark, sf):
    """The box of a mask's cells."""
    box = workflows.mask_limits(static_grid(spark, sf).withColumn("mask", (F.col("value") > 24).cast("int")), 0.5)
    return spark.createDataFrame([tuple(box.values())], ", ".join(f"{k} double" for k in box))


@query("f10_mask_choice", "SELECT p_size AS size, CASE p_size WHEN 5 THEN 'mask_l1' WHEN 10 THEN 'mask_l2' ELSE 'mask_l0' END AS mask, count(*) AS n FROM part GROUP BY p_size")
def mask_choice(spark, sf):
    """the mask of a grid's resolution, else the finest finer one, for each resolution that occurs."""
    known = {"mask_l0": 0.05, "mask_l1": 0.5, "mask_l2": 1.0}
    sizes = table(spark, sf, "part").groupBy(F.col("p_size").alias("size")).agg(F.count("*").alias("n"))
    chosen = [(r.size, grid.choose_mask(known, r.size * 0.1)) for r in sizes.select("size").collect()]  # kinds of grids are few
    return sizes.join(F.broadcast(spark.createDataFrame(chosen, f"size {dict(sizes.dtypes)['size']}, mask string")), "size")


@query("f12_aligned_bounds", f"WITH {STATIC_GRID}, e AS (SELECT min(lon) + unnest(range(0, 12, 2)) * CAST(0.5 AS DOUBLE) AS c FROM static_grid) SELECT max(c) FILTER (c <= 11.2) AS low, min(c) FILTER (c >= 12.7) AS high FROM e", "low high")
def aligned_bounds(spark, sf):
    """bounds moved outward to a coarser grid's edges."""
    west = grid.extent(static_grid(spark, sf), "lat", "lon").first().x0
    low, high = grid.align_outward(11.2, 12.7, [west + k * 0.5 for k in range(0, 12, 2)])
    return spark.createDataFrame([(low, high)], "low double, high double")


@query("f26_cropped_setup", f"WITH {STATIC_GRID} SELECT 'dem' AS name, yi, xi, CASE WHEN (yi + xi) % 2 = 0 THEN value END AS value FROM static_grid WHERE lat BETWEEN 40 AND 50 AND lon BETWEEN 11 AND 13 UNION ALL SELECT 'slope', yi, xi, value * 2 FROM static_grid WHERE lat BETWEEN 40 AND 50 AND lon BETWEEN 11 AND 13", "value")
def cropped_setup(spark, sf):
    """the grids of a setup cut to a box, the terrain masked, templates and restart states left alone."""
    g = static_grid(spark, sf)
    setup = {"dem": g, "slope": g.withColumn("value", F.col("value") * 2), "latlon": g, "mHM_restart_001": g}
    box = g.filter(F.col("lat").between(40, 50) & F.col("lon").between(11, 13))
    # every row and column of the box has a cell of the mask, so that nothing is trimmed
    mask = box.select("yi", "xi", F.when((F.col("yi") + F.col("xi")) % 2 == 0, 1).otherwise(0).alias("mask"))
    cut = workflows.crop_setup(setup, (40, 50), (11, 13), mask)
    return cut["dem"].select(F.lit("dem").alias("name"), "yi", "xi", "value").unionByName(cut["slope"].select(F.lit("slope").alias("name"), "yi", "xi", "value"))


@query(
    "u11_restart_from_tiles",
    f"""WITH {STATIC_GRID}, c AS (SELECT k AS tile, yi, xi, value * (k + 1) AS value FROM static_grid, (SELECT unnest(range(2)) k)),
    v AS (SELECT * FROM c WHERE value IS NOT NULL), f AS (SELECT g.tile, g.yi, g.xi, arg_min(v.value, row((g.yi - v.yi) ** 2 + (g.xi - v.xi) ** 2, v.yi, v.xi)) AS value FROM c g JOIN v ON v.tile = g.tile WHERE g.value IS NULL GROUP BY ALL),
    w AS (SELECT * FROM v UNION ALL SELECT * FROM f), p AS (SELECT tile, yi + tile * 3 AS yi, xi, value FROM w), l AS (SELECT yi, xi, max(tile) AS tile FROM p GROUP BY ALL)
    SELECT 'L1_soil' AS var, yi, xi, CASE WHEN (yi + xi) % 3 <> 0 THEN value END AS value FROM p JOIN l USING (yi, xi, tile)""",
    "value",
)
def restart_from_tiles(spark, sf):
    """Tiles filled, placed, later over earlier ones, masked, renamed."""
    g = static_grid(spark, sf)
    cells = g.select(F.explode(F.array(*[F.lit(i).cast("long") for i in range(2)])).alias("tile"), F.lit("soil").alias("var"), "yi", "xi", "value").withColumn("value", F.col("value") * (F.col("tile") + 1))
    corners = spark.createDataFrame([(i, 1.5 * i, 0.0) for i in range(2)], "tile long, lat0 double, lon0 double")
    mask = cells.select((F.col("yi") + F.col("tile") * 3).alias("yi"), "xi").distinct().withColumn("mask", F.when(F.pmod(F.col("yi") + F.col("xi"), F.lit(3)) != 0, 1).otherwise(0))
    return workflows.restart_from_tiles(cells, corners, mask, (0.0, 0.0), 0.5, {"soil": "L1_soil"}).select("var", "yi", "xi", "value")


def _by_text(df, name, of, kind):
    """``df`` (text, ...) with what a function makes of each distinct text: kinds of spellings are few."""
    made = [(r.text, of(r.text)) for r in df.select("text").distinct().collect()]
    return df.join(F.broadcast(df.sparkSession.createDataFrame(made, f"text string, {name} {kind}")), "text")


@query("m22_aliases", "SELECT a AS text, count(*) AS n, b AS normal FROM orders JOIN (VALUES (0, 'd', 'D'), (1, 'MS', 'M'), (2, 'YE', 'Y'), (3, '6H', '6h'), (4, 'weekly', 'W')) v(k, a, b) ON k = o_orderkey % 5 GROUP BY a, b")
def aliases(spark, sf):
    """Spellings of steps, with how often each occurs."""
    names = F.array(*map(F.lit, ("d", "MS", "YE", "6H", "weekly")))
    found = table(spark, sf, "orders").groupBy(F.get(names, (F.col("o_orderkey") % 5).cast("int")).alias("text")).agg(F.count("*").alias("n"))
    return _by_text(found, "normal", normalize_alias, "string")


@query("m16_memory", "SELECT p_size || u AS text, count(*) AS n, CAST(floor(p_size / d) AS INT) AS gb FROM part JOIN (VALUES (0, 'gb', 1), (1, '00MB', 10), (2, '000Mb', 1)) v(k, u, d) ON k = p_partkey % 3 GROUP BY ALL")
def memory(spark, sf):
    """Memory strings to whole gigabytes, with how often each occurs."""
    unit = F.get(F.array(*map(F.lit, ("gb", "00MB", "000Mb"))), (F.col("p_partkey") % 3).cast("int"))
    found = table(spark, sf, "part").groupBy(F.concat(F.col("p_size").cast("string"), unit).alias("text")).agg(F.count("*").alias("n"))
    return _by_text(found, "gb", limits.memory_gb, "int")


@query("p23_label_steps", "SELECT p_partkey, CASE WHEN x = 0 THEN CAST(1e-6 AS DOUBLE) WHEN x > 1.4 THEN greatest(round_even(x * 2, 0) / 2, 0.5) WHEN x > 0.15 THEN greatest(round_even(x * 5, 0) / 5, 0.2) WHEN x > 0.015 THEN greatest(round_even(x * 50, 0) / 50, 0.02) WHEN x > 0.0015 THEN greatest(round_even(x * 500, 0) / 500, 0.002) ELSE greatest(round_even(x * 5000, 0) / 5000, 0.0002) END AS half_range, CAST(CASE WHEN x = 0 THEN 6 WHEN x > 0.15 THEN 2 WHEN x > 0.015 THEN 3 WHEN x > 0.0015 THEN 4 ELSE 5 END AS INT) digits FROM (SELECT p_partkey, (p_partkey % 1000) ** 2 / CAST(250000 AS DOUBLE) + CASE WHEN p_partkey % 1000 = 0 THEN 0 ELSE CAST(0.0002 AS DOUBLE) END AS x FROM part)", "half_range")
def label_steps(spark, sf):
    """Half ranges of maps rounded to steps of their labels."""
    k = F.col("p_partkey") % 1000
    step, digits = limits.label_step(k.cast("double") ** 2 / 250000 + F.when(k == 0, 0.0).otherwise(0.0002))
    return table(spark, sf, "part").select("p_partkey", step.alias("half_range"), digits.cast("int").alias("digits"))


_LONG = f"WITH {GAUGE_TS}, sk AS ({scored('id', 'gauge_ts')}), lg AS (UNPIVOT (SELECT id, kge, nse, alpha, beta FROM sk) ON kge, nse, alpha, beta INTO NAME variable VALUE value)"


def _long(spark, sf):
    from .metric_tables import _skill

    return _skill(spark, sf).unpivot(["id"], ["kge", "nse", "alpha", "beta"], "variable", "value").filter("value is not null")


@query("m18_curve_limits", f"{_LONG}, q AS (SELECT variable, min(value) a, max(value) b, quantile_cont(value, 0.05) q0, quantile_cont(value, 0.5) q1, quantile_cont(value, 0.95) q2 FROM lg GROUP BY variable), r AS (SELECT *, CASE WHEN a > -2 THEN a ELSE q0 END l, CASE WHEN b < 3 THEN b ELSE q2 END h FROM q) SELECT variable, CASE WHEN variable IN ('kge', 'nse') THEN -0.5 WHEN h - l > 6 THEN greatest(l, q1 - 3) ELSE l END AS lo, CASE WHEN variable IN ('kge', 'nse') THEN 1.0 WHEN h - l > 6 THEN least(h, q1 + 3) ELSE h END AS hi FROM r", "lo hi")
def curve_limits(spark, sf):
    """Axis limits of the metrics' distributions."""
    return limits.curve_limits(_long(spark, sf), "variable", "value")


@query("m18_colour_limits", f"{_LONG}, q AS (SELECT variable, min(value) a, max(value) b FROM lg GROUP BY variable), r AS (SELECT *, CASE variable WHEN 'kge' THEN -0.5 WHEN 'nse' THEN -0.1 ELSE a END l, CASE WHEN variable IN ('kge', 'nse') THEN 1.0 ELSE b END h FROM q) SELECT variable, l - (l = h)::INT AS lo, h + (l = h)::INT AS hi, CASE WHEN a < l AND b > h THEN 'both' WHEN a < l THEN 'min' WHEN b > h THEN 'max' ELSE 'neither' END AS extend FROM r", "lo hi")
def colour_limits(spark, sf):
    """Colour limits of the metrics' maps."""
    return limits.colour_limits(_long(spark, sf), "variable", "value")


@query("t05_natural_order", "WITH i AS (SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'G' || s_suppkey ELSE CAST(s_suppkey * 7 % 1000 AS VARCHAR) || CASE WHEN s_suppkey % 4 = 1 THEN '' ELSE '.5' END END id FROM supplier) SELECT id, row_number() OVER (ORDER BY try_cast(id AS DOUBLE) IS NULL, try_cast(id AS DOUBLE), id) AS place FROM (SELECT DISTINCT id FROM i)")
def natural_order(spark, sf):
    """T5: ids in order of their numbers, then the others."""
    k = F.col("s_suppkey")
    name = F.when(k % 4 == 0, F.concat(F.lit("G"), k.cast("string"))).otherwise(F.concat((k * 7 % 1000).cast("string"), F.when(k % 4 == 1, "").otherwise(".5")))
    ids = table(spark, sf, "supplier").select(name.alias("id")).distinct().withColumn("key", limits.natural_order(F.col("id")))
    return rank.numbered(ids, "key", "place").select("id", "place")


RINGS = "e(id, x1, y1, x2, y2) AS (VALUES (1, 10.2, 45.3, 14.1, 46.1), (1, 14.1, 46.1, 12.3, 49.9), (1, 12.3, 49.9, 10.2, 45.3), (2, 10.0, 47.0, 13.0, 47.0), (2, 13.0, 47.0, 13.0, 49.0), (2, 13.0, 49.0, 10.0, 49.0), (2, 10.0, 49.0, 10.0, 47.0))"


def _rings(spark):
    triangle = [(1, 10.2, 45.3, 14.1, 46.1), (1, 14.1, 46.1, 12.3, 49.9), (1, 12.3, 49.9, 10.2, 45.3)]
    corners = [(10.0, 47.0), (13.0, 47.0), (13.0, 49.0), (10.0, 49.0)]
    square = [(2, *a, *b) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)]
    return spark.createDataFrame(triangle + square, "id int, x1 double, y1 double, x2 double, y2 double")


_TRIANGLES = """p AS (SELECT CAST(s_suppkey AS BIGINT) AS id, 10 + s_suppkey % 60 * CAST(0.25 AS DOUBLE) AS x, 40 + s_suppkey % 35 * CAST(0.5 AS DOUBLE) AS y, 1 + s_suppkey % 9 * CAST(0.5 AS DOUBLE) AS w FROM supplier),
    e AS (SELECT id, x AS x1, y AS y1, x + w + 1 AS x2, y + 1 AS y2 FROM p UNION ALL SELECT id, x + w + 1, y + 1, x + 2, y + w + 2 FROM p UNION ALL SELECT id, x + 2, y + w + 2, x, y FROM p)"""


@query("t01_polygon_areas", f"WITH {_TRIANGLES}, r AS (SELECT id, radians(CAST(x1 AS DOUBLE)) a, radians(CAST(x2 AS DOUBLE)) b, sin(radians(CAST(y1 AS DOUBLE))) s, sin(radians(CAST(y2 AS DOUBLE))) u, CAST(0.0818191908426215 AS DOUBLE) k FROM e), q AS (SELECT id, a, b, (1 - k ** 2) * (s / (1 - k ** 2 * s ** 2) - ln((1 - k * s) / (1 + k * s)) / (2 * k)) h1, (1 - k ** 2) * (u / (1 - k ** 2 * u ** 2) - ln((1 - k * u) / (1 + k * u)) / (2 * k)) h2 FROM r) SELECT id, abs(sum(a * h2 - b * h1)) / 2 * (CAST(6378.137 AS DOUBLE) ** 2 / 2) AS area FROM q GROUP BY id", "area")
def polygon_areas(spark, sf):
    """Polygons by area, in an equal-area projection: a triangle a supplier."""
    k = F.col("s_suppkey")
    at = table(spark, sf, "supplier").select(k.cast("long").alias("id"), (10 + k % 60 * 0.25).alias("x"), (40 + k % 35 * 0.5).alias("y"), (1 + k % 9 * 0.5).alias("w"))
    corners = [(F.col("x"), F.col("y")), (F.col("x") + F.col("w") + 1, F.col("y") + 1), (F.col("x") + 2, F.col("y") + F.col("w") + 2)]
    sides = F.array(*[F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")) for a, b in zip(corners, corners[1:] + corners[:1], strict=True)])
    return grid.polygon_areas(at.select("id", F.inline(sides)))


@query(
    "g09_covered_area",
    f"""WITH {STATIC_GRID}, {RINGS}, c AS (SELECT id, yi, xi, lat - 0.25 AS b, lat + 0.25 AS t, greatest(least(x1, x2), lon - 0.25) AS l, least(greatest(x1, x2), lon + 0.25) AS r, sign(x1 - x2) s, CAST(x1 AS DOUBLE) x1, CAST(y1 AS DOUBLE) y1, CAST(x2 AS DOUBLE) x2, CAST(y2 AS DOUBLE) y2 FROM static_grid, e WHERE x1 <> x2),
    h AS (SELECT *, y1 + (l - x1) / (x2 - x1) * (y2 - y1) ya, y1 + (r - x1) / (x2 - x1) * (y2 - y1) yb FROM c WHERE r > l),
    g AS (SELECT *, CASE WHEN ya <= b THEN 0 WHEN ya >= t THEN (t - b) ** 2 / 2 + (t - b) * (ya - t) ELSE (ya - b) ** 2 / 2 END ga, CASE WHEN yb <= b THEN 0 WHEN yb >= t THEN (t - b) ** 2 / 2 + (t - b) * (yb - t) ELSE (yb - b) ** 2 / 2 END gb FROM h),
    i AS (SELECT id, yi, xi, sum(s * (r - l) * CASE WHEN abs(yb - ya) < 1e-9 THEN least(greatest((ya + yb) / 2 - b, 0), t - b) ELSE (gb - ga) / (yb - ya) END) / CAST(0.25 AS DOUBLE) AS share FROM g GROUP BY ALL)
    SELECT id, yi, xi, share FROM i WHERE share > 1e-6""",
    "share",
)
def covered_area(spark, sf):
    """The share of each cell that a polygon covers."""
    return grid.covered_shares(static_grid(spark, sf).select("yi", "xi", "lat", "lon"), _rings(spark), 0.5).filter("share > 1e-6").select("id", "yi", "xi", "share")


@query("m12_user_metric", f"WITH {MAP_PAIR} SELECT t, avg(abs(sim - obs) * 2) AS value FROM map_pair GROUP BY t", "value")
def user_metric(spark, sf):
    """A caller's function over the map of each step."""
    return patterns.user_metric(map_pair(spark, sf), ["t"], lambda sim, obs, factor: np.nanmean(np.abs(sim - obs)) * factor, 2)


@query("m12_user_metric_cells", f"WITH {GRID_TS} SELECT yi, xi, max(inp - ref) AS value FROM grid_ts GROUP BY yi, xi", "value")
def user_metric_cells(spark, sf):
    """A caller's function over the series of each cell; none where it has no pair."""
    largest = lambda sim, obs: np.nanmax(sim - obs) if np.isfinite(sim - obs).any() else None
    return patterns.user_metric(grid_ts(spark, sf).select("yi", "xi", "t", "inp", "ref"), ["yi", "xi"], largest, sim="inp", obs="ref")


@query("a40_sketch_bounds", f"WITH {MAP_PAIR} SELECT count(*) n, true AS close FROM map_pair")
def sketch_bounds(spark, sf):
    """The sketch of the whole table, merged over its parts, against the exact share of values: within two points of its grid."""
    pairs = map_pair(spark, sf).withColumn("part", F.col("t") % 4)
    found = rank.quantile_merged(pairs, "part", "sim")
    exact = rank.rank_table(pairs, "sim").withColumnRenamed("value", "sim")
    n = pairs.filter("sim is not null").count()
    both = found.join(exact, "sim")
    return both.agg(F.count("*").alias("n"), F.bool_and(F.abs(F.col("quantile") - F.col("rank") / n) <= 0.02).alias("close"))


@query(
    "j13_naive_location",
    f"""WITH RECURSIVE {FLOW}, up AS (SELECT cell AS top, cell FROM flow UNION ALL SELECT up.top, f.cell FROM up JOIN flow f ON f.down = up.cell), n AS (SELECT top AS cell, count(*) AS n FROM up GROUP BY top)
    SELECT f.cell AS id, CASE WHEN f.cell % 3 < 2 THEN f.cell WHEN child.n * above.n > own.n * own.n THEN child.cell ELSE f.down END AS cell
    FROM flow f JOIN n own ON own.cell = f.cell JOIN n above ON above.cell = f.down LEFT JOIN n child ON child.cell = 2 * f.cell + 1 WHERE f.down IS NOT NULL""",
)
def naive_location(spark, sf):
    """Every cell's basin as a shape; of a naive location and a candidate the one whose basin fits it better: itself or the cell below it, either way round, or the cells above and below it."""
    f = flow(spark, sf)
    pairs = graph.tour(f)
    ids = f.filter("down is not null").select(F.col("cell").alias("id"), "cell", "down")
    tops = ids.join(pairs, "cell").select("id", "outlet", F.col("at").alias("a"), (F.col("at") + F.col("size")).alias("b"))
    shapes = pairs.join(tops, "outlet").filter("at >= a and at < b").select("id", "cell")
    turn = F.col("id") % 3
    naive = ids.select("id", F.when(turn == 0, F.col("cell")).when(turn == 1, F.col("down")).otherwise(2 * F.col("cell") + 1).alias("cell"))
    candidates = ids.select("id", F.when(turn == 1, F.col("cell")).otherwise(F.col("down")).alias("cell"), F.lit(1).cast("long").alias("distance"))
    areas = shapes.groupBy("id").agg(F.count("*").cast("double").alias("area"))
    return graph.snap_by_shape(areas, f, graph.accumulate(f), shapes, candidates, 1.0, naive).select("id", "cell")
