"""Queries over grids: crop, mask, regrid, coarsen, fill, bounds, tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grid, tiles
from ..sources import ascii_grid
from .registry import query
from .views import GRID_TS, STATIC_GRID, grid_ts, static_grid


@query("f01_box_crop", f"WITH {STATIC_GRID} SELECT yi, xi, lat, lon, value FROM static_grid WHERE lat BETWEEN 47 AND 49.5 AND lon BETWEEN 11 AND 13", "lat lon value")
def box_crop(spark, sf):
    """inclusive box, ends in any order."""
    return grid.crop_box(static_grid(spark, sf), (49.5, 47), (13, 11))


@query("f02_header_crop", f"WITH {STATIC_GRID} SELECT yi, xi, value FROM static_grid WHERE yi BETWEEN 2 AND 6 AND xi BETWEEN 3 AND 6", "value")
def header_crop(spark, sf):
    """corners to indices."""
    return grid.crop_index(static_grid(spark, sf), (0.0, 0.0), 0.5, (1.1, 1.4), (3.4, 3.6)).select("yi", "xi", "value")


@query("f04_overlap_crop", f"WITH {STATIC_GRID} SELECT yi, xi, value FROM static_grid WHERE xi BETWEEN 2 AND 6", "value")
def overlap_crop(spark, sf):
    """intersection of two extents."""
    g = static_grid(spark, sf)
    return grid.crop_to_overlap(g.filter("xi <= 6"), g.filter("xi >= 2"))[0].select("yi", "xi", "value")


@query("f09_apply_mask", f"WITH {STATIC_GRID}, m AS (SELECT yi, xi FROM static_grid WHERE (yi + xi) % 3 = 0 AND xi BETWEEN 2 AND 7), e AS (SELECT min(yi) a, max(yi) b, min(xi) c, max(xi) d FROM m) SELECT g.yi, g.xi, CASE WHEN m.yi IS NOT NULL THEN g.value END AS value FROM static_grid g CROSS JOIN e LEFT JOIN m ON m.yi = g.yi AND m.xi = g.xi WHERE g.yi BETWEEN a AND b AND g.xi BETWEEN c AND d", "value")
def apply_mask(spark, sf):
    """masked and cut to the filled box (ten columns leave no margin)."""
    g = static_grid(spark, sf)
    mask = g.select("yi", "xi", ((F.pmod(F.col("yi") + F.col("xi"), F.lit(3)) == 0) & F.col("xi").between(2, 7)).cast("int").alias("mask"))
    return grid.apply_mask(g.select("yi", "xi", "value"), mask, ["value"])


@query("a38_coarsen", f"WITH {STATIC_GRID} SELECT CAST(floor(yi / 2) AS BIGINT) yi, CAST(floor(xi / 2) AS BIGINT) xi, avg(value) AS value, coalesce(bool_or(lat > 48.3), false) AS north FROM (SELECT * FROM static_grid) GROUP BY 1, 2", "value")
def coarsen(spark, sf):
    """Block means and block any."""
    g = static_grid(spark, sf).withColumn("north", F.col("lat") - 48.3)
    return grid.coarsen(g, 2, {"value": "mean", "north": "any"})


@query("a39_majority", f"WITH {GRID_TS}, c AS (SELECT yi, CAST(floor(ref) AS BIGINT) % 4 AS cls, count(*) n FROM grid_ts WHERE ref IS NOT NULL GROUP BY ALL) SELECT yi, arg_min(cls, row(-n, cls)) AS cls FROM c GROUP BY yi")
def majority(spark, sf):
    """Most frequent class, the smallest of equally frequent ones."""
    classed = grid_ts(spark, sf).select("yi", F.floor("ref").cast("long").alias("r")).select("yi", (F.col("r") % 4).alias("cls"))
    return grid.majority(classed, ["yi"], "cls")


_AXES = "sy AS (SELECT DISTINCT yi i, lat c FROM static_grid), sx AS (SELECT DISTINCT xi i, lon c FROM static_grid), ty AS (SELECT i + k * CAST(0.4 AS DOUBLE) AS j, 2 * i + k i, c - k * CAST(0.2 AS DOUBLE) AS c FROM sy, (VALUES (0), (1)) v(k)), tx AS (SELECT 2 * i + k i, c + k * CAST(0.2 AS DOUBLE) AS c FROM sx, (VALUES (0), (1)) v(k))"


def _axes(g):
    sy, sx = grid.axis(g, "yi", "lat"), grid.axis(g, "xi", "lon")
    twice = F.explode(F.array(F.lit(0), F.lit(1))).alias("k")
    ty = sy.select("i", "c", twice).select((F.col("i") * 2 + F.col("k")).alias("i"), (F.col("c") - F.col("k") * 0.2).alias("c"))
    tx = sx.select("i", "c", twice).select((F.col("i") * 2 + F.col("k")).alias("i"), (F.col("c") + F.col("k") * 0.2).alias("c"))
    return sy, sx, ty, tx


@query("j05_nearest_regrid", f"WITH {STATIC_GRID}, {_AXES}, my AS (SELECT ty.i ti, arg_min(sy.i, row(abs(sy.c - ty.c), sy.c)) si FROM ty, sy GROUP BY ty.i), mx AS (SELECT tx.i ti, arg_min(sx.i, row(abs(sx.c - tx.c), sx.c)) si FROM tx, sx GROUP BY tx.i) SELECT my.ti yi, mx.ti xi, value FROM static_grid g JOIN my ON my.si = g.yi JOIN mx ON mx.si = g.xi", "value")
def nearest_regrid(spark, sf):
    """A finer grid from the nearest cells, per axis."""
    g = static_grid(spark, sf)
    sy, sx, ty, tx = _axes(g)
    return grid.regrid_nearest(g, grid.nearest_axis(sy, ty), grid.nearest_axis(sx, tx), [], ["value"])


@query(
    "j07_linear_regrid",
    f"""WITH {STATIC_GRID}, {_AXES},
    by_ AS (SELECT ty.i ti, ty.c, (SELECT max(c) FROM sy WHERE sy.c <= ty.c) lo, (SELECT min(c) FROM sy WHERE sy.c >= ty.c) hi FROM ty),
    bx AS (SELECT tx.i ti, tx.c, (SELECT max(c) FROM sx WHERE sx.c <= tx.c) lo, (SELECT min(c) FROM sx WHERE sx.c >= tx.c) hi FROM tx),
    wy AS (SELECT ti, sy.i si, CASE WHEN lo = hi THEN 1 WHEN sy.c = lo THEN (hi - by_.c) / (hi - lo) ELSE (by_.c - lo) / (hi - lo) END w FROM by_ JOIN sy ON sy.c IN (lo, hi)),
    wx AS (SELECT ti, sx.i si, CASE WHEN lo = hi THEN 1 WHEN sx.c = lo THEN (hi - bx.c) / (hi - lo) ELSE (bx.c - lo) / (hi - lo) END w FROM bx JOIN sx ON sx.c IN (lo, hi))
    SELECT wy.ti yi, wx.ti xi, CASE WHEN sum(CASE WHEN value IS NOT NULL THEN wy.w * wx.w END) > 1 - 1e-9 THEN sum(value * wy.w * wx.w) END AS value FROM static_grid g JOIN wy ON wy.si = g.yi JOIN wx ON wx.si = g.xi WHERE wy.w * wx.w > 0 GROUP BY 1, 2""",
    "value",
)
def linear_regrid(spark, sf):
    """Bilinear interpolation."""
    g = static_grid(spark, sf)
    sy, sx, ty, tx = _axes(g)
    return grid.regrid_linear(g, grid.bracket_axis(sy, ty), grid.bracket_axis(sx, tx), [], "value")


@query(
    "j06_mask_regrid",
    f"""WITH {STATIC_GRID}, m AS (SELECT yi * CAST(0.5 AS DOUBLE) lat, xi * CAST(0.5 AS DOUBLE) lon, CASE WHEN value > 25 THEN 1.0 ELSE 0.0 END mask FROM static_grid),
    t AS (SELECT a yi, b xi, a + CAST(0.5 AS DOUBLE) lat, b + CAST(0.5 AS DOUBLE) lon FROM (SELECT unnest(range(6)) a), (SELECT unnest(range(6)) b)),
    s AS (SELECT t.yi, t.xi, coalesce(sum(mask), 0) total FROM t LEFT JOIN m ON m.lat BETWEEN t.lat - 0.5 AND t.lat + 0.5 AND m.lon BETWEEN t.lon - 0.5 AND t.lon + 0.5 GROUP BY ALL)
    SELECT yi, xi, CAST(total > 1e-3 * max(total) OVER () AS INT) mask FROM s""",
)
def mask_regrid(spark, sf):
    """A fine mask on a coarser grid, centres on edges counted on both sides."""
    g = static_grid(spark, sf)
    mask = g.select((F.col("yi") * 0.5).alias("lat"), (F.col("xi") * 0.5).alias("lon"), F.when(F.col("value") > 25, 1.0).otherwise(0.0).alias("mask"))
    target = spark.range(36).select(F.floor(F.col("id") / 6).cast("long").alias("yi"), (F.col("id") % 6).alias("xi")).withColumn("lat", F.col("yi") + 0.5).withColumn("lon", F.col("xi") + 0.5)
    return grid.regrid_mask(mask, target, 1.0)


@query("j14_nearest_fill", f"WITH {STATIC_GRID}, v AS (SELECT yi, xi, value FROM static_grid WHERE value IS NOT NULL), f AS (SELECT g.yi, g.xi, arg_min(v.value, row((g.yi - v.yi) ** 2 + (g.xi - v.xi) ** 2, v.yi, v.xi)) AS value FROM static_grid g, v WHERE g.value IS NULL GROUP BY ALL) SELECT yi, xi, value FROM v UNION ALL SELECT yi, xi, value FROM f", "value")
def nearest_fill(spark, sf):
    """Missing cells from the nearest valid one."""
    return grid.fill_nearest(static_grid(spark, sf).select(F.lit(0).alias("step"), "yi", "xi", "value"), ["step"]).select("yi", "xi", "value")


@query("j14_nearest_fill_steps", f"WITH {GRID_TS}, s AS (SELECT t, yi, xi, inp FROM grid_ts), v AS (SELECT * FROM s WHERE inp IS NOT NULL), f AS (SELECT g.t, g.yi, g.xi, arg_min(v.inp, row((g.yi - v.yi) ** 2 + (g.xi - v.xi) ** 2, v.yi, v.xi)) AS inp FROM s g JOIN v ON v.t = g.t WHERE g.inp IS NULL GROUP BY ALL) SELECT t, yi, xi, inp FROM v UNION ALL SELECT t, yi, xi, inp FROM f", "inp")
def nearest_fill_steps(spark, sf):
    """Every step on its own."""
    return grid.fill_nearest(grid_ts(spark, sf).select("t", "yi", "xi", "inp"), ["t"], "inp")


@query("p13_axis_bounds", f"WITH {STATIC_GRID}, a AS (SELECT DISTINCT xi i, lon c FROM static_grid), n AS (SELECT i, c, lag(c) OVER (ORDER BY c) p, lead(c) OVER (ORDER BY c) q FROM a) SELECT i, c, coalesce((c + p) / 2, c - (q - c) / 2, c - 0.5) lo, coalesce((c + q) / 2, c + (c - p) / 2, c + 0.5) hi FROM n", "c lo hi")
def axis_bounds(spark, sf):
    """Cell bounds from centres."""
    return grid.axis_bounds(grid.axis(static_grid(spark, sf), "xi", "lon"))


@query(
    "p17_cell_area",
    f"""WITH {STATIC_GRID}, d AS (SELECT yi, xi, lat, lag(lat) OVER y p, lead(lat) OVER y q, lon, lag(lon) OVER x a, lead(lon) OVER x b FROM static_grid WINDOW y AS (PARTITION BY xi ORDER BY yi), x AS (PARTITION BY yi ORDER BY xi))
    SELECT yi, xi, 6371.0 ** 2 * radians(abs(coalesce((q - p) / 2, q - lat, lat - p))) * radians(abs(coalesce((b - a) / 2, b - lon, lon - a))) * cos(radians(lat)) AS area FROM d""",
    "area",
)
def cell_area(spark, sf):
    """Cell areas on the sphere."""
    return grid.cell_areas(static_grid(spark, sf))


@query("k03_header", f"WITH {STATIC_GRID} SELECT count(DISTINCT xi) ncols, count(DISTINCT yi) nrows, min(lon) - CAST(0.25 AS DOUBLE) xllcorner, min(lat) - CAST(0.25 AS DOUBLE) yllcorner FROM static_grid", "xllcorner yllcorner")
def header(spark, sf):
    """K3: the header of a long grid."""
    h = ascii_grid.header_of(static_grid(spark, sf))
    return spark.createDataFrame([(h.ncols, h.nrows, h.xllcorner, h.yllcorner)], "ncols long, nrows long, xllcorner double, yllcorner double")


@query("p19_template", "SELECT y AS yi, x AS xi, 10 + (4 - y - CAST(0.5 AS DOUBLE)) * 2 AS lat, 20 + (x + CAST(0.5 AS DOUBLE)) * 2 AS lon FROM (SELECT unnest(range(4)) y), (SELECT unnest(range(5)) x)", "lat lon")
def template(spark, sf):
    """Centres of a header's cells, north first; here the coarser of two levels."""
    fine = ascii_grid.Header(10, 8, 1.0, 20.0, 10.0)
    return ascii_grid.latlon_ladder(spark, fine, {"l0": 1.0, "l1": 2.0})["l1"]


@query("g11_roll", f"WITH {STATIC_GRID} SELECT yi, (xi + 5) % 10 AS xi, value FROM static_grid", "value")
def roll(spark, sf):
    """Half a turn of longitude."""
    return grid.roll_longitude(static_grid(spark, sf).select("yi", "xi", "value"), 10)


@query("g12_frame", f"WITH {STATIC_GRID}, e AS (SELECT min(yi) a, max(yi) b FROM static_grid) SELECT yi, xi, CASE WHEN yi < a + 1 OR yi > b - 1 OR xi < 1 OR xi > 8 THEN -1 ELSE value END AS value FROM static_grid, e", "value")
def frame(spark, sf):
    """A border of one cell."""
    return grid.frame(static_grid(spark, sf).select("yi", "xi", "value"), 1, "value", -1.0)


@query("g13_dilate", f"WITH {STATIC_GRID} SELECT g.yi, g.xi, CASE WHEN g.value IS NULL AND EXISTS (SELECT 1 FROM static_grid n WHERE n.value IS NOT NULL AND abs(n.yi - g.yi) <= 1 AND abs(n.xi - g.xi) <= 1) THEN -2 ELSE g.value END AS value FROM static_grid g", "value")
def dilate(spark, sf):
    """Missing cells next to data."""
    return grid.dilate(static_grid(spark, sf).select("yi", "xi", "value"), "value", -2.0)


_TILES = "t AS (SELECT r * 3 + c AS tile, r * CAST(2 AS DOUBLE) lat0, least(r * 2 + 2, 5)::DOUBLE lat1, c * CAST(2 AS DOUBLE) lon0, least(c * 2 + 2, 5)::DOUBLE lon1 FROM (SELECT unnest(range(3)) r), (SELECT unnest(range(3)) c))"


@query("g15_tiles", f"WITH {_TILES} SELECT tile, lat0, lat1, lon0, lon1 FROM t", "lat0 lat1 lon0 lon1")
def all_tiles(spark, sf):
    """Tiles over an extent, the last ones clipped."""
    return tiles.make_tiles(spark, 0, 5, 0, 5, 2)


@query("f20_active_tiles", f"WITH {STATIC_GRID}, {_TILES}, m AS (SELECT yi * CAST(0.5 AS DOUBLE) + 0.25 AS lat, xi * CAST(0.5 AS DOUBLE) + 0.25 AS lon FROM static_grid WHERE value > 24) SELECT tile, lat0, lat1, lon0, lon1 FROM t WHERE EXISTS (SELECT 1 FROM m WHERE lat + 0.25 > lat0 AND lat - 0.25 < lat1 AND lon + 0.25 > lon0 AND lon - 0.25 < lon1)", "lat0 lat1 lon0 lon1")
def active_tiles(spark, sf):
    """tiles that meet the mask."""
    g = static_grid(spark, sf)
    mask = g.select((F.col("yi") * 0.5 + 0.25).alias("lat"), (F.col("xi") * 0.5 + 0.25).alias("lon"), (F.col("value") > 24).cast("int").alias("mask"))
    return tiles.active_tiles(tiles.make_tiles(spark, 0, 5, 0, 5, 2), mask, 0.5, 2.0)


@query("g17_restart_merge", f"WITH {STATIC_GRID}, c AS (SELECT k AS tile, yi + k * 3 AS yi, xi, value * (k + 1) AS value FROM static_grid, (SELECT unnest(range(3)) k)), l AS (SELECT yi, xi, arg_max(value, tile) FILTER (true) AS v, max(tile) AS top FROM c GROUP BY yi, xi), f AS (SELECT c.yi, c.xi, c.value FROM c JOIN l ON l.yi = c.yi AND l.xi = c.xi AND l.top = c.tile) SELECT 'L1_soil' AS var, yi, xi, CASE WHEN (yi + xi) % 2 = 0 THEN value END AS value FROM f", "value")
def restart_merge(spark, sf):
    """Tiles on one grid, later over earlier, masked, renamed."""
    k = F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])).alias("tile")
    cells = static_grid(spark, sf).select(k, F.lit("soil").alias("var"), "yi", "xi", "value").withColumn("value", F.col("value") * (F.col("tile") + 1))
    corners = spark.createDataFrame([(i, 1.5 * i, 0.0) for i in range(3)], "tile long, lat0 double, lon0 double")
    mask = cells.select((F.col("yi") + F.col("tile") * 3).alias("yi"), "xi").distinct().withColumn("mask", F.when(F.pmod(F.col("yi") + F.col("xi"), F.lit(2)) == 0, 1).otherwise(0))
    out = tiles.merge_restarts(cells, corners, mask, (0.0, 0.0), 0.5, {"soil": "L1_soil"})
    return out.select("var", "yi", "xi", "value")


@query("u08_merge_masks", f"WITH {STATIC_GRID} SELECT yi, xi, CAST(coalesce(bool_or(m > 0), false) AS INT) mask FROM (SELECT yi, xi, CASE WHEN value > 30 THEN 1 ELSE 0 END m FROM static_grid UNION ALL SELECT yi, xi, CASE WHEN xi = 3 THEN 1 END FROM static_grid) GROUP BY yi, xi")
def merge_masks(spark, sf):
    """U8: any mask."""
    g = static_grid(spark, sf)
    return tiles.merge_masks(g.select("yi", "xi", F.when(F.col("value") > 30, 1).otherwise(0).alias("mask")), g.select("yi", "xi", F.when(F.col("xi") == 3, 1).alias("mask")))


@query("g18_gauge_raster", f"WITH {STATIC_GRID} SELECT yi, xi, CAST(CASE WHEN yi = xi THEN yi + 100 ELSE -9999 END AS BIGINT) gauge FROM static_grid")
def gauge_raster(spark, sf):
    """Ids at gauge cells."""
    g = static_grid(spark, sf)
    return tiles.gauge_raster(g, g.filter("yi = xi").select((F.col("yi") + 100).alias("id"), "yi", "xi"))


@query(
    "f25_polygon_cells",
    f"""WITH {STATIC_GRID}, e(id, x1, y1, x2, y2) AS (VALUES (1, 10.2, 45.3, 14.1, 46.1), (1, 14.1, 46.1, 12.3, 49.9), (1, 12.3, 49.9, 10.2, 45.3)),
    h AS (SELECT g.yi, g.xi, e.id, count(*) n FROM static_grid g JOIN e ON (e.y1 > g.lat) <> (e.y2 > g.lat) AND e.x1 + (g.lat - e.y1) / CAST(e.y2 - e.y1 AS DOUBLE) * (e.x2 - e.x1) > g.lon GROUP BY ALL)
    SELECT id, yi, xi FROM h WHERE n % 2 = 1""",
)
def polygon_cells(spark, sf):
    """cells with their centre in a polygon."""
    ring = [(1, 10.2, 45.3, 14.1, 46.1), (1, 14.1, 46.1, 12.3, 49.9), (1, 12.3, 49.9, 10.2, 45.3)]
    return grid.polygon_cells(static_grid(spark, sf), spark.createDataFrame(ring, "id int, x1 double, y1 double, x2 double, y2 double"))
