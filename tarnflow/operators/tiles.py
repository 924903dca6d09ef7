"""Tiles over an extent: making, choosing by mask, placing on the global grid, merging."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def make_tiles(spark: SparkSession, south: float, north: float, west: float, east: float, size: float) -> DataFrame:
    """tile, lat0, lat1, lon0, lon1: ceil(extent / size) tiles each way, the last ones clipped."""
    ny, nx = (max(1, math.ceil((b - a) / size - 1e-9)) for a, b in ((south, north), (west, east)))
    grid = spark.range(ny * nx).select(F.col("id").alias("tile"), F.floor(F.col("id") / nx).alias("r"), (F.col("id") % nx).alias("c"))
    return grid.select(
        "tile", (south + F.col("r") * size).alias("lat0"), F.least(south + (F.col("r") + 1) * size, F.lit(float(north))).alias("lat1"),
        (west + F.col("c") * size).alias("lon0"), F.least(west + (F.col("c") + 1) * size, F.lit(float(east))).alias("lon1"),
    )


def in_box(tiles: DataFrame, south: float, north: float, west: float, east: float, resolution: float) -> DataFrame:
    """Tiles that meet a closed box, up to 1e-9 of a cell."""
    eps = 1e-9 * resolution
    return tiles.filter((F.col("lat1") >= south - eps) & (F.col("lat0") <= north + eps) & (F.col("lon1") >= west - eps) & (F.col("lon0") <= east + eps))


def active_tiles(tiles: DataFrame, mask: DataFrame, resolution: float, size: float) -> DataFrame:
    """Tiles whose interior meets a mask cell (lat, lon centres, mask > 0); none raises.

    A range join by buckets of the tile size: tiles and cells are expanded to the buckets they touch and joined by equality.
    """
    half = resolution / 2
    buckets = lambda lo, hi: F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))
    t = tiles.withColumn("by", F.explode(buckets(F.col("lat0"), F.col("lat1")))).withColumn("bx", F.explode(buckets(F.col("lon0"), F.col("lon1"))))
    on = mask.filter("mask > 0").select("lat", "lon")
    on = on.withColumn("by", F.explode(buckets(F.col("lat") - half, F.col("lat") + half))).withColumn("bx", F.explode(buckets(F.col("lon") - half, F.col("lon") + half)))
    meets = (F.col("lat") + half > F.col("lat0")) & (F.col("lat") - half < F.col("lat1")) & (F.col("lon") + half > F.col("lon0")) & (F.col("lon") - half < F.col("lon1"))
    hit = t.join(on, ["by", "bx"]).filter(meets).select("tile").distinct()
    out = tiles.join(hit, "tile", "left_semi")
    if out.isEmpty():
        raise ValueError("no tile meets the mask")
    return out


def place_by_corner(cells: DataFrame, tiles: DataFrame, origin: tuple[float, float], cell: float) -> DataFrame:
    """Tile cells on the global grid by integer offsets of the tile's corner; ``tiles`` (tile, lat0, lon0) is a row a tile."""
    y, x = (F.round((F.col(c) - o) / cell).cast("long") for c, o in (("lat0", origin[0]), ("lon0", origin[1])))
    offset = tiles.select("tile", y.alias("__oy"), x.alias("__ox"))
    return cells.join(offset, "tile").withColumn("yi", F.col("yi") + F.col("__oy")).withColumn("xi", F.col("xi") + F.col("__ox")).drop("__oy", "__ox")


def last_writer(cells: DataFrame, order: str, keys: list[str] | None = None) -> DataFrame:
    """Of cells given several times the last in order stays."""
    w = Window.partitionBy(*(keys or []), "yi", "xi").orderBy(F.col(order).desc())
    return cells.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def merge_masks(*masks: DataFrame) -> DataFrame:
    """yi, xi, mask: whether any of the masks is over 0."""
    out = masks[0].select("yi", "xi", "mask")
    for m in masks[1:]:
        out = out.unionByName(m.select("yi", "xi", "mask"))
    return out.groupBy("yi", "xi").agg(F.coalesce(F.bool_or(F.col("mask") > 0), F.lit(False)).cast("int").alias("mask"))


def merge_restarts(cells: DataFrame, tiles: DataFrame, mask: DataFrame, origin: tuple[float, float], cell: float, renames: dict[str, str] | None = None) -> DataFrame:
    """Restart tiles on one grid: placed, later tiles over earlier ones, masked, variables renamed; ``cells``: tile, var, yi, xi, value."""
    placed = last_writer(place_by_corner(cells, tiles, origin, cell), "tile", ["var"])
    on = mask.filter("mask > 0").select("yi", "xi", F.lit(True).alias("__on"))
    out = placed.join(on, ["yi", "xi"], "left").withColumn("value", F.when(F.col("__on"), F.col("value"))).drop("__on")
    if renames:
        names = F.create_map(*[F.lit(x) for p in renames.items() for x in p])
        out = out.withColumn("var", F.coalesce(F.try_element_at(names, F.col("var")), F.col("var")))
    return out


def gauge_raster(cells: DataFrame, gauges: DataFrame, nodata: int = -9999) -> DataFrame:
    """yi, xi, gauge: the id at each gauge's cell (``gauges``: id, yi, xi), nodata elsewhere."""
    at = gauges.groupBy("yi", "xi").agg(F.max("id").alias("gauge"))
    return cells.select("yi", "xi").distinct().join(at, ["yi", "xi"], "left").fillna({"gauge": nodata})


def at_largest(df: DataFrame, keys: list[str], size: str) -> DataFrame:
    """The cell with the largest value of each key, the smallest index of equal ones."""
    return df.filter(F.col(size).isNotNull()).groupBy(*keys).agg(F.min(F.struct((-F.col(size)).alias("s"), "yi", "xi")).alias("b")).select(*keys, "b.yi", "b.xi", (-F.col("b.s")).alias(size))
