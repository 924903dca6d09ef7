"""The studied tool's pipelines, composed of the other operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.units import convert, is_intensive
from ..session import write_through
from . import climate, flow, gauges, grid, landcover, patterns, rank, resample, skill, tiles


def evaluate_discharge(series: DataFrame, alias: str = "D", min_years: int = 1, min_common_years: int = 1, ids: DataFrame | None = None) -> DataFrame:
    """Objectives of each gauge from raw series (id, t, obs, sim): one row a stamp, one step, gauges with enough years, their common span."""
    if ids is not None:
        series = series.join(ids, "id", "left_semi")
    # written once: years, common years, span and objectives all read the steps, and a task that made them anew for each held that many sorts at a time
    steps = write_through(resample.to_coarser(series, ["id"], alias, {"obs": "mean", "sim": "mean"}), "steps")
    kept = gauges.with_observed_years(steps, min_years)
    kept = kept.join(gauges.dropped_for_overlap(kept, min_common_years), "id", "left_anti")
    return skill.skill(skill.flagged_overlap(kept, ["id"], "t"), ["id"]).filter("n > 0")


def evaluate_grids(inp: DataFrame, ref: DataFrame, mask: DataFrame | None = None, direct: bool = False, alias: str = "M") -> dict[str, DataFrame]:
    """Two gridded series (yi, xi, t, value) compared; both must be on one grid (see :func:`grid.regrid_nearest`).

    ``spearman``: yi, xi, rho, n over the steps (``direct``) or over the climatologies; ``scores``: every score, per step or
    month, averaged; ``relative``: yi, xi, rel_mean, rel_std.  Without a pair of values this raises.
    """
    if mask is not None:
        on = mask.filter("mask > 0").select("yi", "xi")
        inp, ref = (x.join(on, ["yi", "xi"], "left_semi") for x in (inp, ref))
    inp, ref = grid.crop_to_overlap(inp, ref)
    cells = ["yi", "xi"]
    if direct:
        a, b = resample.crop_to_overlap(inp, ref, alias, "value", "value")
        pairs = resample.to_target(a.withColumnRenamed("value", "sim"), b.withColumnRenamed("value", "obs"), cells, alias, "sim", "obs").withColumnRenamed("t", "step")
    else:
        a, b = (climate.climatology(x, cells, "value").withColumnRenamed("clim", n) for x, n in ((inp, "sim"), (ref, "obs")))
        pairs = a.join(b, [*cells, "month"]).withColumnRenamed("month", "step")
    pairs = write_through(pairs, "pairs")
    if rank.paired(pairs, "sim", "obs").isEmpty():
        raise ValueError("no pair of values to compare")
    stats = [climate.cell_statistics(x, cells, "value").select(*cells, F.col("mean").alias(f"{n}_mean"), F.col("std").alias(f"{n}_std")) for x, n in ((inp, "inp"), (ref, "ref"))]
    relative = climate.relative_fields(stats[0].join(stats[1], cells), "inp_mean", "ref_mean", "rel_mean")
    relative = climate.relative_fields(relative, "inp_std", "ref_std", "rel_std").select(*cells, "rel_mean", "rel_std")
    return {"spearman": rank.spearman(pairs, cells, "sim", "obs"), "scores": patterns.all_metrics(pairs, "step"), "relative": relative}


def prepare_forcing(df: DataFrame, keys: list[str], value: str, unit: str, source_hours: float, target: str = "D", lat: tuple[float, float] | None = None, lon: tuple[float, float] | None = None, compat: bool = False) -> DataFrame:
    """Resampled first, then converted to degC or mm, then cropped."""
    hours = {"D": 24, "h": 1}[target]
    steps = resample.adaptive(df, keys, [value], target, source_hours, is_intensive(unit))
    out = steps.withColumn(value, convert(F.col(value), unit, hours, compat))
    return grid.crop_box(out, lat, lon) if lat and lon else out


def crop_setup(grids: dict[str, DataFrame], lat: tuple[float, float], lon: tuple[float, float], mask: DataFrame | None = None, masked: tuple[str, ...] = ("dem",)) -> dict[str, DataFrame]:
    """All grids of a setup cut to a box, templates and restart states left alone, those named masked; an empty result raises."""
    out = {}
    for name, df in grids.items():
        if name in ("latlon", "lat", "lon") or "restart" in name:
            continue
        cut = grid.crop_box(df, lat, lon)
        if mask is not None and name in masked:
            cut = grid.apply_mask(cut, mask, ["value"], buffer=False)
        if cut.isEmpty():
            raise ValueError(f"{name} has no cell in the box")
        out[name] = cut
    return out


def delineate_gauges(gauges_: DataFrame, edges: DataFrame, areas: DataFrame, nx: int, k: int = 3, max_error: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """(gauges with their cells and a check of areas, cells of each basin) for gauges (id, yi, xi, area).

    ``edges``: yi, xi, down_yi, down_xi; ``areas``: yi, xi, area; ``nx``: cells a row, which numbers the cells.
    """
    number = lambda y, x: F.col(y) * nx + F.col(x)
    graph = edges.select(number("yi", "xi").alias("cell"), number("down_yi", "down_xi").alias("down"))
    weighted = graph.join(areas.select(number("yi", "xi").alias("cell"), "area"), "cell")
    totals = flow.accumulate(weighted, "area")
    there = totals.select(F.floor(F.col("cell") / nx).cast("long").alias("yi"), (F.col("cell") % nx).alias("xi"), F.col("total").alias("facc"))
    found = gauges.snap_by_area(gauges_, there, k, max_error).withColumn("cell", number("yi", "xi"))
    basins = flow.delineate(graph, found.select("cell").distinct())
    # a gauge further down holds what drains into the gauges above it as well: their sums come from the accumulation
    own = basins.join(areas.select(number("yi", "xi").alias("cell"), "area"), "cell").groupBy(F.col("outlet").alias("cell")).agg(F.sum("area").alias("own_area"))
    out = found.join(gauges_.select("id", F.col("area").alias("reference")), "id").join(own, "cell", "left")
    return out.withColumn("acceptable", F.abs(F.col("area_cell") - F.col("reference")) <= 2 * max_error * F.col("reference")), basins


def create_catchment(directions: DataFrame, gauges_: DataFrame, cell_size: float, k: int = 3, max_error: float = 0.3) -> dict[str, DataFrame]:
    """From D8 codes to gauges and basins: ``directions`` yi, xi, lat, lon, dir; ``gauges_`` id, lat, lon, area (km2, may be missing).

    ``gauges``: each gauge's cell (the nearest one, moved within ``k`` cells to where the upstream area fits), its areas and their check; ``basins``: yi, xi, id;
    ``accumulation``: yi, xi, upstream area in km2 and number of cells.
    """
    e = grid.extent(directions).first()
    nx = e.x1 + 1
    box = directions.agg(F.max("lat").alias("north"), F.min("lon").alias("west"), F.min("yi").alias("y0"), F.min("xi").alias("x0")).first()
    near = lambda c: F.floor(c / cell_size + 0.5).cast("long")
    placed = gauges_.select("id", (near(F.lit(box.north) - F.col("lat")) + box.y0).alias("yi"), (near(F.col("lon") - F.lit(box.west)) + box.x0).alias("xi"), F.col("area").cast("double").alias("area"))
    edges = flow.edges_from_d8(directions)
    areas = grid.cell_areas(directions.select("yi", "xi", "lat", "lon")).select("yi", "xi", "area")
    number = (F.col("yi") * nx + F.col("xi")).alias("cell")
    graph = edges.select(number, (F.col("down_yi") * nx + F.col("down_xi")).alias("down")).join(areas.select(number, "area"), "cell")
    sums = flow.accumulate(graph, "area").withColumnRenamed("total", "area").join(flow.accumulate(graph).withColumnRenamed("total", "cells"), "cell")
    back = [F.floor(F.col("cell") / nx).cast("long").alias("yi"), (F.col("cell") % nx).alias("xi")]
    # a gauge without an area keeps its cell: it asks for the area that is there
    here = placed.join(sums.select(*back, F.col("area").alias("there")), ["yi", "xi"], "left").select("id", "yi", "xi", F.coalesce("area", "there").alias("area"))
    found, cells = delineate_gauges(here, edges, areas, nx, k, max_error)
    named = cells.join(found.select("id", F.col("cell").alias("outlet")), "outlet").select(*back, "id")
    return {"gauges": found, "basins": named, "accumulation": sums.select(*back, "area", "cells")}


def landcover_series(grids: DataFrame, intervals: DataFrame) -> DataFrame:
    """yi, xi, lat, lon, time, value of land-cover grids (file name in ``var``) on their intervals (file, year_start, year_end), which must follow on from each other."""
    known = landcover.half_open(landcover.check_intervals(intervals.withColumn("__all", F.lit(0)), ["__all"]), ["__all"])
    name = F.regexp_extract("file", r"([^/]+?)(\.[^./]+)?$", 1)
    return grids.join(known.select(name.alias("var"), F.col("lo").cast("timestamp_ntz").alias("time")), "var").select("yi", "xi", "lat", "lon", "time", "value")


def subdomain_masks(new_basins: DataFrame, old_basins: DataFrame, land: DataFrame) -> DataFrame:
    """yi, xi, basin, cls: every new basin takes the old class that most of its cells have, gaps of the old one filled from the nearest cell."""
    whole = grid.fill_nearest(old_basins.withColumn("__k", F.lit(0)), ["__k"], "cls").select("yi", "xi", "cls")
    on = land.filter("mask > 0").select("yi", "xi")
    cells = new_basins.filter("basin is not null").join(on, ["yi", "xi"], "left_semi")
    classes = grid.majority(cells.join(whole, ["yi", "xi"]), ["basin"], "cls")
    return cells.join(classes, "basin").select("yi", "xi", "basin", "cls")


def restart_from_tiles(cells: DataFrame, corners: DataFrame, mask: DataFrame, origin: tuple[float, float], cell: float, renames: dict[str, str] | None = None) -> DataFrame:
    """Tiles whose missing active cells are filled from their own nearest cells, on one grid, masked and renamed."""
    filled = grid.fill_nearest(cells, ["tile", "var"], "value")
    return tiles.merge_restarts(filled, corners, mask, origin, cell, renames)


def surrogate_ids(df: DataFrame, raw: str = "id") -> DataFrame:
    """``df`` with ``numeric_id``: the number that an id spells, else the next free numbers in order of the text; of several spellings of one number the first keeps it."""
    text = F.coalesce(F.trim(F.col(raw).cast("string")), F.lit(""))
    keys = df.select(text.alias("__key")).distinct().withColumn("__n", F.expr("try_cast(__key as long)"))
    taken = keys.filter("__n is not null").groupBy("__n").agg(F.min("__key").alias("__key"))
    top = taken.agg(F.max("__n")).first()[0] or 0
    numbered = rank.numbered(keys.select("__key").join(taken.select("__key"), "__key", "left_anti"), "__key", "__k")
    ids = taken.select("__key", F.col("__n").alias("numeric_id")).unionByName(numbered.select("__key", (F.col("__k") + top).alias("numeric_id")))
    return df.withColumn("__key", text).join(ids, "__key").drop("__key")


def parse_coordinates(text: str) -> tuple[float, float]:
    """``lat,lon``."""
    parts = text.split(",")
    if len(parts) != 2:
        raise ValueError("coordinates are two numbers with a comma between them")
    return float(parts[0]), float(parts[1])


def mask_limits(mask: DataFrame, resolution: float) -> dict[str, float]:
    """The box of a mask's cells, edges included."""
    r = mask.filter("mask > 0").agg(F.min("lat").alias("a"), F.max("lat").alias("b"), F.min("lon").alias("c"), F.max("lon").alias("d")).first()
    if r.a is None:
        raise ValueError("the mask has no valid cell")
    half = resolution / 2
    return {"south": r.a - half, "north": r.b + half, "west": r.c - half, "east": r.d + half}
