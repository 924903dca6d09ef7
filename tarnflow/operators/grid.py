"""Grids as long tables (yi, xi, ..., value): crop, mask, regrid, coarsen, fill, bounds, areas.

Cells are joined by integer index, never by coordinate.  Axes (the distinct coordinates of one
direction) are small next to grids: nearest and bracketing maps are made per axis and joined by
index, so no two grids are ever compared cell by cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arith import safe_div
from ..session import ship_package

#: Cells of an axis that may be sent to every executor.
AXIS = 1_000_000


def crop_box(df: DataFrame, lat: tuple[float, float], lon: tuple[float, float]) -> DataFrame:
    """Inclusive label range, whatever the order of its ends; a plain predicate that reaches the scan."""
    return df.filter(F.col("lat").between(min(lat), max(lat)) & F.col("lon").between(min(lon), max(lon)))


def crop_index(df: DataFrame, origin: tuple[float, float], cell: float, lower: tuple[float, float], upper: tuple[float, float]) -> DataFrame:
    """Header crop: corners to indices by ``int(distance / cell + 0.5)``, upper index exclusive."""
    y0, x0 = (int((lower[i] - origin[i]) / cell + 0.5) for i in (0, 1))
    y1, x1 = (int((upper[i] - origin[i]) / cell + 0.5) for i in (0, 1))
    return df.filter(F.col("yi").between(y0, y1 - 1) & F.col("xi").between(x0, x1 - 1))


def extent(df: DataFrame, y: str = "yi", x: str = "xi") -> DataFrame:
    return df.agg(F.min(y).alias("y0"), F.max(y).alias("y1"), F.min(x).alias("x0"), F.max(x).alias("x1"))


def crop_to_overlap(a: DataFrame, b: DataFrame, y: str = "yi", x: str = "xi") -> tuple[DataFrame, DataFrame]:
    """Both grids cut to the intersection of their extents; disjoint ones raise."""
    p, q = extent(a, y, x).first(), extent(b, y, x).first()
    if None in (*p, *q):
        raise ValueError("an empty grid has no extent")
    y0, y1, x0, x1 = max(p.y0, q.y0), min(p.y1, q.y1), max(p.x0, q.x0), min(p.x1, q.x1)
    if y0 > y1 or x0 > x1:
        raise ValueError("the grids do not overlap")
    inside = F.col(y).between(y0, y1) & F.col(x).between(x0, x1)
    return a.filter(inside), b.filter(inside)


def crop_to_mask(df: DataFrame, mask: DataFrame) -> DataFrame:
    e = extent(mask.filter("mask > 0")).first()
    if e.y0 is None:
        raise ValueError("the mask has no valid cell")
    return df.filter(F.col("yi").between(e.y0, e.y1) & F.col("xi").between(e.x0, e.x1))


def apply_mask(df: DataFrame, mask: DataFrame, values: list[str], buffer: bool = True) -> DataFrame:
    """Values outside of the mask become missing; the grid is cut to the mask's filled box and a margin of up to 5 cells."""
    on = mask.filter("mask > 0").select("yi", "xi", F.lit(True).alias("__on"))
    e, whole = extent(on).first(), extent(df).first()
    if e.y0 is None:
        raise ValueError("the mask has no valid cell")
    ny, nx = whole.y1 - whole.y0 + 1, whole.x1 - whole.x0 + 1
    pad = min(5, nx // 20, ny // 20) if buffer else 0
    inside = F.col("yi").between(e.y0 - pad, e.y1 + pad) & F.col("xi").between(e.x0 - pad, e.x1 + pad)
    out = df.filter(inside).join(on, ["yi", "xi"], "left")
    return out.withColumns({v: F.when(F.col("__on"), F.col(v)) for v in values}).drop("__on")


def choose_mask(resolutions: dict[str, float], target: float, name: str | None = None, tolerance: float = 1e-6) -> str:
    """The mask variable for a grid: the named one, one of equal resolution, else the finest finer one; only coarser ones raise."""
    if name is not None:
        return name
    equal = [m for m, r in sorted(resolutions.items()) if abs(r - target) <= tolerance * target]
    finer = sorted((r, m) for m, r in resolutions.items() if r < target)
    if not equal and not finer:
        raise ValueError("no mask is as fine as the grid")
    return equal[0] if equal else finer[0][1]


def filled_box(df: DataFrame, on: str, buffer: int = 0, block: int = 1) -> dict[str, int]:
    """Index ranges (stop exclusive) around the true cells, widened to whole blocks."""
    e = extent(df.filter(on)).first()
    if e.y0 is None:
        raise ValueError("no true cell")
    low = lambda v: math.floor((v - buffer) / block) * block
    high = lambda v: math.ceil((v + 1 + buffer) / block) * block
    return {"y0": low(e.y0), "y1": high(e.y1), "x0": low(e.x0), "x1": high(e.x1)}


def align_outward(low: float, high: float, edges: list[float]) -> tuple[float, float]:
    """Bounds moved outward to enclosing edges of a coarser grid."""
    below, above = [e for e in edges if e <= low], [e for e in edges if e >= high]
    return (max(below) if below else low), (min(above) if above else high)


def coarsen(df: DataFrame, k: int, values: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """Blocks of k by k cells: ``mean``, ``sum``, ``any`` (more than 0), ``max``, ``count``."""
    how = {"mean": F.avg, "sum": F.sum, "max": F.max, "count": F.count, "any": lambda c: F.coalesce(F.bool_or(F.col(c) > 0), F.lit(False))}
    block = [F.floor(F.col(c) / k).cast("long").alias(c) for c in ("yi", "xi")]
    return df.groupBy(*(keys or []), *block).agg(*[how[h](c).alias(c) for c, h in values.items()])


def majority(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The most frequent value of each key, the smallest of equally frequent ones."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__n"))
    return counted.groupBy(*keys).agg(F.min(F.struct((-F.col("__n")).alias("n"), F.col(value).alias("v"))).alias("m")).select(*keys, F.col("m.v").alias(value))


def _back_and_ahead(df: DataFrame, keys: list[str], order: str, here: Column, names: tuple[str, str]) -> DataFrame:
    """``df`` with the last ``here`` at or before each row in ``order``, and the next at or after it.

    Looking ahead is looking back in descending order: a frame that only grows takes one pass, one up to the end a pass for each row.
    """
    for name, by in zip(names, (F.col(order).asc(), F.col(order).desc()), strict=True):
        df = df.withColumn(name, F.last(here, True).over(Window.partitionBy(*keys).orderBy(by).rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    return df


def _axes_together(source: DataFrame, target: DataFrame) -> DataFrame:
    """Both axes in one ordering, with the source coordinates around each (``b``, ``a``).  An axis has at most ``AXIS`` or so cells, and is one series: a single key."""
    both = source.select(F.lit(0).alias("__k"), "c", F.col("i").alias("si"), F.lit(None).cast("long").alias("ti")).unionByName(target.select(F.lit(0).alias("__k"), "c", F.lit(None).cast("long").alias("si"), F.col("i").cast("long").alias("ti")))
    return _back_and_ahead(both, ["__k"], "c", F.when(F.col("si").isNotNull(), F.struct("c", "si")), ("b", "a"))


def nearest_axis(source: DataFrame, target: DataFrame, tolerance: float | None = None) -> DataFrame:
    """(ti, si): of each coordinate (``i``, ``c``) of the target axis the nearest of the source's; the smaller of equally near ones.

    One ordering of both axes together, looking back and ahead: no cross join.
    """
    both = _axes_together(source, target)
    back, ahead = F.col("c") - F.col("b.c"), F.col("a.c") - F.col("c")
    use = F.when(F.col("a").isNull() | (back <= ahead), F.col("b")).otherwise(F.col("a"))
    out = both.filter("ti is not null").select("ti", use.alias("u"), "c")
    if tolerance is not None:
        out = out.filter(F.abs(F.col("u.c") - F.col("c")) <= tolerance)
    return out.select("ti", F.col("u.si").alias("si"))


def bracket_axis(source: DataFrame, target: DataFrame) -> DataFrame:
    """(ti, si, weight): the one or two source coordinates around each target coordinate; outside of the source none."""
    both = _axes_together(source, target)
    share = safe_div(F.col("c") - F.col("b.c"), F.col("a.c") - F.col("b.c"))
    two = F.array(F.struct(F.col("b.si").alias("si"), (1 - share).alias("weight")), F.struct(F.col("a.si").alias("si"), share.alias("weight")))
    one = F.array(F.struct(F.col("b.si").alias("si"), F.lit(1.0).alias("weight")))
    inside = both.filter("ti is not null and a is not null and b is not null")
    return inside.select("ti", F.explode(F.when(F.col("a.c") == F.col("b.c"), one).otherwise(two)).alias("p")).select("ti", "p.si", "p.weight")


def axis(df: DataFrame, index: str, coordinate: str) -> DataFrame:
    return df.select(F.col(index).cast("long").alias("i"), F.col(coordinate).cast("double").alias("c")).distinct()


def _sent(map_: DataFrame) -> DataFrame:
    """An axis map: broadcast behind a check of its size, else joined as it is."""
    return F.broadcast(map_) if map_.limit(AXIS + 1).count() <= AXIS else map_


def regrid_nearest(df: DataFrame, ymap: DataFrame, xmap: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Every target cell takes the value of its nearest source cell."""
    y = _sent(ymap.select(F.col("ti").alias("__ty"), F.col("si").alias("yi")))
    x = _sent(xmap.select(F.col("ti").alias("__tx"), F.col("si").alias("xi")))
    return df.join(y, "yi").join(x, "xi").select(*keys, F.col("__ty").alias("yi"), F.col("__tx").alias("xi"), *values)


def regrid_linear(df: DataFrame, ymap: DataFrame, xmap: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Bilinear interpolation; missing where one of the cells around is missing, none outside of the source."""
    y = _sent(ymap.select(F.col("ti").alias("__ty"), F.col("si").alias("yi"), F.col("weight").alias("__wy")))
    x = _sent(xmap.select(F.col("ti").alias("__tx"), F.col("si").alias("xi"), F.col("weight").alias("__wx")))
    w = F.col("__wy") * F.col("__wx")
    joined = df.join(y, "yi").join(x, "xi").filter(w > 0).groupBy(*keys, F.col("__ty").alias("yi"), F.col("__tx").alias("xi"))
    # all of the weight must be there: a missing corner, or one without a row, leaves the cell missing
    total = F.sum(F.when(F.col(value).isNotNull(), w))
    return joined.agg(F.when(total > 1 - 1e-9, F.sum(F.col(value) * w)).alias(value))


def regrid_mask(mask: DataFrame, target: DataFrame, res: float, finer: bool = False) -> DataFrame:
    """A fine mask on a coarser grid: per target cell (yi, xi, lat, lon) the sum of mask cells with their centre in the closed cell, 1 where it is over 1e-3 of the largest.

    Centres on an edge count on both sides.  Buckets of the target's size are joined by equality, each centre to the one or two cells it can be in.
    """
    if finer:
        raise NotImplementedError("the target grid is finer than the mask")
    near = lambda c: F.array_distinct(F.array(F.floor(c / res - 1e-9).cast("long"), F.floor(c / res + 1e-9).cast("long")))
    # target cells by the position of their lower edge
    cells = target.withColumn("by", F.round(F.col("lat") / res - 0.5).cast("long")).withColumn("bx", F.round(F.col("lon") / res - 0.5).cast("long"))
    points = mask.select(F.explode(near(F.col("lat"))).alias("by"), "lon", "mask").select("by", F.explode(near(F.col("lon"))).alias("bx"), "mask")
    sums = points.groupBy("by", "bx").agg(F.sum("mask").alias("total"))
    out = cells.join(sums, ["by", "bx"], "left").select("yi", "xi", F.coalesce("total", F.lit(0.0)).alias("total"))
    top = out.agg(F.max("total")).first()[0] or 0.0
    return out.select("yi", "xi", (F.col("total") > 1e-3 * top).cast("int").alias("mask"))


def finer_side(a: DataFrame, b: DataFrame) -> str:
    """Which grid has more cells: a, b, or equal (equal numbers of cells with other labels are not the same grid)."""
    n, m = (f.select("yi", "xi").distinct().count() for f in (a, b))
    return "a" if n > m else "b" if m > n else "equal"


def fill_nearest(df: DataFrame, keys: list[str], value: str = "value", mask: str | None = None, default: float | None = None, step: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Missing cells take the value of the nearest valid cell of their step (smallest yi, xi of equally near ones).

    The distance is split by direction.  Along each row, windows tell the valid cells on either side of a gap: no column beyond them holds a nearer
    cell.  Down each column of a gap, windows give the nearest valid cell above or below; then each missing cell is searched sideways,
    outwards until no column further off can be nearer.  So a task holds a column's cells or those of a row's gaps, many rows a batch, however far the nearest valid cell is.
    Valid cells stay; masked cells are not filled; steps without a valid cell take ``default``.
    """
    ship_package(df.sparkSession)
    wanted = F.col(value).isNull() if mask is None else F.col(value).isNull() & (F.col(mask) > 0)
    valid = df.filter(F.col(value).isNotNull()).select(*keys, "yi", "xi", F.col(value).cast("double").alias("__v"), F.lit(0).alias("__want"))
    missing = df.filter(wanted).select(*keys, "yi", "xi", F.lit(None).cast("double").alias("__v"), F.lit(1).alias("__want")).distinct()
    cells = valid.unionByName(missing)
    sides = _back_and_ahead(cells, [*keys, "yi"], "xi", F.when(F.col("__want") == 0, F.col("xi")), ("__l", "__r")).filter("__want = 1")
    # a gap without a valid cell on one side reaches to the end of its step's columns
    ends = cells.groupBy(*keys).agg(F.min("xi").alias("__lo"), F.max("xi").alias("__hi"))
    gaps = sides.join(ends, keys).select(*keys, "yi", F.coalesce("__l", "__lo").alias("__l"), F.coalesce("__r", "__hi").alias("__r")).distinct()
    probes = gaps.select(*keys, "yi", F.explode(F.sequence("__l", "__r")).alias("xi"), F.lit(None).cast("double").alias("__v"), F.lit(-1).alias("__want"))
    both = _back_and_ahead(cells.unionByName(probes), [*keys, "xi"], "yi", F.when(F.col("__want") == 0, F.struct(F.col("yi").alias("y"), F.col("__v").alias("v"))), ("__a", "__b"))
    near = F.when(F.col("__b").isNull() | (F.col("yi") - F.col("__a.y") <= F.col("__b.y") - F.col("yi")), F.col("__a")).otherwise(F.col("__b"))
    rows = both.filter("__want <> 0").select(*keys, "yi", "xi", (F.col("__want") == 1).alias("__want"), near.alias("__s"))
    rows = rows.select(*keys, "yi", "xi", "__want", F.col("__s.y").cast("double").alias("__sy"), F.col("__s.v").alias("__sv"))
    out_schema = rows.select(*keys, "yi", "xi", F.col("__sv").alias("__fill")).schema
    line = [*keys, "yi"]
    found = rows.repartition(*line).sortWithinPartitions(*line, "xi").mapInPandas(lambda parts: search_lines(parts, line, step), out_schema)
    out = df.join(found, [*keys, "yi", "xi"], "left")
    filled = F.coalesce(F.col(value), F.col("__fill").cast(df.schema[value].dataType), F.when(wanted, F.lit(default)) if default is not None else F.lit(None))
    return out.withColumn(value, filled).drop("__fill")


def search_lines(parts: Iterator[pd.DataFrame], line: list[str], step: tuple[float, float]) -> Iterator[pd.DataFrame]:
    """Batches sorted by row of a grid, then column: what whole rows they hold are searched together, the last one with the next batch."""
    held = None
    for part in parts:
        part = part if held is None else pd.concat([held, part], ignore_index=True)
        new = (part[line] != part[line].shift()).any(axis=1).to_numpy()
        last = int(np.flatnonzero(new)[-1]) if len(part) else 0
        held = part.iloc[last:]
        if last:
            yield search_rows(part.iloc[:last], np.cumsum(new[:last]), line, step)
    if held is not None and len(held):
        yield search_rows(held, np.ones(len(held), np.int64), line, step)


def search_rows(pdf: pd.DataFrame, row: np.ndarray, line: list[str], step: tuple[float, float]) -> pd.DataFrame:
    """Of rows of a grid (numbers ``row``, ascending): each wanted cell's best (distance, sy, xi) among its row's columns' nearest cells ``__sy``, ``__sv``."""
    want, known = pdf["__want"].to_numpy(bool), pdf["__sy"].notna().to_numpy()
    out, here = pdf[want], pdf[known]
    x, sy, sv = (here[c].to_numpy(float) for c in ("xi", "__sy", "__sv"))
    at, own, theirs = out["xi"].to_numpy(float), row[want], row[known]
    fill = np.full(len(at), np.nan)
    if len(x) and len(at):
        up = ((here["yi"].to_numpy(float) - sy) * step[0]) ** 2
        best = np.full((len(at), 3), np.inf)
        # places along all rows, one after another
        low, width = min(x.min(), at.min()), max(x.max(), at.max()) - min(x.min(), at.min()) + 1
        right = np.searchsorted(theirs * width + x - low, own * width + at - low)
        for side, first in ((1, right), (-1, right - 1)):
            live, k = np.arange(len(at)), first.copy()
            while True:
                inside = (k >= 0) & (k < len(x))
                inside[inside] = theirs[k[inside]] == own[live[inside]]
                live, k = live[inside], k[inside]
                if not len(live):
                    break
                across = ((x[k] - at[live]) * step[1]) ** 2
                go_on = across <= best[live, 0]
                live, k, across = live[go_on], k[go_on], across[go_on]
                new = np.stack([across + up[k], sy[k], x[k]], axis=1)
                old = best[live]
                better = (new[:, 0] < old[:, 0]) | ((new[:, 0] == old[:, 0]) & ((new[:, 1] < old[:, 1]) | ((new[:, 1] == old[:, 1]) & (new[:, 2] < old[:, 2]))))
                best[live[better]], fill[live[better]] = new[better], sv[k[better]]
                k = k + side
    return out[[*line, "xi"]].assign(__fill=pd.Series(fill, index=out.index).astype(object).where(~np.isnan(fill), None))


def axis_bounds(axis_: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """i, c, lo, hi: midpoints between neighbours, outer ones extrapolated by the neighbour's step, half a unit around a single one."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("c")
    before, after = F.lag("c").over(w), F.lead("c").over(w)
    lo = F.coalesce((F.col("c") + before) / 2, F.col("c") - (after - F.col("c")) / 2, F.col("c") - 0.5)
    hi = F.coalesce((F.col("c") + after) / 2, F.col("c") + (F.col("c") - before) / 2, F.col("c") + 0.5)
    return axis_.select(*(keys or []), "i", "c", lo.alias("lo"), hi.alias("hi"))


def resolution(axis_: DataFrame, levels: list[float] | None = None, tolerance: float = 1e-5) -> float:
    """Mean step of an axis, or the known level that it is within the tolerance of."""
    r = axis_.agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.countDistinct("c").alias("n")).first()
    if r.n < 2:
        raise ValueError("a single coordinate has no step")
    step = (r.hi - r.lo) / (r.n - 1)
    return next((x for x in levels or [] if abs(x - step) <= tolerance), step)


def cell_areas(cells: DataFrame, radius: float = 6371.0) -> DataFrame:
    """yi, xi, area in km2: R2 dlat dlon cos(lat), steps centred inside and one-sided at the ends of each axis."""
    def gradient(c: str, along: list[str], order: str) -> Column:
        w = Window.partitionBy(*along).orderBy(order)
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        return F.coalesce((after - before) / 2, after - F.col(c), F.col(c) - before)

    steps = cells.select("yi", "xi", "lat", F.abs(gradient("lat", ["xi"], "yi")).alias("dlat"), F.abs(gradient("lon", ["yi"], "xi")).alias("dlon"))
    return steps.select("yi", "xi", (radius**2 * F.radians("dlat") * F.radians("dlon") * F.cos(F.radians("lat"))).alias("area"))


def integer_ratio(coarse: float, fine: float, tolerance: float = 1e-6) -> int:
    """How many fine cells make a coarse one; anything but an integer raises."""
    ratio = coarse / fine
    if ratio < 1 - tolerance or abs(ratio - round(ratio)) > tolerance * max(1.0, ratio):
        raise ValueError(f"{coarse} is no integer multiple of {fine}")
    return round(ratio)


def resolution_ladder(l0: float, l1: float, l11: float | None = None, l2: float | None = None) -> dict[str, float]:
    """Terrain, hydrology, routing, meteorology; the last two are the second where they are not given."""
    out = {"l0": l0, "l1": l1, "l11": l11 or l1, "l2": l2 or l1}
    for name in ("l1", "l11", "l2"):
        integer_ratio(out[name], l0)
    return out


def roll_longitude(df: DataFrame, nx: int) -> DataFrame:
    """Half a turn: the index moves by nx / 2."""
    return df.withColumn("xi", F.pmod(F.col("xi") + nx // 2, F.lit(nx)))


def frame(df: DataFrame, width: int, value: str, constant: float) -> DataFrame:
    """A border of so many cells set to a constant."""
    e = extent(df).first()
    border = (F.col("yi") < e.y0 + width) | (F.col("yi") > e.y1 - width) | (F.col("xi") < e.x0 + width) | (F.col("xi") > e.x1 - width)
    return df.withColumn(value, F.when(border, F.lit(constant)).otherwise(F.col(value)))


def dilate(df: DataFrame, value: str, constant: float) -> DataFrame:
    """Missing cells next to a valid one (eight neighbours) become a constant."""
    near = df.filter(F.col(value).isNotNull()).select(F.explode(F.sequence(F.col("yi") - 1, F.col("yi") + 1)).alias("yi"), "xi")
    near = near.select("yi", F.explode(F.sequence(F.col("xi") - 1, F.col("xi") + 1)).alias("xi")).distinct().withColumn("__near", F.lit(True))
    return df.join(near, ["yi", "xi"], "left").withColumn(value, F.when(F.col(value).isNull() & F.col("__near"), F.lit(constant)).otherwise(F.col(value))).drop("__near")


def polygon_cells(cells: DataFrame, edges: DataFrame) -> DataFrame:
    """id, yi, xi of the cells whose centre lies in a polygon; ``edges``: id, x1, y1, x2, y2 (closed rings).

    Crossing numbers of a ray to the right: an edge meets the rows between its ends only, which it is expanded to, so cells and edges are joined by (row).
    """
    rows = cells.select(F.col("yi").alias("row"), F.col("lat").alias("y")).distinct()
    ends = rows.agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.count("*").alias("n")).first()
    step = (ends.hi - ends.lo) / max(1, ends.n - 1) or 1.0
    bin_ = lambda c: F.floor((c - ends.lo) / step).cast("long")
    spread = edges.filter("y1 <> y2").withColumn("bin", F.explode(F.sequence(bin_(F.least("y1", "y2")), bin_(F.greatest("y1", "y2")))))
    crossed = rows.withColumn("bin", bin_(F.col("y"))).join(spread, "bin").filter((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y")))
    crossed = crossed.select("row", "id", (F.col("x1") + (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))).alias("cut"))
    hits = cells.select("yi", "xi", "lon").join(crossed, F.col("yi") == F.col("row")).filter("cut > lon").groupBy("id", "yi", "xi").agg(F.count("*").alias("n"))
    return hits.filter("n % 2 = 1").select("id", "yi", "xi")


def covered_shares(cells: DataFrame, edges: DataFrame, size: float) -> DataFrame:
    """id, yi, xi, share of each cell that polygons cover; ``edges``: id, x1, y1, x2, y2 (closed rings, counter-clockwise outside, holes the other way).

    The area under each edge is cut to columns and, within the column, to the heights of its cells: each edge adds, with the sign of its direction, what
    lies between it and a cell's lower side.  Edges are expanded to the columns they cross and joined by column; a sum a cell remains.
    """
    half = size / 2
    column = cells.groupBy("xi").agg(F.min("lon").alias("cx"))
    span = column.agg(F.min("cx").alias("lo"), F.min("xi").alias("i")).first()
    if span.lo is None:
        return cells.select(F.lit(None).cast("long").alias("id"), "yi", "xi", F.lit(0.0).alias("share")).limit(0)
    of = lambda x: F.floor((x - (span.lo - half)) / size).cast("long") + span.i
    cut = edges.filter("x1 <> x2").withColumn("xi", F.explode(F.sequence(of(F.least("x1", "x2")), of(F.greatest("x1", "x2"))))).join(column, "xi")
    at = lambda x: F.col("y1") + (x - F.col("x1")) / (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    left, right = F.greatest(F.least("x1", "x2"), F.col("cx") - half), F.least(F.greatest("x1", "x2"), F.col("cx") + half)
    cut = cut.withColumn("a", left).withColumn("b", right).filter("b > a")
    cut = cut.select("id", "xi", (F.signum(F.col("x1") - F.col("x2")) * (F.col("b") - F.col("a"))).alias("dx"), at(F.col("a")).alias("ya"), at(F.col("b")).alias("yb"))
    # rows between the lowest and the highest point of the polygon
    reach = edges.groupBy("id").agg(F.min(F.least("y1", "y2")).alias("lo"), F.max(F.greatest("y1", "y2")).alias("hi"))
    boxed = cut.join(reach, "id").join(cells.select("yi", "xi", "lat"), "xi").filter((F.col("lat") + half > F.col("lo")) & (F.col("lat") - half < F.col("hi")))
    low, high = F.col("lat") - half, F.col("lat") + half
    # mean over the edge of its height within the cell: an antiderivative's difference, or the height itself where it is level
    under = lambda y: F.when(y <= low, 0.0).when(y >= high, size**2 / 2 + size * (y - high)).otherwise((y - low) ** 2 / 2)
    inside = lambda y: F.least(F.greatest(y - low, F.lit(0.0)), F.lit(size))
    ya, yb = F.col("ya"), F.col("yb")
    height = F.when(F.abs(yb - ya) < 1e-9 * size, inside((ya + yb) / 2)).otherwise((under(yb) - under(ya)) / F.nullif(yb - ya, F.lit(0.0)))
    out = boxed.groupBy("id", "yi", "xi").agg((F.sum(F.col("dx") * height) / size**2).alias("share"))
    return out.withColumn("share", F.least(F.greatest("share", F.lit(0.0)), F.lit(1.0))).filter("share > 1e-12")


def shape_areas(cells: DataFrame, edges: DataFrame, areas: DataFrame, size: float) -> DataFrame:
    """id, area: cell areas (yi, xi, area) weighted with the share that a polygon covers."""
    return covered_shares(cells, edges, size).join(areas, ["yi", "xi"]).groupBy("id").agg(F.sum(F.col("share") * F.col("area")).alias("area"))


#: The ellipsoid's half axis in km and eccentricity.
_HALF_AXIS, _ECCENTRICITY = 6378.137, 0.0818191908426215


def polygon_areas(edges: DataFrame) -> DataFrame:
    """id, area in km2 of polygons in degrees, largest first: in a cylindrical equal-area projection of the ellipsoid."""
    def height(lat: str) -> Column:
        s, e = F.sin(F.radians(lat)), _ECCENTRICITY
        return (1 - e**2) * (s / (1 - e**2 * s**2) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))

    x1, x2 = F.radians("x1"), F.radians("x2")
    cross = x1 * height("y2") - x2 * height("y1")
    return edges.groupBy("id").agg((F.abs(F.sum(cross)) / 2 * (_HALF_AXIS**2 / 2)).alias("area")).orderBy(F.col("area").desc(), "id")
