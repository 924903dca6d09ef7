"""Flow directions on a coarser grid: each unit of ``factor`` x ``factor`` cells drains into one of its eight neighbours.

A unit's outlet is the cell with the largest accumulation among those that drain out of it.  Downstream of an outlet the next outlet is
found by doubling over the whole grid; where its unit is a neighbour, the unit drains there.  The others are mended in rounds: a unit moves its outlet to the
largest of its other ways out from which the next outlet is a neighbour's; the round with the fewest conflicts stays.  What is left
drains into the neighbour that the outlet's water enters, or else the neighbour with the least larger accumulation; accumulation grows
along every link, so that no loops arise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_through
from .flow import accumulate, basins

ROW = 1 << 31


def number(yi: Column, xi: Column) -> Column:
    return yi * F.lit(ROW).cast("long") + xi


def _unit(cell: Column, factor: int) -> Column:
    x = cell % ROW
    return number(F.floor((cell - x) / (ROW * factor)).cast("long"), F.floor(x / factor).cast("long"))


def _adjacent(a: Column, b: Column) -> Column:
    ax, bx = a % ROW, b % ROW
    return (F.abs((a - ax) / ROW - (b - bx) / ROW) <= 1) & (F.abs(ax - bx) <= 1) & (a != b)


def _state(flow: DataFrame, ways: DataFrame, outlets: DataFrame) -> DataFrame:
    """Each way out (unit, cell, down, total) with ``next``, the unit of the first outlet below it, whether that is a neighbour's, and whether it is the outlet."""
    marked = outlets.select("cell", F.lit(True).alias("__outlet"))
    cut = flow.join(marked.hint("merge"), "cell", "left").select("cell", F.when(F.col("__outlet").isNull(), F.col("down")).alias("down"))
    # the last cell of a path that leaves the grid is an outlet as well, or lies in a unit without a larger one
    reach = basins(cut).join(marked.withColumnRenamed("cell", "outlet").hint("merge"), "outlet", "left").filter("__outlet").select(F.col("cell").alias("down"), F.col("outlet").alias("below"))
    found = ways.join(reach.hint("merge"), "down", "left").join(marked.hint("merge"), "cell", "left")
    return write_through(found.select("unit", "cell", "down", "total", "below", F.coalesce("__outlet", F.lit(False)).alias("outlet")), "ways")


def upscale(cells: DataFrame, factor: int, weight: str | None = None, rounds: int = 4) -> tuple[DataFrame, float | None]:
    """(units, share of them in error) of ``cells``: yi, xi, down_yi, down_xi (null where water leaves), perhaps ``weight``; indices from 0 on.

    units: yi, xi, down_yi, down_xi on the coarse grid, the outlet's out_yi, out_xi and total, and ``error``: the link is not the one that cells tell.
    """
    cell, down = number(F.col("yi"), F.col("xi")), number(F.col("down_yi"), F.col("down_xi"))
    flow = write_through(cells.select(cell.alias("cell"), down.alias("down"), *([F.col(weight).alias("weight")] if weight else [])), "fine")
    totals = accumulate(flow, "weight" if weight else None)
    own = _unit(F.col("cell"), factor)
    leaving = F.col("down").isNull() | (_unit(F.col("down"), factor) != own)
    ways = write_through(flow.filter(leaving).join(totals.hint("merge"), "cell").select(own.alias("unit"), "cell", "down", "total"), "exits")
    largest = F.max_by(F.struct("cell"), F.struct("total", (-F.col("cell")).alias("c")))
    outlets = ways.groupBy("unit").agg(largest.alias("b")).select("unit", "b.cell")
    best, fewest = None, None
    neighbour = F.col("below").isNotNull() & _adjacent(F.col("unit"), _unit(F.col("below"), factor))
    # an outlet whose water leaves the grid has no link to be in error
    wrong = F.col("below").isNotNull() & ~neighbour
    for k in range(rounds + 1):
        state = _state(flow.select("cell", "down"), ways, outlets)
        bad = state.filter("outlet").filter(wrong)
        n = bad.count()
        if fewest is not None and n >= fewest:
            break
        best, fewest = state, n
        if n == 0 or k == rounds:
            break
        better = state.filter("NOT outlet").filter(neighbour).join(bad.select("unit").hint("merge"), "unit", "left_semi").groupBy("unit").agg(largest.alias("b")).select("unit", F.col("b.cell").alias("moved"))
        outlets = write_through(state.filter("outlet").select("unit", "cell").join(better.hint("merge"), "unit", "left").select("unit", F.coalesce("moved", "cell").alias("cell")), "outlets")
    out = best.filter("outlet").select("unit", "cell", "down", "total", wrong.alias("error"), F.when(neighbour, _unit(F.col("below"), factor)).alias("link"))
    # of what is left: neighbours with a larger accumulation, the one that the water enters first
    x = F.col("unit") % ROW
    around = F.explode(F.array(*[F.struct((F.col("unit") + dy * ROW + dx).alias("near"), (x + dx >= 0).alias("inside")) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx])).alias("n")
    open_ = out.filter("error").select("unit", "total", _unit(F.col("down"), factor).alias("entered"), around).filter("n.inside").select("unit", "total", "entered", F.col("n.near").alias("near"))
    sizes = out.select(F.col("unit").alias("near"), F.col("total").alias("size"))
    chosen = open_.join(sizes.hint("merge"), "near").filter("size > total").groupBy("unit").agg(F.min_by("near", F.struct(F.col("near") != F.col("entered"), F.col("size"), F.col("near"))).alias("mended"))
    out = out.join(chosen.hint("merge"), "unit", "left").withColumn("link", F.coalesce("link", "mended"))
    row = lambda c: ((F.col(c) - F.col(c) % ROW) / ROW).cast("long")
    col = lambda c: F.col(c) % ROW
    units = out.select(row("unit").alias("yi"), col("unit").alias("xi"), row("link").alias("down_yi"), col("link").alias("down_xi"), row("cell").alias("out_yi"), col("cell").alias("out_xi"), "total", "error")
    found = write_through(units, "units")
    return found, found.agg(F.avg(F.col("error").cast("double"))).first()[0]
