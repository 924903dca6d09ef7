"""Drainage graphs: every cell drains into at most one other.

Sums along the graph are made by doubling: after round r a cell knows the cell 2**r steps down and the sum
over what drains into it within fewer than 2**r steps, so rounds grow with the logarithm of the longest path, and
no round holds more than a row a cell.  Rounds join by shuffles: tables that are small as files are many times that on the driver, once a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arith import safe_div
from ..session import write_through

#: D8 codes to (dy, dx), row 0 in the north.
D8 = {1: (0, 1), 2: (1, 1), 4: (1, 0), 8: (1, -1), 16: (0, -1), 32: (-1, -1), 64: (-1, 0), 128: (-1, 1)}


def edges_from_d8(directions: DataFrame, code: str = "dir") -> DataFrame:
    """yi, xi, down_yi, down_xi: null where a cell drains nowhere (code 0, 255 or unknown) or out of the grid."""
    dy, dx = (F.coalesce(*[F.when(F.col(code) == c, F.lit(d[i])) for c, d in D8.items()]) for i in (0, 1))
    to = directions.select("yi", "xi", (F.col("yi") + dy).alias("down_yi"), (F.col("xi") + dx).alias("down_xi"))
    there = directions.select(F.col("yi").alias("down_yi"), F.col("xi").alias("down_xi"), F.lit(True).alias("__there"))
    out = to.join(there, ["down_yi", "down_xi"], "left")
    return out.select("yi", "xi", *[F.when(F.col("__there"), F.col(c)).alias(c) for c in ("down_yi", "down_xi")])


def accumulate(flow: DataFrame, weight: str | None = None) -> DataFrame:
    """cell, total: the sum of weights (default 1) of all that drains through a cell, itself included."""
    state = flow.select("cell", F.col("down").alias("jump"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("total"))
    while True:
        state = write_through(state, "flow")
        if state.filter("jump is not null").isEmpty():
            return state.select("cell", "total")
        arrived = state.filter("jump is not null").groupBy(F.col("jump").alias("cell")).agg(F.sum("total").alias("more"))
        further = state.select(F.col("cell").alias("jump"), F.col("jump").alias("next"))
        state = state.join(arrived.hint("merge"), "cell", "left").join(further.hint("merge"), "jump", "left").select("cell", F.col("next").alias("jump"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"))


def basins(flow: DataFrame, weight: str | None = None) -> DataFrame:
    """cell, outlet, steps: the last cell down, and the number of steps to it (or the sum of the weights of the cells ahead of it)."""
    one = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    state = flow.select("cell", F.coalesce("down", "cell").alias("outlet"), F.when(F.col("down").isNotNull(), one).otherwise(0).alias("steps"))
    while True:
        state = write_through(state, "basins")
        there = state.select(F.col("cell").alias("outlet"), F.col("outlet").alias("next"), F.col("steps").alias("more"))
        moved = state.join(there.hint("merge"), "outlet").select("cell", F.col("next").alias("outlet"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("next") != F.col("outlet")).alias("moved"))
        state = write_through(moved, "basins")
        if state.filter("moved").isEmpty():
            return state.select("cell", "outlet", "steps")
        state = state.drop("moved")


def tour(flow: DataFrame) -> DataFrame:
    """cell, outlet, at, size: what drains through a cell are the cells at ``at`` to ``at + size - 1`` of its outlet's tree.

    A cell comes right after the cell it drains into, or after the trees of the neighbours that drain into it as well and have smaller numbers: a sum along the path down.
    """
    sized = write_through(flow.join(accumulate(flow).withColumn("size", F.col("total").cast("long")), "cell").select("cell", "down", "size"), "sizes")
    # neighbours that drain into one cell are at most eight on a grid
    ahead = F.sum("size").over(Window.partitionBy("down").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    stepped = sized.filter("down is not null").withColumn("step", 1 + F.coalesce(ahead, F.lit(0))).unionByName(sized.filter("down is null").withColumn("step", F.lit(0).cast("long")))
    found = basins(stepped, "step")
    return found.join(sized.select("cell", "size"), "cell").select("cell", "outlet", F.col("steps").alias("at"), "size")


def delineate(flow: DataFrame, outlets: DataFrame) -> DataFrame:
    """cell, outlet: what drains into each outlet before it meets another one further up (``outlets``: cell)."""
    cut = flow.join(outlets.select("cell", F.lit(True).alias("__cut")), "cell", "left").select("cell", F.when(F.col("__cut").isNull(), F.col("down")).alias("down"))
    return basins(cut).join(outlets.select(F.col("cell").alias("outlet")), "outlet", "left_semi").select("cell", "outlet")


def upstream_cells(flow: DataFrame, outlet: int) -> DataFrame:
    """cell: all that drains through one cell."""
    one = flow.sparkSession.createDataFrame([(outlet,)], "cell long")
    return delineate(flow, one).select("cell")


def shape_iou(a: DataFrame, b: DataFrame, area: str | None = None) -> DataFrame:
    """id_a, id_b, iou of cell sets (id, cell), by joint cells; pairs without a common cell are not in the result."""
    w = F.col(area) if area else F.lit(1.0)
    sizes = [f.groupBy(F.col("id").alias(f"id_{n}")).agg(F.sum(w).alias(f"size_{n}")) for f, n in ((a, "a"), (b, "b"))]
    both = a.select(F.col("id").alias("id_a"), "cell", *([area] if area else [])).join(b.select(F.col("id").alias("id_b"), "cell"), "cell")
    out = both.groupBy("id_a", "id_b").agg(F.sum(w).alias("both")).join(sizes[0], "id_a").join(sizes[1], "id_b")
    return out.select("id_a", "id_b", safe_div("both", F.col("size_a") + F.col("size_b") - F.col("both")).alias("iou"))


def snap_by_shape(gauges: DataFrame, flow: DataFrame, totals: DataFrame, shapes: DataFrame, candidates: DataFrame, max_error: float = 0.5, naive: DataFrame | None = None) -> DataFrame:
    """id, cell, score of the candidate whose basin fits a gauge's shape best.

    ``gauges``: id, area; ``candidates``: id, cell, distance; ``totals``: cell, total; ``shapes``: id, cell.
    score = hypot(1 - area ratio, 1 - IoU) / sqrt(2); the nearer of equal ones; none over ``max_error``.  ``naive`` (id, cell): a location
    that stays where its IoU is better than that of the best candidate.
    Basins are stretches of a tour of the tree, so a candidate's common cells with a shape are counted by position: no basin is written out.
    """
    order = write_through(tour(flow), "tour")
    wanted = candidates.select("id", "cell")
    if naive is not None:
        wanted = wanted.unionByName(naive.select("id", "cell")).distinct()
    here = order.select("cell", "outlet", "at", "size")
    bounds = wanted.join(here, "cell").withColumn("end", F.explode(F.array(F.lit(0), F.lit(1))))
    marks = bounds.select("id", "outlet", (F.col("at") + F.col("end") * F.col("size")).alias("pos"), "cell", F.col("end").cast("int").alias("end"), F.lit(0).alias("there"))
    members = shapes.join(here, "cell").select("id", "outlet", F.col("at").alias("pos"), F.lit(None).cast("long").alias("cell"), F.lit(None).cast("int").alias("end"), F.lit(1).alias("there"))
    # shape cells ahead of each bound: those of a position come after bounds there
    ahead = F.sum("there").over(Window.partitionBy("id", "outlet").orderBy("pos", "there").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = marks.unionByName(members).withColumn("ahead", ahead).filter("end is not null")
    both = counted.groupBy("id", "cell").agg(F.sum(F.when(F.col("end") == 1, F.col("ahead")).otherwise(-F.col("ahead"))).alias("both"))
    want = shapes.groupBy("id").agg(F.count("*").alias("m"))
    sized = both.join(here.select("cell", F.col("size").alias("n")), "cell").join(want, "id")
    sized = sized.select("id", "cell", (F.col("both") / (F.col("n") + F.col("m") - F.col("both"))).alias("iou"))
    scored = candidates.join(sized, ["id", "cell"]).join(totals.select("cell", "total"), "cell").join(gauges.select("id", "area"), "id")
    ratio = safe_div(F.least("total", "area"), F.greatest("total", "area"))
    scored = scored.withColumn("score", F.sqrt((1 - ratio) ** 2 + (1 - F.col("iou")) ** 2) / F.sqrt(F.lit(2.0))).filter(F.col("score") <= max_error)
    best = scored.groupBy("id").agg(F.min(F.struct("score", "distance", "cell", "iou")).alias("b")).select("id", "b.cell", "b.score", "b.iou")
    if naive is not None:
        first = naive.select("id", F.col("cell").alias("naive_cell")).join(sized.select("id", F.col("cell").alias("naive_cell"), F.col("iou").alias("naive_iou")), ["id", "naive_cell"])
        keep = F.col("naive_iou") > F.col("iou")
        best = best.join(first, "id", "left").select("id", F.when(keep, F.col("naive_cell")).otherwise(F.col("cell")).alias("cell"), F.when(~F.coalesce(keep, F.lit(False)), F.col("score")).alias("score"))
    return best.select("id", "cell", "score")


def area_check(totals: DataFrame, reference: DataFrame, rtol: float = 0.02, max_error: float = 0.3) -> DataFrame:
    """id, consistent, acceptable: summed cell areas against the upstream area, and against the reference (twice the error allowed)."""
    out = totals.join(reference, "id")
    gap = lambda a, b: F.abs(F.col(a) - F.col(b))
    return out.select("id", (gap("area_sum", "upstream") <= rtol * F.col("upstream")).alias("consistent"), (gap("area_sum", "area") <= 2 * max_error * F.col("area")).alias("acceptable"))


def merge_dateline(east: DataFrame, west: DataFrame, lon: str = "lon", cut: float = 170.0) -> DataFrame:
    """Basins of ``west`` that touch |lon| > cut replace those of ``east`` that do; their ids follow on."""
    edge = F.abs(F.col(lon)) > cut
    top = east.agg(F.max("basin")).first()[0] or 0
    inner = east.join(east.filter(edge).select("basin").distinct(), "basin", "left_anti")
    outer = west.join(west.filter(edge).select("basin").distinct(), "basin", "left_semi").withColumn("basin", F.col("basin") + top + 1)
    return inner.unionByName(outer)
