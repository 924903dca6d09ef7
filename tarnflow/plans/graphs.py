"""Queries over drainage graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flow as graph
from ..operators import terrain, tiles, upscale
from .registry import query
from .views import FLOW, flow, table

_UP = f"""WITH RECURSIVE {FLOW}, up AS (SELECT cell AS top, cell FROM flow UNION ALL SELECT up.top, f.cell FROM up JOIN flow f ON f.down = up.cell)"""


@query("g04_flow_accumulation", f"{_UP} SELECT top AS cell, CAST(count(*) AS DOUBLE) total FROM up GROUP BY top", "total")
def flow_accumulation(spark, sf):
    """Number of cells that drain through each."""
    return graph.accumulate(flow(spark, sf))


@query("g03_upstream_area", f"{_UP} SELECT top AS cell, sum(CAST(cell % 7 + 1 AS DOUBLE)) total FROM up GROUP BY top", "total")
def upstream_area(spark, sf):
    """Sum of cell areas."""
    return graph.accumulate(flow(spark, sf).withColumn("area", (F.col("cell") % 7 + 1).cast("double")), "area")


@query("g05_basins", f"WITH RECURSIVE {FLOW}, cutf AS (SELECT cell, CASE WHEN cell NOT IN (1, 2, 3) THEN down END down FROM flow), w AS (SELECT cell, cell AS pos, CAST(0 AS BIGINT) AS steps FROM cutf UNION ALL SELECT w.cell, c.down, w.steps + 1 FROM w JOIN cutf c ON c.cell = w.pos WHERE c.down IS NOT NULL) SELECT cell, arg_max(pos, steps) AS outlet, max(steps) AS steps FROM w GROUP BY cell")
def basins(spark, sf):
    """Outlet of every cell, with three links cut."""
    f = flow(spark, sf)
    return graph.basins(f.withColumn("down", F.when(~F.col("cell").isin(1, 2, 3), F.col("down"))))


@query("g06_delineate", f"{_UP} SELECT cell, CASE WHEN cell IN (SELECT cell FROM up WHERE top = 4) THEN 4 ELSE 1 END AS outlet FROM (SELECT DISTINCT cell FROM up WHERE top IN (1, 4))")
def delineate(spark, sf):
    """What drains into two nested outlets."""
    f = flow(spark, sf)
    return graph.delineate(f, f.filter("cell in (1, 4)").select("cell")).select("cell", F.col("outlet").cast("int").alias("outlet"))


@query("g08_shape_iou", f"{_UP}, a AS (SELECT top AS id, cell FROM up WHERE top IN (1, 2, 4)), b AS (SELECT cell % 3 AS id, cell FROM flow), s AS (SELECT id, count(*) n FROM a GROUP BY id), r AS (SELECT id, count(*) n FROM b GROUP BY id) SELECT a.id AS id_a, b.id AS id_b, count(*) / CAST(any_value(s.n) + any_value(r.n) - count(*) AS DOUBLE) AS iou FROM a JOIN b USING (cell) JOIN s ON s.id = a.id JOIN r ON r.id = b.id GROUP BY a.id, b.id", "iou")
def shape_iou(spark, sf):
    """IoU of basins and other cell sets."""
    f = flow(spark, sf)
    a = None
    for top in (1, 2, 4):
        one = graph.upstream_cells(f, top).withColumn("id", F.lit(top).cast("long"))
        a = one if a is None else a.unionByName(one)
    return graph.shape_iou(a, f.select((F.col("cell") % 3).alias("id"), "cell"))


@query("a41_largest_accumulation", f"{_UP}, n AS (SELECT top AS cell, count(*) n FROM up GROUP BY top), k AS (SELECT cell % 5 AS part, CAST(floor(cell / 10) AS BIGINT) yi, cell % 10 AS xi, CAST(n AS DOUBLE) total FROM n) SELECT part, b.yi AS yi, b.xi AS xi, total FROM (SELECT part, arg_min(row(yi, xi), row(-total, yi, xi)) AS rb, max(total) total FROM k GROUP BY part) z, LATERAL (SELECT rb[1] AS yi, rb[2] AS xi) b", "total")
def largest_accumulation(spark, sf):
    """Cell of the largest accumulation in each part."""
    total = graph.accumulate(flow(spark, sf)).select((F.col("cell") % 5).alias("part"), F.floor(F.col("cell") / 10).cast("long").alias("yi"), (F.col("cell") % 10).alias("xi"), "total")
    return tiles.at_largest(total, ["part"], "total")


@query(
    "g02_d8_edges",
    """WITH c AS (SELECT CAST(floor(s_suppkey / 10) AS BIGINT) yi, s_suppkey % 10 AS xi, [1, 2, 4, 8, 16, 32, 64, 128, 0][1 + s_suppkey * 7 % 9] AS dir FROM supplier),
    m(dir, dy, dx) AS (VALUES (1, 0, 1), (2, 1, 1), (4, 1, 0), (8, 1, -1), (16, 0, -1), (32, -1, -1), (64, -1, 0), (128, -1, 1)),
    e AS (SELECT yi, xi, yi + dy ty, xi + dx tx FROM c LEFT JOIN m USING (dir))
    SELECT e.yi, e.xi, g.yi AS down_yi, g.xi AS down_xi FROM e LEFT JOIN c g ON g.yi = ty AND g.xi = tx""",
)
def d8_edges(spark, sf):
    """Direction codes to edges."""
    sup = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"))
    codes = F.array(*map(F.lit, [1, 2, 4, 8, 16, 32, 64, 128, 0]))
    grid = sup.select(F.floor(F.col("k") / 10).cast("long").alias("yi"), (F.col("k") % 10).alias("xi"), F.element_at(codes, (F.col("k") * 7 % 9 + 1).cast("int")).alias("dir"))
    return graph.edges_from_d8(grid)


@query("a37_area_check", f"{_UP}, n AS (SELECT top AS id, count(*) n FROM up GROUP BY top) SELECT id, abs(n * CAST(1.01 AS DOUBLE) - n) <= CAST(0.02 AS DOUBLE) * n AS consistent, abs(n * CAST(1.01 AS DOUBLE) - (id % 50 + 1)) <= CAST(0.6 AS DOUBLE) * (id % 50 + 1) acceptable FROM n")
def area_check(spark, sf):
    """Summed areas against upstream area and reference."""
    total = graph.accumulate(flow(spark, sf)).select(F.col("cell").alias("id"), F.col("total").alias("upstream"), (F.col("total") * 1.01).alias("area_sum"))
    return graph.area_check(total, total.select("id", (F.col("id") % 50 + 1).alias("area")))


@query(
    "j12_snap_by_shape",
    f"""{_UP}, gg AS (SELECT CAST(cell / 3 AS BIGINT) id FROM flow WHERE cell % 3 = 0), cand AS (SELECT id, cell, abs(cell - id * 3) AS distance FROM gg, (SELECT unnest(range(-3, 4)) d) JOIN flow ON cell = id * 3 + d),
    sh AS (SELECT g.id, up.cell FROM gg g JOIN up ON up.top = g.id * 3 WHERE up.cell % 4 <> 0),
    n AS (SELECT top AS cell, count(*) n FROM up GROUP BY top), m AS (SELECT id, count(*) m FROM sh GROUP BY id),
    b AS (SELECT c.id, c.cell, count(*) both_ FROM cand c JOIN up ON up.top = c.cell JOIN sh ON sh.id = c.id AND sh.cell = up.cell GROUP BY ALL),
    s AS (SELECT c.id, c.cell, c.distance, n.n, m.m, coalesce(both_, 0) AS bt FROM cand c JOIN n USING (cell) JOIN m USING (id) LEFT JOIN b ON b.id = c.id AND b.cell = c.cell),
    x AS (SELECT id, cell, distance, sqrt((1 - least(n, m) / CAST(greatest(n, m) AS DOUBLE)) ** 2 + (1 - bt / CAST(n + m - bt AS DOUBLE)) ** 2) / sqrt(2) AS score FROM s)
    SELECT id, arg_min(cell, row(score, distance, cell)) AS cell, min(score) AS score FROM x WHERE score <= 0.9 GROUP BY id""",
    "score",
)
def snap_by_shape(spark, sf):
    """Cells by basin shape, of a gauge at every third cell."""
    f = flow(spark, sf)
    g = f.filter("cell % 3 = 0").select((F.col("cell") / 3).cast("long").alias("id"))
    near = g.withColumn("d", F.explode(F.sequence(F.lit(-3), F.lit(3)))).select("id", (F.col("id") * 3 + F.col("d")).alias("cell"), F.abs("d").cast("long").alias("distance"))
    candidates = near.join(f.select("cell"), "cell", "left_semi").select("id", "cell", "distance")
    shapes = _shapes(f)
    areas = shapes.groupBy("id").agg(F.count("*").cast("double").alias("area"))
    return graph.snap_by_shape(areas, f, graph.accumulate(f), shapes, candidates, 0.9)


def _shapes(f):
    """id, cell: what drains through cell 3 * id, without every fourth cell; the tree is as deep as its size has bits."""
    path, pairs = f.select("cell", F.col("cell").alias("top")), None
    depth = f.count().bit_length()
    up = f.select(F.col("cell").alias("top"), "down")
    for _ in range(depth + 1):
        here = path.filter("top % 3 = 0 and cell % 4 <> 0").select((F.col("top") / 3).cast("long").alias("id"), "cell")
        pairs = here if pairs is None else pairs.unionByName(here)
        path = path.join(up, "top").filter("down is not null").select("cell", F.col("down").alias("top"))
    return pairs


def _river(spark, sf):
    """cell, down: all suppliers as one long river."""
    sup = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("cell"))
    before = sup.select((F.col("cell") + 1).alias("cell"), F.col("cell").alias("down"))
    return sup.join(before, "cell", "left")


_RIVER = "river AS (SELECT CAST(s_suppkey AS BIGINT) cell, CASE WHEN s_suppkey - 1 IN (SELECT s_suppkey FROM supplier) THEN CAST(s_suppkey - 1 AS BIGINT) END down FROM supplier)"


@query("g03_river_area", f"WITH {_RIVER} SELECT cell, sum(CAST(cell % 7 + 1 AS DOUBLE)) OVER (ORDER BY cell DESC) total FROM river", "total")
def river_area(spark, sf):
    """Upstream areas along one long river."""
    return graph.accumulate(_river(spark, sf).withColumn("area", (F.col("cell") % 7 + 1).cast("double")), "area")


@query("g05_river_basins", f"WITH {_RIVER} SELECT cell, min(cell) OVER () AS outlet, cell - min(cell) OVER () AS steps FROM river")
def river_basins(spark, sf):
    """The outlet of one long river."""
    return graph.basins(_river(spark, sf))


@query("g06_river_stretches", f"WITH {_RIVER} SELECT cell, CAST(floor(cell / 50) * 50 AS BIGINT) AS outlet FROM river WHERE floor(cell / 50) * 50 IN (SELECT cell FROM river)")
def river_stretches(spark, sf):
    """Nested outlets along one long river."""
    river = _river(spark, sf)
    return graph.delineate(river, river.filter("cell % 50 = 0").select("cell"))


#: A terrain a hundred cells wide, of whole numbers, so that much of it is level.
_TERRAIN = """z AS (SELECT CAST(floor(l_partkey / 100) AS BIGINT) yi, CAST(l_partkey % 100 AS BIGINT) xi, floor(avg(CAST(l_quantity AS DOUBLE)) / 2) z FROM lineitem GROUP BY l_partkey),
    o(dy, dx) AS (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)),
    nb AS (SELECT a.yi, a.xi, b.yi AS ny, b.xi AS nx, b.z AS nz FROM z a CROSS JOIN o JOIN z b ON b.yi = a.yi + dy AND b.xi = a.xi + dx),
    outlets AS (SELECT yi, xi, z FROM z WHERE (yi, xi) NOT IN (SELECT (yi, xi) FROM nb GROUP BY yi, xi HAVING count(*) = 8)),
    f(yi, xi, level) USING KEY (yi, xi) AS (SELECT yi, xi, z FROM outlets UNION
        SELECT nb.ny, nb.nx, min(greatest(f.level, nb.nz)) AS level FROM f JOIN nb ON nb.yi = f.yi AND nb.xi = f.xi LEFT JOIN recurring.f r ON r.yi = nb.ny AND r.xi = nb.nx
        WHERE r.level IS NULL OR greatest(f.level, nb.nz) < r.level GROUP BY nb.ny, nb.nx),
    n AS (SELECT nb.yi, nb.xi, a.level, nb.ny, nb.nx, b.level AS nlevel FROM nb JOIN f a ON a.yi = nb.yi AND a.xi = nb.xi JOIN f b ON b.yi = nb.ny AND b.xi = nb.nx),
    s(yi, xi, steps) USING KEY (yi, xi) AS (SELECT yi, xi, CAST(0 AS BIGINT) FROM (SELECT yi, xi FROM outlets UNION SELECT yi, xi FROM n WHERE nlevel < level) UNION
        SELECT n.ny, n.nx, min(s.steps) + 1 AS steps FROM s JOIN n ON n.yi = s.yi AND n.xi = s.xi AND n.nlevel = n.level LEFT JOIN recurring.s r ON r.yi = n.ny AND r.xi = n.nx WHERE r.steps IS NULL GROUP BY n.ny, n.nx),
    d AS (SELECT n.yi, n.xi, arg_min(row(n.ny, n.nx), row(n.nlevel, s.steps, n.ny, n.nx)) AS down FROM n JOIN s ON s.yi = n.ny AND s.xi = n.nx WHERE (n.yi, n.xi) NOT IN (SELECT (yi, xi) FROM outlets) GROUP BY n.yi, n.xi)"""


def _terrain(spark, sf):
    height = F.floor(F.avg(F.col("l_quantity").cast("double")) / 2).cast("double").alias("value")
    return table(spark, sf, "lineitem").groupBy(F.floor(F.col("l_partkey") / 100).cast("long").alias("yi"), (F.col("l_partkey") % 100).cast("long").alias("xi")).agg(height)


@query("g01_flow_directions", f"WITH RECURSIVE {_TERRAIN} SELECT f.yi, f.xi, f.level AS filled, d.down[1] AS down_yi, d.down[2] AS down_xi FROM f LEFT JOIN d USING (yi, xi)")
def flow_directions(spark, sf):
    """G1: filled heights, and the cell that each drains into; tiles of 32 x 32 cells."""
    return terrain.flow_directions(_terrain(spark, sf), 32).select("yi", "xi", "filled", "down_yi", "down_xi")


#: Cells fifty wide that drain to the east, south-east or south, or against that to the south-west, in units of 4 x 4.
_DRAINED = """c AS (SELECT CAST(floor(p_partkey / 50) AS BIGINT) yi, CAST(p_partkey % 50 AS BIGINT) xi, p_size % 4 AS k FROM part),
    e AS (SELECT yi, xi, yi + CASE k WHEN 0 THEN 0 ELSE 1 END AS ty, xi + CASE k WHEN 2 THEN 0 WHEN 3 THEN -1 ELSE 1 END AS tx FROM c),
    d AS (SELECT e.yi * 1000 + e.xi AS cell, g.yi * 1000 + g.xi AS down FROM e LEFT JOIN c g ON g.yi = ty AND g.xi = tx),
    up AS (SELECT cell AS top, cell FROM d UNION ALL SELECT d.down, up.cell FROM up JOIN d ON d.cell = up.top WHERE d.down IS NOT NULL),
    tot AS (SELECT top AS cell, count(*) AS total FROM up GROUP BY top),
    un AS (SELECT cell, down, total, (cell // 1000 // 4) * 1000 + cell % 1000 // 4 AS unit, (down // 1000 // 4) * 1000 + down % 1000 // 4 AS dunit FROM d JOIN tot USING (cell)),
    ways AS (SELECT * FROM un WHERE down IS NULL OR dunit <> unit),
    o0 AS (SELECT unit, arg_max(cell, row(total, -cell)) AS cell FROM ways GROUP BY unit)"""


def _round(k: int) -> str:
    """SQL of one round: what lies below each way out, the conflicts, and the outlets after it."""
    near = "below IS NOT NULL AND bunit <> unit AND abs(bunit // 1000 - unit // 1000) <= 1 AND abs(bunit % 1000 - unit % 1000) <= 1"
    return f""", r{k} AS (SELECT cell AS start, down AS pos FROM ways UNION ALL SELECT r.start, d.down FROM r{k} r JOIN d ON d.cell = r.pos WHERE r.pos NOT IN (SELECT cell FROM o{k})),
    b{k} AS (SELECT start AS cell, pos AS below, (pos // 1000 // 4) * 1000 + pos % 1000 // 4 AS bunit FROM r{k} WHERE pos IN (SELECT cell FROM o{k})),
    s{k} AS (SELECT unit, cell, down, dunit, total, below, bunit, {near} AS good, cell IN (SELECT cell FROM o{k}) AS outlet FROM ways LEFT JOIN b{k} USING (cell)),
    n{k} AS (SELECT count(*) AS n FROM s{k} WHERE outlet AND below IS NOT NULL AND NOT good),
    o{k + 1} AS (SELECT o.unit, coalesce(m.cell, o.cell) AS cell FROM o{k} o LEFT JOIN (SELECT s.unit, arg_max(s.cell, row(s.total, -s.cell)) AS cell FROM s{k} s JOIN s{k} w ON w.unit = s.unit AND w.outlet AND w.below IS NOT NULL AND NOT w.good WHERE NOT s.outlet AND s.good GROUP BY s.unit) m USING (unit))"""


_UPSCALED = f"""WITH RECURSIVE {_DRAINED}{_round(0)}{_round(1)},
    best AS (SELECT * FROM s0 WHERE outlet AND (SELECT n FROM n1) >= (SELECT n FROM n0) UNION ALL SELECT * FROM s1 WHERE outlet AND (SELECT n FROM n1) < (SELECT n FROM n0)),
    mend AS (SELECT a.unit, arg_min(b.unit, row(b.unit <> a.dunit, b.total, b.unit)) AS link FROM best a JOIN best b ON a.unit <> b.unit AND abs(a.unit // 1000 - b.unit // 1000) <= 1 AND abs(a.unit % 1000 - b.unit % 1000) <= 1 AND b.total > a.total WHERE a.below IS NOT NULL AND NOT a.good GROUP BY a.unit),
    l AS (SELECT unit, cell, total, below IS NOT NULL AND NOT good AS error, CASE WHEN good THEN bunit ELSE link END AS link FROM best LEFT JOIN mend USING (unit))
    SELECT CAST(unit // 1000 AS BIGINT) AS yi, CAST(unit % 1000 AS BIGINT) AS xi, CAST(link // 1000 AS BIGINT) AS down_yi, CAST(link % 1000 AS BIGINT) AS down_xi, cell // 1000 AS out_yi, cell % 1000 AS out_xi, CAST(total AS DOUBLE) AS total, error FROM l"""


@query("g07_upscaled_directions", _UPSCALED)
def upscaled_directions(spark, sf):
    """Directions of units of 4 x 4 cells, conflicts mended in one round."""
    part = table(spark, sf, "part").select(F.col("p_partkey").cast("long").alias("k"), (F.col("p_size") % 4).alias("d"))
    cells = part.select(F.floor(F.col("k") / 50).cast("long").alias("yi"), (F.col("k") % 50).alias("xi"), "d")
    to = cells.select("yi", "xi", (F.col("yi") + F.when(F.col("d") == 0, 0).otherwise(1)).alias("down_yi"), (F.col("xi") + F.when(F.col("d") == 2, 0).when(F.col("d") == 3, -1).otherwise(1)).alias("down_xi"))
    there = cells.select(F.col("yi").alias("down_yi"), F.col("xi").alias("down_xi"), F.lit(True).alias("there"))
    joined = to.join(there.hint("merge"), ["down_yi", "down_xi"], "left").select("yi", "xi", *[F.when(F.col("there"), F.col(c)).alias(c) for c in ("down_yi", "down_xi")])
    return upscale.upscale(joined, 4, rounds=1)[0]
